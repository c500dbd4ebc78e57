import numpy as np
import pyarrow as pa

from tilewright.llm import langid
from tilewright.llm.shingles import string_bytes


def test_gradients():
    net = langid.new_network(["a", "b", "c"], 3, seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    w = np.random.default_rng(0).integers(97, 103, (5, 4)).astype(np.uint8)
    y = np.array([0, 1, 2, 1])
    _, g = net.gradients(w, y)
    for k in net.p:
        for at in [tuple(np.random.default_rng(n).integers(0, s) for s in net.p[k].shape) for n in range(4)] + ([(98, 1), (99, 4)] if k[0] == "x" else []):
            keep = net.p[k][at]
            net.p[k][at] = keep + 1e-3
            up = net.gradients(w, y)[0]
            net.p[k][at] = keep - 1e-3
            down = net.gradients(w, y)[0]
            net.p[k][at] = keep
            assert abs((up - down) / 2e-3 - g[k][at]) < 1e-4


def test_fast_recurrence_is_the_same():
    net = langid.new_network(["a", "b"], 4)
    w = np.random.default_rng(0).integers(0, 256, (7, 5))
    f, _ = net.states("f", w)
    b, _ = net.states("b", w)
    logits = f @ net.p["o_f"] + b[::-1] @ net.p["o_b"] + net.p["c"]
    e = np.exp(logits - logits.max(axis=2, keepdims=True))
    assert np.allclose(np.moveaxis(e / e.sum(axis=2, keepdims=True), 2, 0), net.probabilities(w), atol=1e-5)


def test_pooling_does_not_depend_on_batches():
    net = langid.new_network(["a", "b"], 4)
    raw, at = string_bytes(pa.array(["abc déf" * 50, "", "x", "zz top" * 9]))
    one = langid.label_bytes(net, raw, at, window=16, at_once=3)
    two = langid.label_bytes(net, raw, at, window=16)
    assert np.allclose(one, two, atol=1e-5) and one[1].tolist() == [0, 0]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n = found.count()
    assert found.where("lang_pred = lang").count() >= 0.97 * n > 0


def test_nulls(spark, documents, none):
    rows = {r["doc_id"]: r for r in langid.identify(documents).collect()}
    assert rows[4]["lang_pred"] == rows[5]["lang_pred"] == rows[20]["lang_pred"] == "und" and rows[4]["score"] == 0
    assert rows[0]["lang_pred"] == "en" and 0 <= rows[0]["score"] <= 1
    assert langid.identify(none).count() == 0
    kept = {r["doc_id"] for r in langid.keep_known(documents).collect()}
    assert 0 in kept and not kept & {4, 5, 6}


def test_pooling_is_the_mean_over_letters():
    """Brute force: each window by itself, each letter counted once."""
    net = langid.new_network(["a", "b", "c"], 4)
    texts = ["one, two 3 four" * 20, "é" * 70, "...", "x"]
    got = langid.label_bytes(net, *string_bytes(pa.array(texts)))
    for row, t in zip(got, texts, strict=True):
        raw, total, n = np.frombuffer(t.encode(), np.uint8), np.zeros(3), 0
        for k in range(0, len(raw), 64):
            part = np.full((64, 1), 32, np.intp)
            part[: len(raw[k : k + 64]), 0] = raw[k : k + 64]
            prob = net.probabilities(part)[:, :, 0]
            for j, c in enumerate(raw[k : k + 64]):
                if bytes([c]).isalpha() or c >= 128:
                    total, n = total + prob[:, j], n + 1
        assert np.allclose(row, total / max(n, 1), atol=1e-4)


def test_windows_agree_with_one_pass(spark):
    """Starting anew every 64 bytes decides as one unbroken pass over the text does."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").select("text", "lang").collect()
    net = langid.train([r["text"][:600] for r in rows[:120]], [r["lang"] for r in rows[:120]])
    rest = [r["text"][:4000] for r in rows[120:]]
    windows = langid.label_bytes(net, *string_bytes(pa.array(rest))).argmax(axis=1)
    whole = np.array([langid.label_bytes(net, *string_bytes(pa.array([t])), window=len(t.encode()))[0].argmax() for t in rest])
    assert (windows == whole).mean() >= 0.97


def test_no_language_is_left_out(spark, monkeypatch):
    """More languages than the total has rows for: one row of each at least."""
    monkeypatch.setattr(langid, "SAMPLE_TOTAL", 30)
    rows = [(k, f"text {k}", f"l{k % 40}") for k in range(2000)]
    texts, labels = langid.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(labels) == sorted(f"l{k}" for k in range(40))
