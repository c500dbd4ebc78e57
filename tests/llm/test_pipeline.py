import public_tokenizers as P

import corpus_pipeline
from tilewright.llm import packing, pii
from test_ngram_join import brute


def test_pipeline(spark, tmp_path, texts):
    from pyspark.sql import functions as F  # noqa: F401

    seen = {}
    for i, t in texts:
        seen.setdefault(i, t)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in seen.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # brute force: texts with letters in the one language learned, the first of each component, masked, tokenised
    known = {i: t for i, t in seen.items() if t and any(c.isalpha() for c in t)}
    first = {i for i, _, c in brute(list(known.items())) if i == c}
    words = packing.WordTokenizer(P.path("word_bpe_49k.json"))
    want = {}
    for i in first:
        text, at, parts = known[i], 0, []
        for s, k, e in pii.base_spans(known[i]):
            if s >= at:
                parts += [text[at:s], f"[{pii.KINDS[k].upper()}]"]
            at = max(at, e)
        want[i] = len(words.raw("".join([*parts, text[at:]]))) // 4 + 1
    got = {}
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_stages_keep_columns(spark, documents):
    docs = documents.select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS, name
