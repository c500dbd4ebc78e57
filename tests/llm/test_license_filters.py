"""The license join's filters: what they leave, and that they lose nothing."""

import random

import pytest

from tilewright.llm import licenses


def invented(seed, count, words):
    """Templates of unlike lengths over a vocabulary with common and rare words, and texts with pieces of them."""
    r = random.Random(seed)
    vocabulary = [f"v{int(r.paretovariate(0.6)) % words}" for _ in range(4 * words)]
    templates = [(f"label{k % 40}", " ".join(r.choices(vocabulary, k=r.choice([3, 8, 20, 45])))) for k in range(count)]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(r.randrange(6)):
            own = r.choice(templates)[1].split()
            kind = r.randrange(4)
            if kind == 0:
                own = [w for w in own if r.random() > 0.05]
            elif kind == 1:
                r.shuffle(own)
            elif kind == 2:
                own = [x for w in own for x in ((w, "foreign") if r.random() < 0.08 else (w,))]
            else:
                own = own[: len(own) * 2 // 3]
            parts.append(" ".join(own))
            parts.append(" ".join(r.choices(vocabulary, k=r.randrange(30))))
        texts.append(" ".join(parts))
    return templates, texts


def brute(texts, templates):
    """(labels, score) by every window against every template."""
    out = []
    for t in texts:
        words, labels, score = t.split(), set(), 0.0
        for _, label, own, need, window in licenses.template_rows(templates):
            own = set(own)
            most = max((len(own & set(words[i : i + window])) for i, w in enumerate(words) if w in own), default=0)
            if most >= need:
                labels.add(label)
                score = max(score, most / len(own))
        out.append((",".join(sorted(labels)), score))
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("count", [30, 400])
def test_nothing_is_lost(spark, count):
    templates, texts = invented(count, count, 300)
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(frame(spark, texts), templates).collect()}
    want = brute(texts, templates)
    assert [got[k] for k in range(len(texts))] == want
    assert sum(bool(labels) for labels, _ in want) > 20


def test_each_filter_leaves_less(spark):
    """Places of any template word, anchors, those long enough, those placed well, those that meet: fewer each time."""
    templates, texts = invented(7, 200, 300)
    r = random.Random(1)
    vocabulary = sorted({w for _, text in templates for w in text.split()})
    texts = texts[:10] + [" ".join(w if r.random() < 0.1 else f"filler{k}" for k, w in enumerate(r.choices(vocabulary, k=size))) for size in [30] * 200 + [600] * 60]
    places = sum(1 for t in texts for w in t.split() for _, text in templates if w in set(text.split()))
    rows = licenses.candidates(frame(spark, texts), templates).where("anchor >= 0").selectExpr("count(*) as anchors", "count_if(long_enough) as long", "count_if(placed) as placed", "count_if(best is not null) as met").first()
    assert places > 3 * rows["anchors"], (places, rows)
    assert rows["anchors"] > 1.5 * rows["long"] and rows["long"] > 1.5 * rows["placed"] and rows["placed"] > rows["met"] > 0, (places, rows)


def test_filters_on_notices(spark):
    """The library's own templates: words of notices in prose without notices make no window."""
    prose = "the license of the software is not the same as the public domain in this state and any copy of it is subject to its terms"
    notice = next(t for _, t in licenses.TEMPLATES if t.startswith("redistribution and"))
    rows = licenses.candidates(frame(spark, [prose] * 50 + [notice])).where("anchor >= 0").collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in rows if r["best"] is not None} == {50}  # not even anchors


def test_order_is_the_corpus(spark):
    templates = [("x", "common rare never")]
    order = licenses.corpus_order(frame(spark, ["common common", "common rare", "rare common", "Common"]), templates)
    assert order == ["never", "rare", "common"]
    assert [(w, rest) for w, _, _, _, _, _, rest in licenses.prefixes(order, templates)] == [("never", order)]
