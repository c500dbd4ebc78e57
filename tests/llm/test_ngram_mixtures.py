"""Texts mixed of common passages: exact, whatever runs their lists make, and no pairs for mixtures that can't link."""

import random

import pytest

from tilewright.llm import ngram_join
from tilewright.llm.common import saved


def brute(texts):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(texts)))

    def of(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                lo, hi = sorted((of(i), of(j)))
                top[hi] = lo
    return [of(i) for i in range(len(texts))]


def mixtures(seed, n):
    """Texts of one to nine of a few passages of unlike lengths, some with own words, changed words or parts cut."""
    r = random.Random(seed)
    pool = [" ".join(f"w{r.randrange(3000)}" for _ in range(r.choice([8, 20, 60, 150]))) for _ in range(9)]
    out = []
    for _ in range(n):
        words = " ".join(r.sample(pool, r.choice([1, 2, 3, 3, 4, 6, 9]))).split()
        kind = r.randrange(5)
        if kind == 0:
            words = [w if r.random() > 0.01 else f"x{r.randrange(10**6)}" for w in words]
        elif kind == 1:
            words += [f"y{r.randrange(10**6)}" for _ in range(r.randrange(1, 2 + len(words) // 4))]
        elif kind == 2:
            words = words[: max(1, int(len(words) * r.uniform(0.7, 1)))]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("seed", "least"), [(1, 64), (2, 64), (3, 5), (4, 2)])
def test_mixtures(spark, monkeypatch, seed, least):
    """Also with most passages' shingles past the index as common ones."""
    monkeypatch.setattr(ngram_join, "COMMON_LEAST", least)
    texts = mixtures(seed, 260)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    want = brute(texts)
    assert [got[k] for k in range(len(texts))] == want
    assert 5 < len(set(want)) < len(texts)


@pytest.mark.parametrize("least", [64, 5])
def test_other_mixtures_do_not_meet(spark, monkeypatch, least):
    """Of texts that share passages but can't link, hardly any are searched for in each other."""
    monkeypatch.setattr(ngram_join, "COMMON_LEAST", least)
    asked = []
    meet = ngram_join._meetings

    def counted(here, scratch):
        out = saved(meet(here, scratch), "asked", scratch)
        asked.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_meetings", counted)
    r = random.Random(9)
    pool = [" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(12)]
    texts = [" ".join(r.sample(pool, 4)) for _ in range(400)]
    rows = ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    same = len({tuple(sorted(t.split())) for t in texts})
    assert rows.select("component_id").distinct().count() <= 400
    pairs = sum(1 for i in range(400) for j in range(i) if set(texts[i].split()) & set(texts[j].split()))
    assert sum(asked) < pairs / 20 and same > 200
