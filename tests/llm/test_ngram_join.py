import random
import re

import numpy as np
import pyarrow as pa

from tilewright.llm import ngram_join
from tilewright.llm.ngram_join import divide_skip
from tilewright.llm.shingles import shingle_sets


def brute(texts):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [(i, shingles(t)) for i, t in texts]
    comp = list(range(len(sets)))
    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= 75 * len(x | y) and comp[a] != comp[b]:
                old, new = comp[a], comp[b]
                comp = [new if c == old else c for c in comp]
    least = {}
    for c, (i, _) in zip(comp, sets, strict=True):
        least[c] = min(i, least.get(c, i))
    return sorted((i, len(s), least[c]) for c, (i, s) in zip(comp, sets, strict=True))


def answer(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect())


def test_divide_skip():
    r = random.Random(5)
    for _ in range(300):
        lists = [sorted(r.sample(range(12), r.randrange(1, 9))) for _ in range(r.randrange(1, 8))]
        least = r.randrange(1, 6)
        count = {x: sum(x in one for one in lists) for x in range(12)}
        assert sorted(divide_skip(lists, least)) == sorted((x, n) for x, n in count.items() if n >= least)


def test_sets():
    import pyarrow as pa

    sets = shingle_sets(pa.array(["a b c d e f", "A  B\tc d E f", "a b", None, "", " \n", "a b c d e"]))
    assert [len(s) for s in sets] == [2, 2, 1, 0, 0, 0, 1]
    assert (sets[0] == sets[1]).all() and sets[6][0] in sets[0]


def test_edge_cases(documents, texts, none):
    assert answer(documents) == brute(texts)
    assert ngram_join.jaccard_components(none).count() == 0


def test_chains_of_near_copies(spark):
    r = random.Random(8)
    texts, n = [], 0
    for g in range(6):
        words = [f"g{g}x{r.randrange(60)}" for _ in range(r.choice((12, 40, 90)))]
        for _ in range(25):
            for _ in range(r.randrange(4)):
                words = list(words)
                words[r.randrange(len(words))] = f"e{r.randrange(1000)}"
            texts.append((n, " ".join(words)))
            n += 1
    passage = " ".join(f"p{k}" for k in range(30))
    for k in range(40):  # a passage that many share, at every share of the text
        texts.append((n, passage + " " + " ".join(f"o{k}y{j}" for j in range(k // 2))))
        n += 1
    r.shuffle(texts)
    df = table(spark, texts)
    assert answer(df) == brute(texts)
    kept = {r["doc_id"] for r in ngram_join.drop_near_copies(df).collect()}
    assert kept == {c for _, _, c in brute(texts)}


def table(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def thue_morse(n):
    t = "a"
    for _ in range(n):
        t += t.translate({97: 98, 98: 97})
    return t


def test_words_that_polynomial_hashes_confuse(spark):
    words = [w for n in (10, 11) for t in [thue_morse(n)] for w in (t, t.translate({97: 98, 98: 97}))]
    texts = [*enumerate(words), (9, " ".join(["x y z u", words[0]])), (10, " ".join(["x y z u", words[1]]))]
    assert answer(table(spark, texts)) == brute(texts) == [(i, 1, i) for i in (0, 1, 2, 3, 9, 10)]
    assert {r["doc_id"] for r in ngram_join.drop_near_copies(table(spark, texts)).collect()} == {i for i, _ in texts}


def test_templates_that_nearly_reach_the_threshold(spark):
    passage = [f"t{k}" for k in range(40)]
    texts = []
    for k in range(300):
        shared, own = 8 + k % 30, k % 7
        texts.append((k, " ".join([*passage[:shared], *(f"o{k}x{j}" for j in range(own))])))
    assert answer(table(spark, texts)) == brute(texts)


def test_common_shingles_go_past_the_index(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON_LEAST", 5)
    monkeypatch.setattr(ngram_join, "PACK", 500)
    r, passage, texts = random.Random(4), [f"t{k}" for k in range(30)], []
    for k in range(120):
        texts.append((k, " ".join([*passage[: r.randrange(12, 30)], *(f"o{r.randrange(9)}" for _ in range(r.randrange(8)))])))
    df = table(spark, texts)
    assert ngram_join.named_nodes(df)[1].common
    assert answer(df) == brute(texts)


def test_names_that_clash(spark, monkeypatch):
    digest = ngram_join._digest
    monkeypatch.setattr(ngram_join, "_digest", lambda s: bytes([digest(s)[0] & 3]) + bytes(7) + digest(s)[8:])
    texts = [(k, " ".join(f"c{k // 2}w{j}" for j in range(20 + k % 2))) for k in range(20)]
    df = table(spark, texts)
    assert len(ngram_join.named_nodes(df)[1].renamed) == 4
    assert answer(df) == brute(texts)


def test_false_links_are_found(spark):
    texts = [(0, " ".join(f"a{k}" for k in range(30))), (1, " ".join(f"a{k}" for k in range(31))), (2, "b " * 9)]
    df = table(spark, texts)
    nodes, naming = ngram_join.named_nodes(df)
    name = {r["doc_id"]: r["node"] for r in nodes.collect()}
    links = spark.createDataFrame([(name[0], name[1]), (name[1], name[2])], "a long, b long")
    assert [tuple(r) for r in ngram_join.false_links(df, links, naming, []).collect()] == [(name[1], name[2])]


def test_copies_with_repeated_and_null_ids(spark):
    one, other = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(5, one), (5, one), (6, one + " tail"), (None, one), (6, other), (None, "solo text"), (None, None), (None, None), (7, " "), (8, one.upper())]
    kept = ngram_join.drop_near_copies(table(spark, rows).withColumnRenamed("source", "node"))
    assert kept.columns == ["doc_id", "text", "lang", "node", "n_chars"]
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(5, one), (6, other), (None, "solo text"), (None, None), (None, None), (7, " ")], key=str)
    assert ngram_join.drop_near_copies(table(spark, rows).limit(0)).count() == 0


def test_sample_leaves_out_nodes_that_cannot_link(spark):
    """Only few of the texts that share little reach the whole index, and all that link do."""
    rng = np.random.default_rng(7)
    alone = [" ".join(f"w{v}" for v in rng.integers(0, 1 << 40, 200)) for _ in range(300)]
    pairs = [t + f" end{n}" for n, t in enumerate(alone[:20])]  # near copies
    short = ["one two three", "one two three", "four"]
    df = spark.createDataFrame(list(enumerate([*alone, *pairs, *short, "", None])), "doc_id long, text string").repartition(5)
    nodes, naming = ngram_join.named_nodes(df)
    stay, postings = ngram_join.staying(df, nodes, 4, naming)
    kept = {r["doc_id"] for r in nodes.where("node is not null").collect() if stay[(r["node"] & (8 * len(stay) - 1)) >> 3] >> (r["node"] & 7) & 1}
    assert kept >= {*range(20), *range(300, 320)} and len(kept) < 60
    assert postings < 60 * 200 < nodes.groupBy().sum("n_shingles").first()[0] / 4
    # the index of those that stay is all that is shuffled by range
    whole = ngram_join._packed_index(df, 4, naming, stay).selectExpr("sum(length(owner)) div 2").first()[0]
    assert whole <= postings + 3 * 200
    comps = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(df).collect()}
    assert all(comps[300 + n] == n for n in range(20)) and comps[321] == 320 and len(set(comps.values())) == 325 - 21


def test_counts_of_the_sample_cost_few_rows(spark):
    """Rows that the sample's index sends on follow the ranges, not the nodes of each range."""
    passage = [f"t{k}" for k in range(60)]
    texts = [" ".join([*passage, *(f"o{k}x{j}" for j in range(20))]) for k in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    nodes, naming = ngram_join.named_nodes(df)
    naming = ngram_join.Naming(naming.seed, naming.renamed)  # the passage's shingles go through the index
    counts = ngram_join._counts(ngram_join._packed_index(df, 4, naming), 4)
    got = {r["node"]: r["shared"] for r in counts.collect()}
    ids = {r["node"] for r in nodes.where("node is not null").collect()}
    sampled = int(ngram_join._sampled(naming.sets(pa.array([" ".join(passage)]))[0]).sum())
    assert set(got) == ids and set(got.values()) == {sampled}
    ranges = ngram_join._packed_index(df, 4, naming).select("bucket").distinct().count()
    packed = ngram_join._range_counts(ngram_join._packed_index(df, 4, naming), 4, 4).count()
    assert packed <= ranges * 16 < sum(got.values())


def test_few_texts_are_shuffled_to_drop_copies(spark, monkeypatch):
    """With more copies than may be broadcast, the others are left out by a map, and nothing else changes."""
    monkeypatch.setattr(ngram_join, "MOST_BROADCAST", 0)
    rng = random.Random(3)
    alone = [" ".join(f"w{rng.randrange(1 << 30)}" for _ in range(30)) for _ in range(200)]
    texts = list(enumerate([*alone, *(t + " end" for t in alone[:15]), *alone[:5], "", "x", None]))
    df = table(spark, texts)
    asked = []
    make = ngram_join._map_of
    monkeypatch.setattr(ngram_join, "_map_of", lambda rows, count: asked.append(count) or make(rows, count))
    kept = sorted(r["doc_id"] for r in ngram_join.drop_near_copies(df).collect())
    assert kept == sorted({c for _, _, c in brute(texts)})
    assert asked[-1] == 20  # those that go, not all nodes
