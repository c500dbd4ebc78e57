import hashlib

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.llm import fill_middle

PIECES = st.text(st.characters(exclude_categories=["Cs"]), max_size=12) | st.sampled_from(["<P>", "<S>", "<M>", "<", "<P", ">", "P>", "<S", "M>", "\n", "\r\n", " ", "😀é"])


def brute(doc_id, text, seed=1):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def compare(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("units", "hash", "n", "first", "second", "form", "prefix", "output"):
        df = df.withColumn(name, F.lit(7))
    want = []
    for i, t in rows:
        n, form, p, m, out = brute(i, t)
        want.append((i, n, form, p, m, digest(out), digest(t or "")))
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(map(tuple, fill_middle.digests(df).collect()), key=key) == sorted(want, key=key)


def test_documents(spark, texts):
    rows = texts + [(None, "no id"), (None, None), (-5, "negative"), *((1000 + k, f"{'ab' * k}<{'PSM'[k % 3]}" + ">" * (k % 2) + "tail") for k in range(60))]
    compare(spark, rows)
    forms = {brute(i, t)[1] for i, t in rows}
    assert forms == {"plain", "psm", "spm"}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=6).map("".join), min_size=40, max_size=80))
def test_any_texts(spark, some):
    compare(spark, list(enumerate(some)))


def test_equals_sql(spark, texts):
    rows = [(i, None if t is None else t.replace("\0", "")) for i, t in texts if i != 9] + [(200 + k, f"<{'PSM'[k % 3]}" + "x" * k) for k in range(50)]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    want = duckdb.sql(fill_middle.oracle_sql()).fetchall()
    got = fill_middle.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_words_as_units(spark):
    text = "  one two\nthree  four five six seven "
    df = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string")
    rows = fill_middle.arranged(df, seed=9, unit=r"\S+\s*", plain=0, suffix_first=50, sentinels=("[[P", "[[S", "[[M")).withColumn("again", fill_middle.restored(F.col("output"), F.col("form"), ("[[P", "[[S", "[[M"))).collect()
    assert {r["form"] for r in rows} == {"psm", "spm"}
    for r in rows:
        assert r["again"] == text and r["prefix"] + r["middle"] + r["suffix"] == text and r["n"] == 9
        assert not r["prefix"].strip() or r["prefix"][-1] in " \n" or r["middle"] == r["suffix"] == ""


def test_sentinels_that_overlap(spark, documents, none):
    for bad in (("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("ab", "bc", "x")):
        with pytest.raises(ValueError):
            fill_middle.arranged(documents, sentinels=bad)
    assert fill_middle.digests(none).count() == 0
