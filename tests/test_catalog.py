import duckdb
import pandas as pd
import pytest

from tilewright import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def value(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, float):
            return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(round(v, 9))
        return str(v.tolist() if hasattr(v, "tolist") else v)

    return list(frame.columns), sorted(tuple(value(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_oracle(spark, oracle, name):
    ours = catalog.queries()[name](spark, FOLDER).toPandas()
    assert rows(ours) == rows(oracle.execute(catalog.oracle_sql()[name]).fetch_df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0


def test_changed_groups_by_union(spark):
    """All rows, against joining groups one edge at a time."""
    found = {r["node"]: r["grp"] for r in catalog.queries()["changed_groups"](spark, FOLDER).collect()}
    top = {}

    def of(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for r in spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_suppkey", "l_partkey").collect():
        a, b = sorted((of(r["l_suppkey"]), of(r["l_partkey"] % 40 + 1000000)))
        top[b] = a
    assert found == {x: of(x) for x in list(top)}
