"""Queries of budgeted cuts: a view a nation, over the customers' tree of errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.catalog import query
from tilewright.functions.bits import right
from tilewright.operators import exchange, loops
from tilewright.plans.hierarchy import _ERRORS
from tilewright.sources.tables import customers, table

_LEAF, _TARGET, _ROUNDS = 8, 0.05, 5


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """(level, row, col, error, kids) of the quadtree of the customers' weights."""
    leaf = 1 << _LEAF
    rows = customers(spark, folder).select(F.least("lon", F.lit(179.9999)).alias("lon"), F.greatest("lat", F.lit(-89.9999)).alias("lat"), "weight")
    row, col = F.floor((90 - F.col("lat")) / (90.0 / leaf)).cast("int"), F.floor((F.col("lon") + 180) / (90.0 / leaf)).cast("int")
    # leaves first: their ancestors' cells are halvings of theirs, so no customer comes once a level
    leaves = rows.groupBy(row.alias("row"), col.alias("col")).agg(F.max(F.abs("weight")).alias("weight")).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(_LEAF))))
    up = (_LEAF - F.col("level")).cast("int")
    at = [F.call_function("shiftright", F.col(c), up).alias(c) for c in ("row", "col")]
    found = leaves.groupBy("level", *at).agg((F.max("weight") / 1000 / F.first(F.pow(F.lit(2.0), "level"))).alias("error"))
    kids = found.where("level > 0").groupBy((F.col("level") - 1).alias("level"), right(F.col("row"), 1).alias("row"), right(F.col("col"), 1).alias("col")).agg(F.count("*").alias("kids"))
    return found.join(kids, exchange.NODE, "left").withColumn("kids", F.coalesce("kids", F.lit(0)))


def first_cuts(spark: SparkSession, folder: str, tree: DataFrame) -> DataFrame:
    """(view, budget, level, row, col, error): each nation starts with one whole level."""
    n = F.col("n_nationkey")
    views = table(spark, folder, "nation").select(n.cast("long").alias("view"), (80 + n * 37 % 200).cast("long").alias("budget"), (1 + n % 3).cast("int").alias("level"))
    return views.join(tree.select(*exchange.NODE, "error"), "level").select("view", "budget", *exchange.NODE, "error")


def _sql() -> str:
    out = f"""with tree0 as materialized (select * from {_ERRORS}),
tree as materialized (select level, row, col, error, coalesce(kids, 0) as kids from tree0 left join (select level - 1 as level, row >> 1 as row, col >> 1 as col, count(*) as kids from tree0 where level > 0 group by all) using (level, row, col)),
views as (select n_nationkey::bigint as view, 80 + n_nationkey * 37 % 200 as budget, 1 + n_nationkey % 3 as level from nation),
l0 as materialized (select view, budget, level, row, col, error from views join tree using (level))"""
    for k in range(_ROUNDS):
        out += f""",
s{k} as materialized (select l.view, budget, level, row, col, l.error, row_number() over o as place, sum(kids - 1) over o - (budget - (select count(*) from l{k} x where x.view = l.view)) as unit
  from l{k} l join tree t using (level, row, col) where l.error > {_TARGET} and kids > 0 window o as (partition by l.view order by l.error desc, level, row, col)),
g{k} as materialized (select view, p.level, p.row, p.col, p.error as merged, row_number() over o as donor, sum(n - 1) over o as freed, n - 1 as gain
  from (select view, level - 1 as level, row >> 1 as row, col >> 1 as col, count(*) as n from l{k} where level > 0 group by all) join tree p using (level, row, col) where n = kids and n > 1 window o as (partition by view order by p.error, p.level, p.row, p.col)),
p{k} as materialized (select s.*, g.donor, coalesce(s.unit <= 0 or (merged <= {_TARGET} and s.error > {_TARGET}) or merged < {exchange.FAIR} * s.error, false) as fine
  from s{k} s left join g{k} g on g.view = s.view and s.unit > freed - gain and s.unit <= freed),
d{k} as materialized (select * from p{k} p where place < coalesce((select min(place) from p{k} x where x.view = p.view and not fine), 1e18)),
m{k} as materialized (select view, level, row, col from g{k} g where donor <= (select max(donor) from d{k} d where d.view = g.view and d.unit > 0)),
l{k + 1} as materialized (
  select * from l{k} l where not exists (select 1 from d{k} d where d.view = l.view and d.level = l.level and d.row = l.row and d.col = l.col) and not exists (select 1 from m{k} m where m.view = l.view and m.level = l.level - 1 and m.row = l.row >> 1 and m.col = l.col >> 1)
  union all select d.view, d.budget, t.level, t.row, t.col, t.error from d{k} d join tree t on t.level = d.level + 1 and t.row >> 1 = d.row and t.col >> 1 = d.col
  union all select m.view, (select any_value(budget) from l{k} x where x.view = m.view), t.level, t.row, t.col, t.error from m{k} m join tree t using (level, row, col))"""
    return out + f" select view, level, row, col, error from l{_ROUNDS}"


@query("exchanged_cut", _sql())
def exchanged_cut(spark: SparkSession, folder: str) -> DataFrame:
    """For each view the leaves after five rounds of splits, paid by merges elsewhere."""
    loops.ensure_checkpoint_dir(spark)
    tree = nodes(spark, folder).checkpoint()  # of as many nodes as the levels have at most; read several times a round
    return exchange.exchange(first_cuts(spark, folder, tree), tree, _TARGET, _ROUNDS).select("view", *exchange.NODE, "error")
