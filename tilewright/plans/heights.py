"""Queries of height requests: what they depend on, and how far down they can be answered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.catalog import query
from tilewright.operators import diamonds
from tilewright.sources.tables import CUSTOMERS_SQL, customers

_HALF, _DEEPEST = 32, 9
_SAMPLES, _SIDE = 32, 1_000_000.0
_GAP = "(x * 7 + y * 13 + level * 5) % 61 = 0"

_SQL = f"""with recursive p as (select id, (lon + 180) / 360.0e0 * {2 * _HALF} as px, (lat + 90) / 180.0e0 * {2 * _HALF} as py, unnest(range({_DEEPEST} + 1))::int as level from {CUSTOMERS_SQL}),
c as (select *, ({_HALF} >> (level >> 1)) as s from p),
d as (select *, (greatest(0, least(floor(px / (2 * s)), {_HALF} // s - 1)) * 2 + 1) * s as cx, (greatest(0, least(floor(py / (2 * s)), {_HALF} // s - 1)) * 2 + 1) * s as cy from c),
located as (select id, level, (cx + case when level % 2 = 1 and abs(px - cx) >= abs(py - cy) then case when px < cx then -s else s end else 0 end)::bigint as x, (cy + case when level % 2 = 1 and abs(px - cx) < abs(py - cy) then case when py < cy then -s else s end else 0 end)::bigint as y from d),
need as (select distinct level, x, y from located
  union select n.level - 1, n.x + a * ({_HALF} >> (n.level >> 1)), n.y + b * ({_HALF} >> (n.level >> 1)) from need n, (select distinct * from (select unnest([-1, 0, 1]) as a), (select unnest([-1, 0, 1]) as b)) o
  where n.level > 0 and n.x + a * ({_HALF} >> (n.level >> 1)) between 0 and {2 * _HALF} and n.y + b * ({_HALF} >> (n.level >> 1)) between 0 and {2 * _HALF}
  and case when n.level % 2 = 1 then abs(a) + abs(b) = 1 and ((n.x + a * ({_HALF} >> (n.level >> 1))) // ({_HALF} >> (n.level >> 1))) % 2 = 1 and ((n.y + b * ({_HALF} >> (n.level >> 1))) // ({_HALF} >> (n.level >> 1))) % 2 = 1
    else abs(a) + abs(b) = 2 and ((n.x + a * ({_HALF} >> (n.level >> 1))) // ({_HALF} >> ((n.level - 1) >> 1)) + (n.y + b * ({_HALF} >> (n.level >> 1))) // ({_HALF} >> ((n.level - 1) >> 1))) % 2 = 1 end)"""


def located(spark: SparkSession, folder: str) -> DataFrame:
    """(id, level, x, y): the diamond of each level that holds a customer."""
    level = F.col("level")
    px, py = (F.col("lon") + 180) / 360.0 * (2 * _HALF), (F.col("lat") + 90) / 180.0 * (2 * _HALF)
    rows = customers(spark, folder).select("id", px.alias("px"), py.alias("py"), F.explode(F.sequence(F.lit(0), F.lit(_DEEPEST))).alias("level"))
    x, y = diamonds.locate(level, F.col("px"), F.col("py"), _HALF)
    return rows.select("id", "level", x.alias("x"), y.alias("y"))


@query("height_dependencies", _SQL + " select level, x, y from need")
def height_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    """Every diamond that the customers' heights depend on: both parents of each, once."""
    return diamonds.needed(located(spark, folder).select("level", "x", "y").distinct(), _HALF, _DEEPEST)


_ANSWERS_SQL = (
    _SQL
    + f""", edges as (select distinct c.level, c.x, c.y, p.x as up_x, p.y as up_y from need c join need p on p.level = c.level - 1
  and case when c.level % 2 = 1 then abs(c.x - p.x) + abs(c.y - p.y) = ({_HALF} >> (c.level >> 1)) else abs(c.x - p.x) = ({_HALF} >> (c.level >> 1)) and abs(c.y - p.y) = ({_HALF} >> (c.level >> 1)) end),
stopped as (select level, x, y from need where {_GAP} union select e.level, e.x, e.y from edges e join stopped s on s.level = e.level - 1 and s.x = e.up_x and s.y = e.up_y),
open as (select id, max(l.level) as shown from located l left join stopped s using (level, x, y) where s.level is null group by id),
r as (select c.id, shown, (50 << (c.id % 14)::int)::double as wanted from {CUSTOMERS_SQL} c left join open using (id))
select id, shown, round({_SIDE}::double / pow(2, shown / 2.0e0) / {_SAMPLES}, 3) as spacing, case when shown is null then 'unavailable' when {_SIDE}::double / pow(2, shown / 2.0e0) / {_SAMPLES} <= wanted then 'ready' else 'limited' end as state from r"""
)


@query("height_answers", _ANSWERS_SQL)
def height_answers(spark: SparkSession, folder: str) -> DataFrame:
    """How far down each height request can be answered: a diamond counts only if it and
    all that it depends on have records.  Ready if the spacing reached is as fine as
    wanted, limited if it is coarser, unavailable if there isn't even a root."""
    at = located(spark, folder)
    nodes = diamonds.needed(at.select("level", "x", "y").distinct(), _HALF, _DEEPEST)
    stopped = diamonds.blocked(nodes, F.expr(_GAP), _HALF, _DEEPEST)
    shown = at.join(stopped, diamonds.KEY, "left_anti").groupBy("id").agg(F.max("level").alias("shown"))
    spacing = _SIDE / F.pow(F.lit(2.0), F.col("shown") / 2.0) / _SAMPLES
    wanted = 50.0 * F.pow(F.lit(2.0), F.col("id") % 14)
    state = F.when(F.col("shown").isNull(), "unavailable").when(spacing <= wanted, "ready").otherwise("limited")
    return customers(spark, folder).select("id").join(shown, "id", "left").select("id", "shown", F.round(spacing, 3).alias("spacing"), state.alias("state"))
