"""Queries of height hierarchies, error-bounded cuts, meshes and tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.catalog import query
from tilewright.functions.bits import right
from tilewright.operators import covering, lifting
from tilewright.sources.tables import CUSTOMERS_SQL, LAT_SQL, LON_SQL, customers, latitude, longitude, table

_N = 8


def patches(spark: SparkSession, folder: str) -> DataFrame:
    """A patch of heights per customer: corners on even places, centres on odd ones."""
    c = F.col("c_custkey")

    def heights(n: int, odd: int) -> Column:
        # place by place: lambdas over a sequence aren't compiled
        return F.array(*(((i * 2 + odd) * (c % 31 + 3) + (j * 2 + odd) * (c % 17 + 5) + (i * j * c) % 97).cast("long") for i in range(n) for j in range(n)))

    spread = table(spark, folder, "customer").select("c_custkey").repartition("c_custkey")  # a row becomes 145 heights
    return spread.select(c.alias("patch"), heights(_N + 1, 0).alias("corners"), heights(_N, 1).alias("centres"))


def _round(v: str, divisor: int) -> str:
    return f"(case when {v} > 0 then ({v} + {divisor // 2}) // {divisor} else -((-({v}) + {divisor // 2}) // {divisor}) end)"


def _at(name: str, width: int, i: str, j: str) -> str:
    return f"{name}[({i}) * {width} + ({j}) + 1]"


def _predicted(name: str) -> str:
    """SQL of a centre (i, j) from a list of corners: as in the operator, but place by place."""
    near = "(" + " + ".join(_at(name, 9, f"i + {a}", f"j + {b}") for a in (0, 1) for b in (0, 1)) + ")"
    ring = "(" + " + ".join(_at(name, 9, f"i + {a}", f"j + {b}") for a, b in ((-1, 0), (-1, 1), (0, -1), (1, -1), (0, 2), (1, 2), (2, 0), (2, 1))) + ")"
    return f"case when i between 1 and 6 and j between 1 and 6 then {_round(f'(10 * {near} - {ring})', 32)} else {_round(near, 4)} end"


def _gains(name: str) -> str:
    """SQL of what a corner (i, j) gains from a list of details."""
    four = "(" + " + ".join(_at(name, 8, f"i - {a}", f"j - {b}") for a in (0, 1) for b in (0, 1)) + ")"
    return f"case when i between 1 and 7 and j between 1 and 7 then {_round(four, 8)} else 0 end"


def _grid(name: str, width: int, value: str, source: str) -> str:
    keep = ", ".join(("corners", "centres", "details", "low", "codes", "back", "given", "centres_given")[: {"corners": 0, "centres": 1, "details": 2, "low": 3, "codes": 4, "back": 5, "given": 6, "centres_given": 7}[name]])
    return f"select patch{', ' if keep else ''}{keep}, list({value} order by i, j) as {name} from {source}, (select unnest(range({width})) as i), (select unnest(range({width})) as j) group by patch{', ' if keep else ''}{keep}"


_C = "patch % 31 + 3"
_STEPS = [
    ("corners", 9, f"2 * i * ({_C}) + 2 * j * (patch % 17 + 5) + i * j * patch % 97"), ("centres", 8, f"(2 * i + 1) * ({_C}) + (2 * j + 1) * (patch % 17 + 5) + i * j * patch % 97"),
    ("details", 8, f"{_at('centres', 8, 'i', 'j')} - {_predicted('corners')}"), ("low", 9, f"{_at('corners', 9, 'i', 'j')} + {_gains('details')}"),
    ("codes", 8, _round(_at("details", 8, "i", "j"), 5)), ("back", 8, f"{_at('codes', 8, 'i', 'j')} * 5"),
    ("given", 9, f"{_at('low', 9, 'i', 'j')} - {_gains('back')}"), ("centres_given", 8, f"{_at('back', 8, 'i', 'j')} + {_predicted('given')}"),
]
_LIFT_SQL = "with p as (select c_custkey as patch from customer)" + "".join(f", s{k} as ({_grid(name, width, value, f's{k - 1}' if k else 'p')})" for k, (name, width, value) in enumerate(_STEPS))


def _weighed(values: str) -> Column:
    """The sum of an array's values, each times its place from 1."""
    return F.aggregate(F.transform(values, lambda v, k: v * (k + 1)), F.lit(0).cast("long"), lambda s, v: s + v)


@query("lifted_patches", _LIFT_SQL + " select patch, list_sum(list_transform(range(1, 82), lambda k: low[k] * k))::bigint as low, list_sum(list_transform(range(1, 65), lambda k: details[k] * k))::bigint as details, 0::bigint as error from s3")
def lifted_patches(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the low part and of the details of each patch; lossless lifting gives it back without error."""
    rows = lifting.lift_patches(patches(spark, folder))
    return rows.select("patch", _weighed("low").alias("low"), _weighed("codes").alias("details"), "error")


@query("lifted_details", _LIFT_SQL + " select patch, list_sum(list_transform(codes, lambda v: v * v))::bigint as energy, greatest(list_max(list_transform(range(1, 82), lambda k: abs(given[k] - corners[k]))), list_max(list_transform(range(1, 65), lambda k: abs(centres_given[k] - centres[k]))))::bigint as error from s7")
def lifted_details(spark: SparkSession, folder: str) -> DataFrame:
    """Energy of the details and the largest error under a tolerance of two."""
    rows = lifting.lift_patches(patches(spark, folder), tolerance=2)
    return rows.select("patch", F.aggregate("codes", F.lit(0).cast("long"), lambda s, v: s + v * v).alias("energy"), "error")


@query("patch_ranges", "with h as (select c_custkey as patch, ((k // 9) * 2 * (c_custkey % 31 + 3) + (k % 9 * 2) * (c_custkey % 17 + 5) + ((k // 9) * (k % 9) * c_custkey) % 97) as v from customer, (select unnest(range(81)) as k)) select patch, min(v) as lowest, max(v) as highest from h group by patch")
def patch_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return patches(spark, folder).select("patch", F.array_min("corners").alias("lowest"), F.array_max("corners").alias("highest"))


_LEAF, _TARGET = 8, 0.05
_ERRORS = f"(select l as level, floor((90 - lat) / (180.0e0 / (2 << l)))::int as row, floor((lon + 180) / (360.0e0 / (4 << l)))::int as col, max(abs(weight)) / 1000.0e0 / (1 << l) as error from (select id, least(lon, 179.9999e0) as lon, greatest(lat, -89.9999e0) as lat, weight from {CUSTOMERS_SQL}), (select unnest(range({_LEAF} + 1))::int as l) group by 1, 2, 3, l)"


@query(
    "error_bounded_cut",
    f"""with recursive e as (select * from {_ERRORS}),
cut as (select level, row, col, error from e where level = 0 union all select k.level, k.row, k.col, k.error from cut c join e k on k.level = c.level + 1 and (k.row >> 1) = c.row and (k.col >> 1) = c.col where c.error > {_TARGET}::double and c.level < {_LEAF})
select level, row, col, error from cut where error <= {_TARGET}::double or level = {_LEAF}""",
)
def error_bounded_cut(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves of the coarsest cut whose error is within a target.  A node's error only
    falls from parent to child, so a node is split exactly if its own error is too
    large: one grouping over all levels gives the cut without a loop."""
    rows = customers(spark, folder).select(F.least("lon", F.lit(179.9999)).alias("lon"), F.greatest("lat", F.lit(-89.9999)).alias("lat"), "weight", F.explode(F.sequence(F.lit(0), F.lit(_LEAF))).alias("level"))
    two = F.pow(F.lit(2.0), "level")
    row, col = F.floor((90 - F.col("lat")) / (90.0 / two)).cast("int"), F.floor((F.col("lon") + 180) / (90.0 / two)).cast("int")
    errors = rows.groupBy("level", row.alias("row"), col.alias("col")).agg((F.max(F.abs("weight")) / 1000 / F.first(two)).alias("error"))
    split = errors.where((F.col("error") > _TARGET) & (F.col("level") < _LEAF)).select((F.col("level") + 1).alias("level"), F.col("row").alias("p_row"), F.col("col").alias("p_col"))
    final = errors.where((F.col("error") <= _TARGET) | (F.col("level") == _LEAF)).withColumn("p_row", right(F.col("row"), 1)).withColumn("p_col", right(F.col("col"), 1))
    below = final.where("level > 0").join(split, ["level", "p_row", "p_col"], "left_semi")
    return final.where("level = 0").select("level", "row", "col", "error").union(below.select("level", "row", "col", "error"))


@query(
    "leaf_counts",
    f"""with recursive e as (select * from {_ERRORS}),
cut as (select level, row, col, error from e where level = 0 union all select k.level, k.row, k.col, k.error from cut c join e k on k.level = c.level + 1 and (k.row >> 1) = c.row and (k.col >> 1) = c.col where c.error > {_TARGET}::double and c.level < {_LEAF})
select level, count(*) as leaves from cut where error <= {_TARGET}::double or level = {_LEAF} group by level""",
)
def leaf_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves of the error-bounded cut on each level."""
    return error_bounded_cut(spark, folder).groupBy("level").agg(F.count("*").alias("leaves"))


# a mesh: two triangles per part on a strip of vertices

def triangles(spark: SparkSession, folder: str) -> DataFrame:
    """(triangle, a, b, c): strips of twenty vertices a row, two triangles a cell."""
    p = F.col("p_partkey")
    two = F.array(F.struct(p.alias("a"), (p + 1).alias("b"), (p + 20).alias("c"), (p * 2).alias("t")), F.struct((p + 1).alias("a"), (p + 21).alias("b"), (p + 20).alias("c"), (p * 2 + 1).alias("t")))
    return table(spark, folder, "part").where("p_partkey % 20 <> 0").select(F.explode(two).alias("x")).select(F.col("x.t").alias("triangle"), "x.a", "x.b", "x.c")


_TRI = "(select p_partkey * 2 as triangle, p_partkey as a, p_partkey + 1 as b, p_partkey + 20 as c from part where p_partkey % 20 <> 0 union all select p_partkey * 2 + 1, p_partkey + 1, p_partkey + 21, p_partkey + 20 from part where p_partkey % 20 <> 0)"


@query("mesh_edges", f"with e as (select triangle, unnest([least(a, b), least(b, c), least(c, a)]) as u, unnest([greatest(a, b), greatest(b, c), greatest(c, a)]) as v from {_TRI}) select u, v, count(*) as faces, count(*) = 1 as boundary from e group by u, v")
def mesh_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Undirected edges, how many triangles share each, and which are boundary."""
    pairs = [("a", "b"), ("b", "c"), ("c", "a")]
    e = triangles(spark, folder).select(F.explode(F.array(*[F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")) for x, y in pairs])).alias("e"))
    return e.groupBy("e.u", "e.v").agg(F.count("*").alias("faces")).withColumn("boundary", F.col("faces") == 1)


@query("clustered_mesh", f"select distinct least(x, y, z) as a, x + y + z - least(x, y, z) - greatest(x, y, z) as b, greatest(x, y, z) as c from (select a // 3 as x, b // 3 as y, c // 3 as z from {_TRI}) where x <> y and y <> z and x <> z")
def clustered_mesh(spark: SparkSession, folder: str) -> DataFrame:
    """Triangles after vertices were clustered by threes: collapsed ones go, equal ones merge."""
    x, y, z = (F.expr(f"{v} div 3") for v in "abc")
    rows = triangles(spark, folder).select(x.alias("x"), y.alias("y"), z.alias("z")).where("x <> y and y <> z and x <> z")
    return rows.select(F.least("x", "y", "z").alias("a"), (F.col("x") + F.col("y") + F.col("z") - F.least("x", "y", "z") - F.greatest("x", "y", "z")).alias("b"), F.greatest("x", "y", "z").alias("c")).distinct()


@query(
    "ray_hits",
    f"""with s as (select s_suppkey as ray, {LON_SQL.format(k='s_suppkey')} as x, {LAT_SQL.format(k='s_suppkey')} as y from supplier), t as (select id, lon as ax, lat as ay, lon + 4 as bx, lat as by, lon as cx, lat + 4 as cy, h as ah, h + 100 as bh, h + 50 as ch from {CUSTOMERS_SQL}),
q as (select ray, id, (x - ax) / 4 as u, (y - ay) / 4 as v, ah, bh, ch from s join t on x >= ax and x <= bx and y >= ay and y <= cy)
select ray, id, round(ah + u * (bh - ah) + v * (ch - ah), 6) as h from q where u >= -1e-8::double and v >= -1e-8::double and u + v <= 1 + 1e-8::double qualify row_number() over (partition by ray order by ah + u * (bh - ah) + v * (ch - ah) desc, id) = 1""",
)
def ray_hits(spark: SparkSession, folder: str) -> DataFrame:
    """The first triangle that a ray from above meets: cells bring rays and triangles
    together that may be on top, barycentric coordinates decide, the highest hit is kept."""
    s = F.col("s_suppkey")
    rays = table(spark, folder, "supplier").select(s.alias("ray"), longitude(s).alias("lon"), latitude(s).alias("lat"))
    tri = customers(spark, folder).select("id", F.col("lon").alias("ax"), F.col("lat").alias("ay"), F.col("h").alias("ah"))
    boxes = tri.select("*", F.col("ax").alias("west"), F.col("ay").alias("south"), (F.col("ax") + 4).alias("east"), (F.col("ay") + 4).alias("north"))

    def bounds(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column, Column]:
        top = F.col("ah") + F.least((x1 - F.col("ax")) / 4, F.lit(1.0)) * 100 + F.least((y1 - F.col("ay")) / 4, F.lit(1.0)) * 50
        low = F.col("ah") + F.greatest((x0 - F.col("ax")) / 4, F.lit(0.0)) * 100 + F.greatest((y0 - F.col("ay")) / 4, F.lit(0.0)) * 50
        whole = covering.inside(x0, y0, x1, y1, within=1e-9) & ((x1 - F.col("ax")) / 4 + (y1 - F.col("ay")) / 4 <= 1)
        return whole, -top - 1e-3, -low + 1e-3

    hit = covering.candidates(rays, boxes, "id", 1.0, 2, bounds).where("lon >= west and lon <= east and lat >= south and lat <= north")
    hit = hit.withColumn("u", (F.col("lon") - F.col("ax")) / 4).withColumn("u", (F.col("lon") - F.col("ax")) / 4).withColumn("v", (F.col("lat") - F.col("ay")) / 4)
    inside = hit.where((F.col("u") >= -1e-8) & (F.col("v") >= -1e-8) & (F.col("u") + F.col("v") <= 1 + 1e-8))
    height = F.col("ah") + F.col("u") * 100 + F.col("v") * 50
    best = inside.groupBy("ray").agg(F.max(F.struct(height.alias("h"), (-F.col("id")).alias("n"))).alias("best"))
    return best.select("ray", (-F.col("best.n")).alias("id"), F.round("best.h", 6).alias("h"))


@query(
    "track_values",
    """with k as (select o_custkey as track, date_diff('day', date '1990-01-01', o_orderdate::date) as t, avg(o_totalprice) as v from orders group by all),
s as (select track, t, v, lead(t) over w as t2, lead(v) over w as v2, row_number() over w as n from k window w as (partition by track order by t)),
q as (select distinct track, 2000 as day from k)
select q.track, round(case when t > day then v when t2 is null or t = day then v else v + (v2 - v) * (day - t) / (t2 - t) end, 4) as value from q join s on s.track = q.track and ((t <= day and (t2 is null or t2 > day)) or (n = 1 and t > day))""",
)
def track_values(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer's price track at day 2000: linear between its knots, held outside."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.to_date(F.lit("1990-01-01")))
    knots = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("track"), day.alias("t")).agg(F.avg("o_totalprice").alias("v"))
    w = Window.partitionBy("track").orderBy("t")
    spans = knots.select("track", "t", "v", F.lead("t").over(w).alias("t2"), F.lead("v").over(w).alias("v2"), F.row_number().over(w).alias("n"))
    hit = spans.where("(t <= 2000 and (t2 is null or t2 > 2000)) or (n = 1 and t > 2000)")
    line = F.col("v") + (F.col("v2") - F.col("v")) * (2000 - F.col("t")) / (F.col("t2") - F.col("t"))
    return hit.select("track", F.round(F.when(F.expr("t > 2000 or t2 is null or t = 2000"), F.col("v")).otherwise(line), 4).alias("value"))


@query("triangle_heights", f"with p as (select id, (lon + 180) / 360 as u, (lat + 90) / 180 as v0 from {CUSTOMERS_SQL}), q as (select id, u * 16 * (1 - v0 / 2) as px, v0 * 16 * 0.5e0 as py from p), c as (select id, px, py, floor(px)::int as x, floor(py)::int as y from q) select id, round((1 - (px - x) - (py - y)) * (x * 7 + y * 3) + (px - x) * ((x + 1) * 7 + y * 3) + (py - y) * (x * 7 + (y + 1) * 3), 6) as height from c")
def triangle_heights(spark: SparkSession, folder: str) -> DataFrame:
    """Linear interpolation inside the half cell of a triangular patch that a point falls in."""
    v0 = (F.col("lat") + 90) / 180
    rows = customers(spark, folder).select("id", ((F.col("lon") + 180) / 360 * 16 * (1 - v0 / 2)).alias("px"), (v0 * 16 * 0.5).alias("py"))
    x, y = F.floor("px"), F.floor("py")
    dx, dy = F.col("px") - x, F.col("py") - y

    def at(i, j):
        return i * 7 + j * 3

    lower = (1 - dx - dy) * at(x, y) + dx * at(x + 1, y) + dy * at(x, y + 1)
    upper = (dx + dy - 1) * at(x + 1, y + 1) + (1 - dy) * at(x + 1, y) + (1 - dx) * at(x, y + 1)
    return rows.select("id", F.round(F.when(dx + dy <= 1, lower).otherwise(upper), 6).alias("height"))
