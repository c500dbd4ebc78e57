"""Queries of region measurement, admission under budgets, sequences and polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.catalog import query
from tilewright.operators import polygons, ranks
from tilewright.operators.cells import cover
from tilewright.sources.tables import CUSTOMERS_SQL, PARTS_SQL, customers, parts, table

# measured regions: uv boxes of a unit cell with a projection's depth row
_REGIONS = "(select l_orderkey * 8 + l_linenumber as id, (l_partkey % 97) / 100.0e0 as u0, (l_suppkey % 89) / 100.0e0 as v0, (l_partkey % 97) / 100.0e0 + 0.03e0 as u1, (l_suppkey % 89) / 100.0e0 + 0.05e0 as v1, l_extendedprice / 100 as density, l_quantity as bound, 0.5e0 + l_tax as w0, l_discount as wu, -l_tax / 2 as wv from lineitem)"


def regions(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    u, v = (F.col("l_partkey") % 97) / 100.0, (F.col("l_suppkey") % 89) / 100.0
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), u.alias("u0"), v.alias("v0"), (u + 0.03).alias("u1"), (v + 0.05).alias("v1"), (F.col("l_extendedprice") / 100).alias("density"),
        F.col("l_quantity").alias("bound"), (0.5 + F.col("l_tax")).alias("w0"), F.col("l_discount").alias("wu"), (-F.col("l_tax") / 2).alias("wv"),
    )


@query(
    "tile_region_errors",
    f"""with c as (select x, y, x / 8.0e0 as a0, y / 8.0e0 as b0, (x + 1) / 8.0e0 as a1, (y + 1) / 8.0e0 as b1 from (select unnest(range(8))::int as x), (select unnest(range(8))::int as y)),
j as (select x, y, density, bound, w0 + least(wu * greatest(a0, u0), wu * least(a1, u1)) + least(wv * greatest(b0, v0), wv * least(b1, v1)) as w from c join {_REGIONS} on a0 < u1 and a1 > u0 and b0 < v1 and b1 > v0)
select x, y, count(*) as regions, round(max(case when w > 0 then least(density, bound / (w * w)) else density end) / 256, 9) as error from j group by x, y""",
)
def tile_region_errors(spark: SparkSession, folder: str) -> DataFrame:
    """The worst bound of the pixel error that any measured region gives each cell of a
    tile; boxes that only touch don't count."""
    rows = cover(regions(spark, folder), 0.125, ("u0", "v0", "u1", "v1")).where("cell_x between 0 and 7 and cell_y between 0 and 7")
    a0, b0 = F.col("cell_x") / 8.0, F.col("cell_y") / 8.0
    a1, b1 = (F.col("cell_x") + 1) / 8.0, (F.col("cell_y") + 1) / 8.0
    inside = rows.where((a0 < F.col("u1")) & (a1 > F.col("u0")) & (b0 < F.col("v1")) & (b1 > F.col("v0")))
    w = F.col("w0") + F.least(F.col("wu") * F.greatest(a0, F.col("u0")), F.col("wu") * F.least(a1, F.col("u1"))) + F.least(F.col("wv") * F.greatest(b0, F.col("v0")), F.col("wv") * F.least(b1, F.col("v1")))
    error = F.when(w > 0, F.least(F.col("density"), F.col("bound") / (w * w))).otherwise(F.col("density"))
    return inside.groupBy(F.col("cell_x").cast("int").alias("x"), F.col("cell_y").cast("int").alias("y")).agg(F.count("*").alias("regions"), F.round(F.max(error) / 256, 9).alias("error"))


@query("valid_regions", f"select id, u0 <= u1 and v0 <= v1 and density >= 0 and isfinite(w0) as valid from {_REGIONS}")
def valid_regions(spark: SparkSession, folder: str) -> DataFrame:
    fine = (F.col("u0") <= F.col("u1")) & (F.col("v0") <= F.col("v1")) & (F.col("density") >= 0) & ~F.isnan("w0") & (F.abs("w0") < float("inf"))
    return regions(spark, folder).select("id", fine.alias("valid"))


@query("compacted_regions", "select l_partkey % 97 as u, l_suppkey % 89 as v, count(*) as copies, max(l_extendedprice) as density from lineitem group by all")
def compacted_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Regions with equal boxes as one, with their highest density."""
    li = table(spark, folder, "lineitem")
    return li.groupBy((F.col("l_partkey") % 97).alias("u"), (F.col("l_suppkey") % 89).alias("v")).agg(F.count("*").alias("copies"), F.max("l_extendedprice").alias("density"))


@query(
    "admitted_splits",
    "with s as (select o_custkey as view, o_orderkey as split, o_totalprice as error, (o_orderkey % 64 + 1) * 1024 as bytes from orders), r as (select *, sum(bytes) over (partition by view order by error desc, split rows unbounded preceding)::bigint as total from s) select view, split, total from r where total <= 131072",
)
def admitted_splits(spark: SparkSession, folder: str) -> DataFrame:
    """For each view the splits of the worst errors that fit a budget of bytes."""
    o = F.col("o_orderkey")
    s = table(spark, folder, "orders").select(F.col("o_custkey").alias("view"), o.alias("split"), F.col("o_totalprice").alias("error"), ((o % 64 + 1) * 1024).alias("bytes"))
    w = Window.partitionBy("view").orderBy(F.desc("error"), "split").rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumn("total", F.sum("bytes").over(w)).where("total <= 131072").select("view", "split", "total")


@query("replacement_order", "with g as (select l_suppkey as grp, sum(l_quantity) filter (l_linestatus = 'F') as before, sum(l_quantity) filter (l_linestatus = 'O') as after from lineitem group by l_suppkey) select grp, row_number() over (order by coalesce(after, 0) < coalesce(before, 0) desc, coalesce(after, 0), grp)::int as place from g")
def replacement_order(spark: SparkSession, folder: str) -> DataFrame:
    """Groups to replace: those that shrink first, then cheaper ones, then by number.
    One row a supplier is ordered; the counts of all rows are summed before."""
    li = table(spark, folder, "lineitem")
    g = li.groupBy(F.col("l_suppkey").alias("grp")).agg(F.coalesce(F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))), F.lit(0.0)).alias("before"), F.coalesce(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))), F.lit(0.0)).alias("after"))
    rows = g.select("grp", (F.col("after") >= F.col("before")).alias("grows"), "after")
    return ranks.placed(rows, [], ["grows", "after", "grp"]).select("grp", F.col("place").cast("int").alias("place"))


@query("uniform_cut", "select level, (1 << level)::bigint * 4 * (1 << level) * 2 as nodes from (select unnest(range(6))::int as level)")
def uniform_cut(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of each level of a cut refined everywhere, by generations of children."""
    pair = F.sequence(F.lit(0), F.lit(1))
    now = spark.range(8).select(F.lit(0).alias("level"), F.floor(F.col("id") / 4).alias("row"), (F.col("id") % 4).alias("col"))
    out = now
    for level in range(1, 6):
        now = now.withColumn("dy", F.explode(pair)).withColumn("dx", F.explode(pair)).select(F.lit(level).alias("level"), (F.col("row") * 2 + F.col("dy")).alias("row"), (F.col("col") * 2 + F.col("dx")).alias("col"))
        out = out.union(now)
    return out.groupBy("level").agg(F.count("*").alias("nodes"))


@query("halton_points", "select id, round(list_sum([((id // (2 ** d)::bigint) % 2) / 2.0e0 ** (d + 1) for d in range(20)]), 12) as x, round(list_sum([((id // (3 ** d)::bigint) % 3) / 3.0e0 ** (d + 1) for d in range(13)]), 12) as y from (select p_partkey as id from part)")
def halton_points(spark: SparkSession, folder: str) -> DataFrame:
    """The Halton sequence in bases 2 and 3."""

    def radical(base: int, digits: int):
        out = F.lit(0.0)
        for d in range(digits):
            out = out + (F.expr(f"id div {base**d}") % base) / float(base) ** (d + 1)
        return F.round(out, 12)

    return table(spark, folder, "part").select(F.col("p_partkey").alias("id")).select("id", radical(2, 20).alias("x"), radical(3, 13).alias("y"))


@query("interval_products", f"with i as (select id, lon as alo, lon + h / 1000 as ahi, lat as blo, lat + 2 as bhi from {CUSTOMERS_SQL}) select id, alo + blo as sum_lo, ahi + bhi as sum_hi, least(alo * blo, alo * bhi, ahi * blo, ahi * bhi) as product_lo, greatest(alo * blo, alo * bhi, ahi * blo, ahi * bhi) as product_hi from i")
def interval_products(spark: SparkSession, folder: str) -> DataFrame:
    """Interval sums and products (without directed rounding)."""
    i = customers(spark, folder).select("id", F.col("lon").alias("alo"), (F.col("lon") + F.col("h") / 1000).alias("ahi"), F.col("lat").alias("blo"), (F.col("lat") + 2).alias("bhi"))
    p = [F.col(a) * F.col(b) for a in ("alo", "ahi") for b in ("blo", "bhi")]
    return i.select("id", (F.col("alo") + F.col("blo")).alias("sum_lo"), (F.col("ahi") + F.col("bhi")).alias("sum_hi"), F.least(*p).alias("product_lo"), F.greatest(*p).alias("product_hi"))


_DIAMOND = ((-120.0, 0.0), (0.0, -60.0), (120.0, 0.0), (0.0, 60.0))


@query("points_in_polygon", "select id from " + PARTS_SQL + " where " + " and ".join(f"({bx - ax}::double * (lat - ({ay})) - ({by - ay})::double * (lon - ({ax})) >= 0)" for (ax, ay), (bx, by) in zip(_DIAMOND, _DIAMOND[1:] + _DIAMOND[:1], strict=True)))
def points_in_polygon(spark: SparkSession, folder: str) -> DataFrame:
    """Points inside a convex polygon given anticlockwise, edges included."""
    inside = F.lit(True)
    for (ax, ay), (bx, by) in zip(_DIAMOND, _DIAMOND[1:] + _DIAMOND[:1], strict=True):
        inside = inside & ((bx - ax) * (F.col("lat") - ay) - (by - ay) * (F.col("lon") - ax) >= 0)
    return parts(spark, folder).where(inside).select("id")


@query("segment_distances", "select c.id, round(sqrt(pow(c.lon - (p.lon + t * 10), 2) + pow(c.lat - p.lat, 2)), 6) as distance from (select c.id, greatest(0.0e0, least(1.0e0, (c.lon - p.lon) / 10)) as t from " + CUSTOMERS_SQL + " c join " + PARTS_SQL + " p on p.id = c.id) x join " + CUSTOMERS_SQL + " c on c.id = x.id join " + PARTS_SQL + " p on p.id = x.id")
def segment_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Distance of a point from a segment of ten degrees eastwards."""
    c = customers(spark, folder).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    both = c.join(parts(spark, folder).select("id", "lon", "lat"), "id")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("x") - F.col("lon")) / 10))
    return both.select("id", F.round(F.sqrt(F.pow(F.col("x") - (F.col("lon") + t * 10), F.lit(2.0)) + F.pow(F.col("y") - F.col("lat"), F.lit(2.0))), 6).alias("distance"))


@query("hulls")
def hulls(spark: SparkSession, folder: str) -> DataFrame:
    """Convex hulls of the customers of each segment."""
    named = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    points = customers(spark, folder).join(named, "id").select("segment", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return polygons.convex_hulls(points, "segment")


@query("source_levels", "with t as (select s_suppkey as id, (s_suppkey % 40 + 1) / 40.0e0 as size from supplier), l as (select id, size, l, 1.40625e0 / (1 << l) as px from t, (select unnest(range(12))::int as l)) select id, min(l) filter (px <= size)::int as finer, arg_min(l, struct_pack(d := abs(px - size), l := l))::int as nearest from l group by id")
def source_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Levels for source tiles by the size of their pixels: the first that is as fine, and the nearest."""
    s = F.col("s_suppkey")
    rows = table(spark, folder, "supplier").select(s.alias("id"), ((s % 40 + 1) / 40.0).alias("size"))
    levels = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda n: F.struct((1.40625 / F.pow(F.lit(2.0), n)).alias("px"), n.alias("l")))
    fine = F.get(F.filter(levels, lambda p: p["px"] <= F.col("size")), F.lit(0))["l"]
    near = F.array_min(F.transform(levels, lambda p: F.struct(F.abs(p["px"] - F.col("size")).alias("d"), p["l"].alias("l"))))["l"]
    return rows.select("id", fine.alias("finer"), near.alias("nearest"))
