"""Queries of rays, record framing, root patches and changed groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.catalog import query
from tilewright.functions import geo, rays
from tilewright.operators import blocks, loops
from tilewright.operators.cells import cell, cover
from tilewright.sources.tables import CUSTOMERS_SQL, customers, latitude, longitude, table

R = geo.RADIUS
_RAY = f"(select id, sin(radians(lon)) * cos(radians(lat)) * 2 * {R} as ox, sin(radians(lat)) * 2 * {R} as oy, cos(radians(lon)) * cos(radians(lat)) * 2 * {R} as oz, (id % 7 - 3) / 10.0e0 as tx, (id % 5 - 2) / 10.0e0 as ty from {CUSTOMERS_SQL})"
_DIR = f"(select id, ox, oy, oz, (-ox / (2 * {R}) + tx) / n as dx, (-oy / (2 * {R}) + ty) / n as dy, (-oz / (2 * {R})) / n as dz from (select *, sqrt((-ox / (2 * {R}) + tx) ** 2 + (-oy / (2 * {R}) + ty) ** 2 + (oz / (2 * {R})) ** 2) as n from {_RAY}))"


def looks(spark: SparkSession, folder: str) -> DataFrame:
    """(id, ox..oz, dx..dz): from two radii out, roughly towards the centre."""
    a, b = F.radians("lon"), F.radians("lat")
    o = (F.sin(a) * F.cos(b) * 2 * R, F.sin(b) * 2 * R, F.cos(a) * F.cos(b) * 2 * R)
    rows = customers(spark, folder).select("id", *[c.alias(n) for c, n in zip(o, ("ox", "oy", "oz"), strict=True)])
    tilt = ((F.col("id") % 7 - 3) / 10.0, (F.col("id") % 5 - 2) / 10.0, F.lit(0.0))
    raw = [-F.col(n) / (2 * R) + t for n, t in zip(("ox", "oy", "oz"), tilt, strict=True)]
    length = F.sqrt(sum((c * c for c in raw), F.lit(0.0)))
    return rows.select("*", *[(c / length).alias(n) for c, n in zip(raw, ("dx", "dy", "dz"), strict=True)])


def _vec(*names: str) -> rays.Vec:
    return tuple(F.col(n) for n in names)


_O, _D = ("ox", "oy", "oz"), ("dx", "dy", "dz")


@query("sphere_hits", f"with b as (select *, ox * dx + oy * dy + oz * dz as b from {_DIR}), d as (select *, b * b - (ox * ox + oy * oy + oz * oz - {R * R!r}::double) as d from b) select id, case when d >= 0 and -b - sqrt(d) >= 0 then round(-b - sqrt(d), 2) end as distance from d")
def sphere_hits(spark: SparkSession, folder: str) -> DataFrame:
    return looks(spark, folder).select("id", F.round(rays.sphere(_vec(*_O), _vec(*_D), R), 2).alias("distance"))


_BOX = R / 3


@query("box_hits", f"select id, greatest(0.0e0, least((-{_BOX!r}::double - ox) / dx, ({_BOX!r}::double - ox) / dx), least((-{_BOX!r}::double - oy) / dy, ({_BOX!r}::double - oy) / dy), least((-{_BOX!r}::double - oz) / dz, ({_BOX!r}::double - oz) / dz)) <= least(greatest((-{_BOX!r}::double - ox) / dx, ({_BOX!r}::double - ox) / dx), greatest((-{_BOX!r}::double - oy) / dy, ({_BOX!r}::double - oy) / dy), greatest((-{_BOX!r}::double - oz) / dz, ({_BOX!r}::double - oz) / dz)) as hit from {_DIR} where abs(dx) > 1e-9 and abs(dy) > 1e-9 and abs(dz) > 1e-9")
def box_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Rays that meet a box round the centre."""
    side = tuple(F.lit(_BOX) for _ in range(3))
    rows = looks(spark, folder).where("abs(dx) > 1e-9 and abs(dy) > 1e-9 and abs(dz) > 1e-9")
    return rows.select("id", rays.box(_vec(*_O), _vec(*_D), tuple(-s for s in side), side).alias("hit"))



def triangle_candidates(ask: DataFrame, tri: DataFrame, size: float) -> DataFrame:
    """(ray, id): for downward rays (ray, lon, lat) those of the triangles (id, west, south,
    east, north, h; corners in the south-west, south-east and north-west) that each may meet
    first.  Of a cell's triangles only boxes that hold the ray count, and then those whose
    plane it meets as far out as it surely meets any, but for rounding."""
    loops.ensure_checkpoint_dir(ask.sparkSession)
    group = (F.col("cell_x") * (1 << 32) + F.col("cell_y")).alias("g")
    asks = ask.select((cell(F.col("lon"), size) * (1 << 32) + cell(F.col("lat"), size)).alias("g"), F.col("ray").alias("id"), F.array("lon", "lat").alias("v"))
    spread = tri.repartition(int(tri.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    members = cover(spread, size).select(group, "id", F.array("west", "south", "east", "north", "h").alias("v"))

    def place(lon: np.ndarray, lat: np.ndarray, r: np.ndarray | float) -> np.ndarray:
        a, b = np.radians(lon), np.radians(lat)
        return np.stack([np.sin(a) * np.cos(b) * r, np.sin(b) * r, np.cos(a) * np.cos(b) * r], axis=-1)

    def kernel(ids: np.ndarray, p: np.ndarray, names: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
        lon, lat, (west, south, east, north, h) = p[:, :1], p[:, 1:], t.T
        u = place(p[:, 0], p[:, 1], 1.0)
        a, b, c = place(west, south, R + h), place(east, south, R + h), place(west, north, R + h)
        normal = np.cross(b - a, c - a)
        # a ray to the centre cuts a plane into the shares of its corners
        shares = [u @ np.cross(v, w).T for v, w in ((b, c), (c, a), (a, b))]
        whole = u @ normal.T
        fine = np.abs(whole) > 0
        depth = np.where(fine, (a * normal).sum(axis=1) / np.where(fine, whole, 1), np.inf)
        least = np.minimum(np.minimum(shares[0], shares[1]), shares[2]) / np.where(fine, sum(shares), 1)
        held = (lon >= west) & (lon <= east) & (lat >= south) & (lat <= north)
        top = np.where(held & fine & (least > 1e-6), depth, -np.inf).max(axis=1)
        at, which = np.nonzero(held & ((least >= -1e-6) | ~fine) & (depth >= (top - 1.0)[:, None]))
        return ids[at], names[which]

    return blocks.meet(asks, members, kernel, "ray long, id long")


@query("triangle_hits")
def triangle_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Rays from above each supplier to the centre, and the nearest ground triangle that
    each meets: triangles go to the cells of their box, and few of a cell's are tried exactly."""
    s = F.col("s_suppkey")
    ask = table(spark, folder, "supplier").select(s.alias("ray"), longitude(s).alias("lon"), latitude(s).alias("lat"))
    tri = customers(spark, folder).where("lat < 80 and lat > -80 and lon < 175").select("id", F.col("lon").alias("west"), F.col("lat").alias("south"), (F.col("lon") + 4).alias("east"), (F.col("lat") + 4).alias("north"), "h")
    near = triangle_candidates(ask, tri, 5.0).join(ask, "ray").join(tri, "id")

    def at(lon: Column, lat: Column, h: Column) -> rays.Vec:
        return geo.xyz(lon, lat, h)

    rows = near.select("ray", "id", *[c.alias(f"{p}{k}") for p, v in (("o", at(F.col("lon"), F.col("lat"), F.lit(R))), ("a", at(F.col("west"), F.col("south"), F.col("h"))), ("b", at(F.col("east"), F.col("south"), F.col("h"))), ("c", at(F.col("west"), F.col("north"), F.col("h")))) for k, c in enumerate(v)])
    o, a, b, c = (tuple(F.col(f"{p}{k}") for k in range(3)) for p in "oabc")
    down = tuple(-x / (2 * R) for x in o)
    hits = rows.select("ray", "id", rays.triangle(o, down, a, b, c).alias("t")).where("t is not null")
    return hits.groupBy("ray").agg(F.min(F.struct("t", "id")).alias("best")).select("ray", "best.id", F.round("best.t", 2).alias("t"))


def little_endian(data: Column, at: Column | int) -> Column:
    """The unsigned 32-bit number at a byte position (from 0)."""
    at = F.lit(at) if isinstance(at, int) else at
    digits = F.concat(*[F.hex(F.substring(data, at + 4 - k, F.lit(1))) for k in range(4)])
    return F.conv(digits, 16, 10).cast("long")


@query("record_framing", "select p_partkey as key, length(p_name)::int as first_bytes, case when p_partkey % 4 = 0 then 0 else length(p_type) end::int as second_bytes, case when p_partkey % 9 = 0 then 'truncated' else 'ok' end as status from part")
def record_framing(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a length, a first fragment, and what is left as a second one; a length
    beyond the record is an error (every ninth is cut short)."""
    size = F.length("p_name")
    header = F.unhex(F.concat(*[F.lpad(F.hex(F.call_function("shiftright", size, F.lit(8 * k)).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)]))
    first, second = F.col("p_name").cast("binary"), F.when(F.col("p_partkey") % 4 == 0, F.lit("")).otherwise(F.col("p_type")).cast("binary")
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("key"), "p_name", "p_type", "p_partkey", F.concat(header, first, second).alias("record"))
    rows = rows.withColumn("record", F.when(F.col("key") % 9 == 0, F.substring("record", 1, 6)).otherwise(F.col("record")))
    n = little_endian(F.col("record"), 0)
    short = F.octet_length("record") < 4 + n
    left = F.when(F.col("key") % 4 == 0, 0).otherwise(F.length("p_type"))
    return rows.select("key", n.cast("int").alias("first_bytes"), F.when(short, left).otherwise(F.octet_length("record") - 4 - n).cast("int").alias("second_bytes"), F.when(short, "truncated").otherwise("ok").alias("status"))


_FRAMES = """(select p_partkey as key, case when p_partkey % 9 = 0 then substr(whole, 1, 2 * p_size) else whole end as digits from (
  select *, format('{:02X}', length(p_name) & 255) || format('{:02X}', (length(p_name) >> 8) & 255) || format('{:02X}', (length(p_name) >> 16) & 255) || format('{:02X}', (length(p_name) >> 24) & 255) || hex(p_name) || case when p_partkey % 4 = 0 then '' else hex(p_type) end as whole from part))"""


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """(key, record): a length, a first fragment of it, and a second one that some leave
    out; every ninth record breaks off somewhere."""
    size = F.octet_length("p_name")
    header = F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(size, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)]))
    second = F.when(F.col("p_partkey") % 4 == 0, F.lit("")).otherwise(F.col("p_type")).cast("binary")
    whole = F.concat(header, F.col("p_name").cast("binary"), second)
    return table(spark, folder, "part").select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 9 == 0, F.substring(whole, F.lit(1), F.col("p_size"))).otherwise(whole).alias("record"))


@query(
    "framed_records",
    f"""with r as (select key, digits, length(digits) // 2 as n_bytes, case when length(digits) >= 8 then ('0x' || digits[1:2])::bigint + 256 * ('0x' || digits[3:4])::bigint + 65536 * ('0x' || digits[5:6])::bigint + 16777216 * ('0x' || digits[7:8])::bigint end as n from {_FRAMES})
select key, n_bytes::int as n_bytes, case when n is null then 'no_header' when n_bytes < 4 + n then 'truncated' when n_bytes = 4 + n then 'one' else 'two' end as status, case when n_bytes >= 4 + n then decode(unhex(digits[9 : 8 + 2 * n])) end as first, case when n_bytes > 4 + n then decode(unhex(digits[9 + 2 * n :])) end as second from r""",
)
def framed_records(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments read back from the records' bytes alone, and what is wrong with the others."""
    size = F.octet_length("record")
    rows = frames(spark, folder).select("key", "record", size.alias("n_bytes"), F.when(size >= 4, little_endian(F.col("record"), 0)).alias("n"))
    end = F.col("n") + 4
    status = F.when(F.col("n").isNull(), "no_header").when(F.col("n_bytes") < end, "truncated").when(F.col("n_bytes") == end, "one").otherwise("two")
    text = lambda at, n: F.decode(F.substring("record", at, n), "UTF-8")
    first = F.when(F.col("n_bytes") >= end, text(F.lit(5), F.col("n").cast("int")))
    second = F.when(F.col("n_bytes") > end, text((end + 1).cast("int"), F.col("n_bytes")))
    return rows.select("key", "n_bytes", status.alias("status"), first.alias("first"), second.alias("second"))


@query(
    "root_fragments",
    "with v as (select c_custkey as patch, k // 9 as y, k % 9 as x, ((k // 9) * (c_custkey % 31 + 3) + (k % 9) * (c_custkey % 17 + 5))::bigint as v from customer, (select unnest(range(81)) as k)) select patch, list(v order by y, x) filter (x <= 8 - y) as first, list(v order by y desc, x desc) filter (x >= 8 - y) as second from v group by patch",
)
def root_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Square patches of nine by nine cut along the diagonal into two packed triangles,
    the second from its far corner."""
    c = F.col("c_custkey")

    def height(k: int) -> Column:
        return (k // 9 * (c % 31 + 3) + k % 9 * (c % 17 + 5)).cast("long")

    # place by place: lambdas over a sequence aren't compiled
    first = F.array(*(height(k) for k in range(81) if k % 9 <= 8 - k // 9))
    second = F.array(*(height(k) for k in reversed(range(81)) if k % 9 >= 8 - k // 9))
    spread = table(spark, folder, "customer").select("c_custkey").repartition("c_custkey")  # a row becomes 90 heights
    return spread.select(c.alias("patch"), first.alias("first"), second.alias("second"))


@query("changed_groups")
def changed_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Members that are replaced together: components of what they share, named by the
    smallest member; labels spread and pointers halve until nothing changes."""
    li = table(spark, folder, "lineitem")
    e = li.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 40 + 1000000).alias("b")).distinct()
    loops.ensure_checkpoint_dir(spark)
    edges = e.union(e.select("b", "a")).distinct().checkpoint()

    def step(labels: DataFrame) -> DataFrame:
        near = edges.join(labels.select(F.col("node").alias("b"), "grp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grp").alias("near"))
        own = labels.join(near, "node").select("node", F.least("grp", "near").alias("grp"))
        jump = own.select(F.col("node").alias("grp"), F.col("grp").alias("up"))
        return own.join(jump, "grp", "left").select("node", F.least("grp", F.coalesce("up", "grp")).alias("grp"))

    return loops.fixpoint(edges.select(F.col("a").alias("node"), F.col("a").alias("grp")).distinct(), step, 40)
