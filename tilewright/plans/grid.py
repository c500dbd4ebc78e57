"""Queries of the grid and tile algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.catalog import query
from tilewright.functions import grid, tiles
from tilewright.functions.bits import right
from tilewright.sources.tables import CUSTOMERS_SQL, PARTS_SQL, TILES_SQL, customers, parts, table
from tilewright.sources.tables import tiles as tile_table

H, Q = grid.HALF, grid.HALF // 2

# a plane diamond per order: corners at a cell of a regular grid, so children stay in range
_STEP = 1 << 18


def diamonds(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("o_orderkey")
    i, j = (o * 131 % 1000 - 500) * _STEP, (o * 733 % 1000 - 500) * _STEP
    z = F.lit(H)
    corners = [grid.point(i, j, z), grid.point(i, j + _STEP + 1, z), grid.point(i + _STEP + 1, j + _STEP + 1, z), grid.point(i + _STEP + 1, j, z)]
    return table(spark, folder, "orders").select(o.alias("id"), grid.diamond(*corners).alias("d"))


DIAMONDS_SQL = f"(select o_orderkey as id, (o_orderkey * 131 % 1000 - 500) * {_STEP} as i, (o_orderkey * 733 % 1000 - 500) * {_STEP} as j, {_STEP} + 1 as s from orders)"


@query(
    "tile_density",
    f"""with t as (select least(floor((lon + 180) / (180.0e0 / 32))::int, 63) as col, 31 - least(floor((lat + 90) / (180.0e0 / 32))::int, 31) as row, weight from {CUSTOMERS_SQL})
select row, col, count(*) as customers, round(sum(weight), 2) as balance, col * 5.625e0 - 180 as west, 90 - (row + 1) * 5.625e0 as south, (col + 1) * 5.625e0 - 180 as east, 90 - row * 5.625e0 as north
from t group by row, col""",
)
def tile_density(spark: SparkSession, folder: str) -> DataFrame:
    row, col = tiles.point_tile(F.col("lon"), F.col("lat"), 5)
    found = customers(spark, folder).select(row.alias("row"), col.alias("col"), "weight")
    sums = found.groupBy("row", "col").agg(F.count("*").alias("customers"), F.round(F.sum("weight"), 2).alias("balance"))
    w, s, e, n = tiles.tile_bounds(F.lit(5), F.col("row"), F.col("col"))
    return sums.select("row", "col", "customers", "balance", w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north"))


@query(
    "diamond_ids",
    f"select id, (i + i + s) >> 1 as i, (j + j + s) >> 1 as j, {H} as k, i as p0_i, j + s as p0_j, i + s as p1_i, j as p1_j, i as c00_i, (j + j + s) >> 1 as c00_j, (i + i + s) >> 1 as c01_i, j + s as c01_j, i + s as c10_i, (j + s + j) >> 1 as c10_j, (i + s + i) >> 1 as c11_i, j as c11_j from {DIAMONDS_SQL}",
)
def diamond_ids(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("d")
    me = grid.diamond_id(d)
    ups = [grid.parent_id(d, f)[x].alias(f"p{f}_{x}") for f in (0, 1) for x in "ij"]
    downs = [grid.child_id(d, f, c)[x].alias(f"c{f}{c}_{x}") for f in (0, 1) for c in (0, 1) for x in "ij"]
    return diamonds(spark, folder).select("id", me["i"].alias("i"), me["j"].alias("j"), me["k"].alias("k"), *ups, *downs)


@query(
    "diamond_children",
    f"""with d as (select id, i, j, s, (2 * i + s) >> 1 as ci, (2 * j + s) >> 1 as cj from {DIAMONDS_SQL}),
kids as (
  select id, 0 as fragment, 0 as child, i as a_i, j + s as a_j, ci as b_i, cj as b_j, i as c_i, j as c_j, 2 * i - ci as e_i, 2 * ((2 * j + s) >> 1) - cj as e_j from d union all
  select id, 0, 1, i, j + s, 2 * ((2 * i + s) >> 1) - ci, 2 * (j + s) - cj, i + s, j + s, ci, cj from d union all
  select id, 1, 0, i + s, j, ci, cj, i + s, j + s, 2 * (i + s) - ci, 2 * ((2 * j + s) >> 1) - cj from d union all
  select id, 1, 1, i + s, j, 2 * ((2 * i + s) >> 1) - ci, 2 * j - cj, i, j, ci, cj from d)
select id, fragment, child, a_i, a_j, b_i, b_j, c_i, c_j, e_i, e_j, (a_i + c_i) >> 1 as id_i, (a_j + c_j) >> 1 as id_j from kids""",
)
def diamond_children(spark: SparkSession, folder: str) -> DataFrame:
    kids = [F.struct(F.lit(f).alias("fragment"), F.lit(c).alias("child"), grid.planar_child(F.col("d"), f, c).alias("d")) for f in (0, 1) for c in (0, 1)]
    rows = diamonds(spark, folder).select("id", F.explode(F.array(*kids)).alias("kid"))
    corners = [F.col(f"kid.d.c{n}")[x].alias(f"{name}_{x}") for n, name in enumerate("abce") for x in "ij"]
    me = grid.diamond_id(F.col("kid.d"))
    return rows.select("id", "kid.fragment", "kid.child", *corners, me["i"].alias("id_i"), me["j"].alias("id_j"))


def roots(spark: SparkSession) -> DataFrame:
    """The eight diamonds of the globe, numbered from 0."""
    rows = [(n, *(grid.CYLINDER_POINTS[c] for c in corners)) for n, corners in enumerate(grid.CYLINDER_ROOTS)]
    kind = "struct<i:bigint,j:bigint,k:bigint>"
    return spark.createDataFrame(rows, f"root int, c0 {kind}, c1 {kind}, c2 {kind}, c3 {kind}").select("root", grid.diamond(*(F.col(f"c{n}") for n in range(4))).alias("d"))


def descend(frame: DataFrame, levels: int, cylinder: bool = True) -> DataFrame:
    """(root, level, d): every diamond down to a level, by unrolled generations;
    a diamond with two parents comes once for each."""
    step = frame.select("root", F.lit(0).alias("level"), "d")
    out = step
    for _ in range(levels):
        kids = F.array(*[grid.planar_child(F.col("d"), f, c) for f in (0, 1) for c in (0, 1)])
        step = step.select("root", (F.col("level") + 1).alias("level"), F.explode(kids).alias("d"))
        if cylinder:
            step = step.withColumn("d", grid.diamond(F.col("d.c0"), grid.wrap_cylinder(F.col("d.c1")), F.col("d.c2"), grid.wrap_cylinder(F.col("d.c3"))))
        step = step.dropDuplicates(["root", "d"])
        out = out.union(step)
    return out


_POINTS_SQL = ", ".join(f"({n}, {i}, {j}, {k})" for n, (i, j, k) in enumerate(grid.CYLINDER_POINTS))
_ROOTS_SQL = ", ".join(f"({n}, {a}, {c})" for n, (a, _, c, _) in enumerate(grid.CYLINDER_ROOTS))


@query(
    "globe_roots",
    f"""with p(n, i, j, k) as (values {_POINTS_SQL}), r(root, a, c) as (values {_ROOTS_SQL}),
m as (select root, (x.i + y.i) >> 1 as i, (x.j + y.j) >> 1 as j, (x.k + y.k) >> 1 as k from r join p x on x.n = a join p y on y.n = c)
select root, i::bigint as i, j::bigint as j, k::bigint as k,
  round(case when k = {Q} then -2.0e0 * {H} + i + {Q} when i = {Q} then -1.0e0 * {H} - k + {Q} when k = -{Q} then {Q}::double - i when i = -{Q} then {H}::double + k + {Q} else 0.0e0 end * 90 / {H}, 9) as lon,
  round(j * 90.0e0 / {H}, 9) as lat from m""",
)
def globe_roots(spark: SparkSession, folder: str) -> DataFrame:
    me = grid.diamond_id(F.col("d"))
    lon, lat = grid.grid_degrees(me)
    return roots(spark).select("root", me["i"].alias("i"), me["j"].alias("j"), me["k"].alias("k"), F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@query("globe_levels")
def globe_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct diamonds per level and the spread of their centres, three levels down."""
    me = grid.diamond_id(F.col("d"))
    lon, lat = grid.grid_degrees(me)
    rows = descend(roots(spark), 3).select("level", me.alias("me"), lon.alias("lon"), lat.alias("lat")).dropDuplicates(["level", "me"])
    return rows.groupBy("level").agg(F.count("*").alias("diamonds"), F.round(F.min("lon"), 6).alias("west"), F.round(F.max("lon"), 6).alias("east"), F.round(F.min("lat"), 6).alias("south"), F.round(F.max("lat"), 6).alias("north"))


_GRID_X = f"case when lon < -90 then -{Q}.0e0 + (lon + 180) * {H}.0e0 / 90 when lon < 0 then {Q}.0e0 when lon < 90 then {Q}.0e0 - lon * {H}.0e0 / 90 else -{Q}.0e0 end"
_GRID_Z = f"case when lon < -90 then {Q}.0e0 when lon < 0 then {Q}.0e0 - (lon + 90) * {H}.0e0 / 90 when lon < 90 then -{Q}.0e0 else -{Q}.0e0 + (lon - 90) * {H}.0e0 / 90 end"


@query(
    "grid_positions",
    f"select id, round({_GRID_X}, 3) as x, round(lat * {H}.0e0 / 90, 3) as y, round({_GRID_Z}, 3) as z, round(-{H}.0e0 + 2.0e0 * {H} * (lon + 180) / 360, 3) as plane_x, round(-{H}.0e0 + 2.0e0 * {H} * (lat + 90) / 180, 3) as plane_y from {CUSTOMERS_SQL}",
)
def grid_positions(spark: SparkSession, folder: str) -> DataFrame:
    p = grid.degrees_grid(F.col("lon"), F.col("lat"))
    flat = grid.plane_grid(F.col("lon"), F.col("lat"), (-180.0, -90.0, 180.0, 90.0))
    return customers(spark, folder).select("id", *[F.round(p[x], 3).alias(x) for x in "xyz"], F.round(flat["x"], 3).alias("plane_x"), F.round(flat["y"], 3).alias("plane_y"))


@query(
    "node_algebra",
    f"""select id, level, row, col, case when level > 0 then level - 1 end as up_level, case when level > 0 then row >> 1 end as up_row, case when level > 0 then col >> 1 end as up_col,
  row * 2 + 1 as down_row, col * 2 as down_col, ((row >> level) * 4 + (col >> level))::int as root, level between 0 and 27 and row < (2 << level) and col < (4 << level) as valid,
  -180 + col * (360.0e0 / (4 << level)) as west, 90 - (row + 1) * (180.0e0 / (2 << level)) as south, -180 + (col + 1) * (360.0e0 / (4 << level)) as east, 90 - row * (180.0e0 / (2 << level)) as north from {TILES_SQL}""",
)
def node_algebra(spark: SparkSession, folder: str) -> DataFrame:
    level, row, col = F.col("level"), F.col("row"), F.col("col")
    w, s, e, n = grid.node_bounds(level, row, col)
    inner = level > 0
    return tile_table(spark, folder).select(
        "id", "level", "row", "col", F.when(inner, level - 1).alias("up_level"), F.when(inner, right(row, 1)).alias("up_row"), F.when(inner, right(col, 1)).alias("up_col"),
        (row * 2 + 1).alias("down_row"), (col * 2).alias("down_col"), grid.node_root(level, row, col).alias("root"), grid.is_node(level, row, col).alias("valid"),
        w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north"),
    )


@query(
    "tile_ancestors",
    f"with up as (select id, level, row, col, unnest(range(1, level + 1))::int as n from {TILES_SQL}) select id, level - n as level, row >> n as row, col >> n as col, 1 / (1 << n)::double as scale, ((col & ((1 << n) - 1)) / (1 << n)::double) as offset_x, ((row & ((1 << n) - 1)) / (1 << n)::double) as offset_y from up",
)
def tile_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    rows = tile_table(spark, folder).withColumn("up", F.explode(grid.ancestors(F.col("level"), F.col("row"), F.col("col"))))
    size = F.pow(F.lit(2.0), F.col("level") - F.col("up.level"))
    return rows.select("id", "up.level", "up.row", "up.col", (1 / size).alias("scale"), ((F.col("col") - F.col("up.col") * size) / size).alias("offset_x"), ((F.col("row") - F.col("up.row") * size) / size).alias("offset_y"))


@query(
    "tile_containment",
    f"with t as (select distinct level, row, col from {TILES_SQL}) select a.level, a.row, a.col, count(*) as inside from t a join {TILES_SQL} b on a.level <= b.level and (b.row >> (b.level - a.level)) = a.row and (b.col >> (b.level - a.level)) = a.col group by a.level, a.row, a.col",
)
def tile_containment(spark: SparkSession, folder: str) -> DataFrame:
    """How many orders' tiles each tile holds: tiles count for themselves and each
    of their ancestors, and the counts are kept where such a tile exists."""
    rows = tile_table(spark, folder)
    above = F.concat(F.array(F.struct("level", "row", "col")), grid.ancestors(F.col("level"), F.col("row"), F.col("col")))
    sums = rows.select(F.explode(above).alias("a")).groupBy("a.level", "a.row", "a.col").agg(F.count("*").alias("inside"))
    return sums.join(rows.select("level", "row", "col").distinct(), ["level", "row", "col"], "left_semi")


@query(
    "tile_paths",
    f"select id, printf('%02d/%04d/%04d/%04d/%04d.png', level, row >> 12, row & 4095, col >> 12, col & 4095) as path, (row + col) % 4 as host, 'https://t' || substr('0123', ((row + col) % 4 + 1)::int, 1) || '.example.com/' || level || '/' || row || '/' || col || '.png' as url from {TILES_SQL}",
)
def tile_paths(spark: SparkSession, folder: str) -> DataFrame:
    key = (F.col("level"), F.col("row"), F.col("col"))
    return tile_table(spark, folder).select("id", tiles.tile_path(*key, "png").alias("path"), tiles.subdomain(key[1], key[2], 4).alias("host"), tiles.tile_url("https://t{s}.example.com/{z}/{y}/{x}.png", *key).alias("url"))


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    """(id, west, south, east, north): a box round every customer, some beyond the world."""
    half = F.lit(0.01) * F.pow(F.lit(2.0), F.col("id") % 12)
    return customers(spark, folder).select("id", (F.col("lon") - half).alias("west"), (F.col("lat") - half / 2).alias("south"), (F.col("lon") + half).alias("east"), (F.col("lat") + half / 2).alias("north"))


BOXES_SQL = f"(select id, lon - 0.01e0 * 2.0e0 ** (id % 12) as west, lat - 0.01e0 * 2.0e0 ** (id % 12) / 2 as south, lon + 0.01e0 * 2.0e0 ** (id % 12) as east, lat + 0.01e0 * 2.0e0 ** (id % 12) / 2 as north from {CUSTOMERS_SQL})"


@query(
    "tile_selection",
    f"""with b as (select *, greatest(east - west, north - south) / 256 as upp from {BOXES_SQL}),
d as (select b.*, l, abs(upp - 180.0e0 / 256 / (1 << l)) as delta from b, (select unnest(range(0, 12))::int as l)),
c as (select id, west, south, east, north, arg_min(l, struct_pack(d := delta, l := l)) as best from d group by all),
s as (select *, case when best <= 10 then best end as level, least(best, 10) as clamped from c),
k as (select *, floor((0.5e0 * (west + east) + 180) / (180.0e0 / (1 << clamped)))::int as col, (1 << clamped) - 1 - floor((0.5e0 * (south + north) + 90) / (180.0e0 / (1 << clamped)))::int as row,
  west >= -180 and east <= 180 and south >= -90 and north <= 90 as inside from s)
select id, level, case when inside and level is not null then row end as row, case when inside and level is not null then col end as col, case when inside then clamped end as clamped_level, case when inside then row end as clamped_row, case when inside then col end as clamped_col from k""",
)
def tile_selection(spark: SparkSession, folder: str) -> DataFrame:
    rows = boxes(spark, folder)
    box = [F.col(x) for x in ("west", "south", "east", "north")]
    rows = rows.withColumn("level", tiles.closest_level(F.greatest(box[2] - box[0], box[3] - box[1]) / 256, 256, 10))
    strict = tiles.select_level(*box, F.col("level"), 10)
    clamped = tiles.select_level(*box, F.coalesce("level", F.lit(10)), 10)
    return rows.select("id", "level", strict["row"].alias("row"), strict["col"].alias("col"), clamped["level"].alias("clamped_level"), clamped["row"].alias("clamped_row"), clamped["col"].alias("clamped_col"))


@query(
    "node_binding",
    f"""with n as (select id, level, row, col, -180 + col * (360.0e0 / (4 << level)) as west, 90 - (row + 1) * (180.0e0 / (2 << level)) as south, -180 + (col + 1) * (360.0e0 / (4 << level)) as east, 90 - row * (180.0e0 / (2 << level)) as north from {TILES_SQL}),
m as (select n.*, l as source_level, 180.0e0 / (1 << l) as span, (1 << l)::bigint as rows from n, (select unnest(range(0, 8))::int as l)),
p as (select *, floor((0.5e0 * (west + east) + 180) / span)::int as c, floor((90 - 0.5e0 * (south + north)) / span)::int as r from m)
select id, source_level, r as source_row, c as source_col, (east - west) / span as scale, (west - (-180 + c * span)) / span as offset_x, ((90 - r * span) - north) / span as offset_y from p
where west >= -180 + c * span - 1e-9 * span and east <= -180 + (c + 1) * span + 1e-9 * span and south >= 90 - (r + 1) * span - 1e-9 * span and north <= 90 - r * span + 1e-9 * span""",
)
def node_binding(spark: SparkSession, folder: str) -> DataFrame:
    """Quadtree nodes bound to the source tiles that hold them, at every source level that can."""
    level, row, col = F.col("level"), F.col("row"), F.col("col")
    w, s, e, n = grid.node_bounds(level, row, col)
    rows = tile_table(spark, folder).select("id", w.alias("w"), s.alias("s"), e.alias("e"), n.alias("n"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("source_level"))
    rows = rows.withColumn("span", 180.0 / F.pow(F.lit(2.0), "source_level"))
    rows = rows.withColumn("c", F.floor((0.5 * (F.col("w") + F.col("e")) + 180) / F.col("span")).cast("int")).withColumn("r", F.floor((90 - 0.5 * (F.col("s") + F.col("n"))) / F.col("span")).cast("int"))
    x, y, slack = F.col("c") * F.col("span") - 180, 90 - F.col("r") * F.col("span"), 1e-9 * F.col("span")
    held = rows.where((F.col("w") >= x - slack) & (F.col("e") <= x + F.col("span") + slack) & (F.col("s") >= y - F.col("span") - slack) & (F.col("n") <= y + slack))
    return held.select("id", "source_level", F.col("r").alias("source_row"), F.col("c").alias("source_col"), ((F.col("e") - F.col("w")) / F.col("span")).alias("scale"), ((F.col("w") - x) / F.col("span")).alias("offset_x"), ((y - F.col("n")) / F.col("span")).alias("offset_y"))


@query(
    "planar_tiles",
    f"select id, 3 as level, floor((lon + 200) / (400.0e0 / 24))::int as col, floor((lat + 100) / (200.0e0 / 16))::int as tms_row, 15 - floor((lat + 100) / (200.0e0 / 16))::int as row from {PARTS_SQL}",
)
def planar_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Tiles of a plane of 400 x 200 units, 3 x 2 at level 0; rows from below and from above."""
    col, up = F.floor((F.col("lon") + 200) / (400.0 / 24)).cast("int"), F.floor((F.col("lat") + 100) / (200.0 / 16)).cast("int")
    return parts(spark, folder).select("id", F.lit(3).alias("level"), col.alias("col"), up.alias("tms_row"), (15 - up).alias("row"))


_BITS_SQL = " | ".join("(((({v} + " + str(H) + f") >> {{s}}) >> {b} & 1) << {3 * b})" for b in range(16))


def _half_sql(s: int) -> str:
    return " | ".join(f"((" + _BITS_SQL.format(v=v, s=s) + f") << {n})" for n, v in enumerate(("i", "j", "k")))


@query("morton_codes", f"with p as (select o_orderkey as id, (o_orderkey * 7919 % {2 * H}) - {H} as i, (o_orderkey * 104729 % {2 * H}) - {H} as j, (o_orderkey * 1299709 % {2 * H}) - {H} as k from orders) select id, {_half_sql(16)} as high, {_half_sql(0)} as low from p")
def morton_codes(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("o_orderkey")
    i, j, k = (o * p % (2 * H) - H for p in (7919, 104729, 1299709))
    high, low = grid.morton(i, j, k)
    return table(spark, folder, "orders").select(o.alias("id"), high.alias("high"), low.alias("low"))


@query("bit_operations", "select o_orderkey as id, bit_count(o_orderkey)::int as ones, (case when o_orderkey > 0 then length(bin(o_orderkey)) - 1 end)::int as log2, xor(o_orderkey, o_orderkey >> 1) as gray, list_reduce([((o_orderkey >> b) & 1) << (31 - b) for b in range(32)], lambda a, b: a + b)::bigint as reversed from orders")
def bit_operations(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, folder, "orders").select(o.alias("id"), F.bit_count(o).alias("ones"), grid.log2_floor(o).alias("log2"), grid.gray(o).alias("gray"), grid.reverse_bits32(o).alias("reversed"))


@query("triangle_indices", "select p_partkey as id, ((p_partkey % 33) * (2 * 64 + 3 - p_partkey % 33) // 2 + p_size % 32)::int as place from part")
def triangle_indices(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), grid.triangle_index((F.col("p_size") % 32).cast("long"), F.col("p_partkey") % 33, F.lit(64).cast("long")).alias("place"))


@query(
    "terrain_anchors",
    f"""with d as (select id, (2 * i + s) >> 1 as ci, (2 * j + s) >> 1 as cj, i as pi, j + s as pj, (id % 12)::int as level from {DIAMONDS_SQL}),
p as (select id, level, level >> 1 as depth, case when level % 2 = 1 then pi else ci end as i, case when level % 2 = 1 then pj else cj end as j from d)
select id, depth as level, floor(({H}.0e0 - j) / (2.0e0 * {H}) * (1 << depth))::int as row, floor((i + {H}.0e0) / (2.0e0 * {H}) * (1 << depth))::int as col from p""",
)
def terrain_anchors(spark: SparkSession, folder: str) -> DataFrame:
    rows = diamonds(spark, folder).withColumn("geometry", (F.col("id") % 12).cast("int"))
    level, row, col = grid.anchor(F.col("d"), F.col("geometry"), 0, whole_globe=False)
    return rows.select("id", level.alias("level"), row.alias("row"), col.alias("col"))


@query(
    "tile_inventory",
    f"""with recursive have as (select distinct level, row, col from {TILES_SQL}),
walk as (select level, row, col from have where level = 0 union select h.level, h.row, h.col from have h join walk w on h.level = w.level + 1 and (h.row >> 1) = w.row and (h.col >> 1) = w.col)
select level, count(*) as tiles from walk group by level""",
)
def tile_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Tiles reachable from the roots through tiles that exist: a tile counts if
    all of its ancestors exist, which one grouping over exploded ancestors tells."""
    have = tile_table(spark, folder).select("level", "row", "col").distinct()
    up = have.select("level", "row", "col", F.explode_outer(grid.ancestors(F.col("level"), F.col("row"), F.col("col"))).alias("a"))
    known = have.select(F.col("level").alias("a_level"), F.col("row").alias("a_row"), F.col("col").alias("a_col"), F.lit(1).alias("there"))
    found = up.select("level", "row", "col", F.col("a.level").alias("a_level"), F.col("a.row").alias("a_row"), F.col("a.col").alias("a_col")).join(known, ["a_level", "a_row", "a_col"], "left")
    whole = found.groupBy("level", "row", "col").agg(F.count("there").alias("n")).where("n = level")
    return whole.groupBy("level").agg(F.count("*").alias("tiles"))


