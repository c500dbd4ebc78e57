"""Queries of clipping, regions on child tiles, sample validity, requests, orders and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.catalog import query
from tilewright.functions import geo, grid
from tilewright.functions.bits import left
from tilewright.operators import polygons, raster
from tilewright.operators.cells import cover
from tilewright.plans.measures import regions
from tilewright.plans.spatial import legs
from tilewright.sources.tables import CUSTOMERS_SQL, LAT_SQL, LON_SQL, PARTS_SQL, PIXELS_SQL, TILES_SQL, customers, parts, pixels, table, tiles

# polygons and regions

_SIDES = (("x", -2.0, True), ("x", 1.5, False), ("y", -1.0, True), ("y", 2.5, False))


def _clip_sql(source: str, axis: str, shift: float, above: bool) -> str:
    centre, other = {"x": "lon", "y": "lat"}[axis], "y" if axis == "x" else "x"
    bound = f"({centre} + ({shift}::double))"
    p, q = "ring[k]", "ring[k % len(ring) + 1]"
    inner, following = (f"({p}.{axis} - {bound})", f"({q}.{axis} - {bound})") if above else (f"({bound} - {p}.{axis})", f"({bound} - {q}.{axis})")
    place = {axis: bound, other: f"{p}.{other} + ({q}.{other} - {p}.{other}) * ({inner} / ({inner} - {following}))"}
    meets = f"struct_pack(x := {place['x']}, y := {place['y']})"
    return f"select id, lon, lat, flatten(list_transform(range(1, len(ring) + 1), lambda k: case when {inner} >= 0 then [{p}] else [] end || case when ({inner} < 0) <> ({following} < 0) then [{meets}] else [] end)) as ring from {source}"


@query(
    "clipped_polygons",
    f"with c0 as (select id, lon, lat, [struct_pack(x := lon + (id % 5), y := lat - 3.0e0), struct_pack(x := lon + 3.0e0, y := lat + (id % 3)), struct_pack(x := lon - (id % 4), y := lat + 3.0e0), struct_pack(x := lon - 3.0e0, y := lat - (id % 2))] as ring from {CUSTOMERS_SQL})"
    + "".join(f", c{k + 1} as ({_clip_sql(f'c{k}', *side)})" for k, side in enumerate(_SIDES))
    + " select id, len(ring)::int as corners, round(list_sum(list_transform(range(1, len(ring) + 1), lambda k: (ring[k].x - lon) * (ring[k % len(ring) + 1].y - lat) - (ring[k % len(ring) + 1].x - lon) * (ring[k].y - lat))) / 2, 6) as area from c4",
)
def clipped_polygons(spark: SparkSession, folder: str) -> DataFrame:
    """A quadrilateral round each customer, clipped by the four sides of a box."""
    c, lon, lat = F.col("id"), F.col("lon"), F.col("lat")
    places = ((lon + c % 5, lat - 3.0), (lon + 3.0, lat + c % 3), (lon - c % 4, lat + 3.0), (lon - 3.0, lat - c % 2))
    rows = customers(spark, folder).select("id", "lon", "lat", F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in places]).alias("ring"))
    for axis, shift, above in _SIDES:
        rows = rows.withColumn("ring", polygons.clip_half(F.col("ring"), axis, (lon if axis == "x" else lat) + shift, above))
    about = F.transform("ring", lambda p: F.struct((p["x"] - lon).alias("x"), (p["y"] - lat).alias("y")))
    return rows.withColumn("about", about).select("id", F.size("ring").alias("corners"), F.round(polygons.area(F.col("about")), 6).alias("area"))


_FACED = "(select (l_partkey % 97) / 100.0e0 as u0, (l_suppkey % 89) / 100.0e0 as v0, (l_partkey % 97) / 100.0e0 + 0.03e0 as u1, (l_suppkey % 89) / 100.0e0 + 0.05e0 as v1, l_extendedprice / 100 * l_discount as error, l_suppkey as surface, l_extendedprice / 100 as density from lineitem)"


def _left_of(a: tuple[str, str], b: tuple[str, str]) -> str:
    return "greatest(" + ", ".join(f"({b[0]} - {a[0]}) * ({v} - {a[1]}) - ({b[1]} - {a[1]}) * ({u} - {a[0]})" for u in ("a0", "a1") for v in ("b0", "b1")) + ") > 0"


_HULL = (("u0", "v0"), ("u1", "v0"), ("u0", "v1"))


@query(
    "child_regions",
    f"""with c as (select l as level, x, y, x / (1 << l)::double as a0, (x + 1) / (1 << l)::double as a1, y / (1 << l)::double as b0, (y + 1) / (1 << l)::double as b1 from (select unnest(range(1, 4))::int as l), (select unnest(range(8))::int as x), (select unnest(range(8))::int as y) where x < (1 << l) and y < (1 << l))
select level, x, y, count(*) as regions, round(max(error) / (1 << level) / 256, 9) as error from c join {_FACED} on a0 < u1 and a1 > u0 and b0 < v1 and b1 > v0 where error > 0 and {' and '.join(_left_of(a, b) for a, b in zip(_HULL, _HULL[1:] + _HULL[:1], strict=True))} group by level, x, y""",
)
def child_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Measured regions dealt to the children of a tile over three splits.  A child gets
    a region if their boxes overlap, no edge of the region's hull parts them and the
    region has an error; a child without regions isn't made.  A child lies inside its
    parent, so the cells of every level are taken straight from the region."""
    rows = regions(spark, folder).select("u0", "v0", "u1", "v1", (F.col("density") * F.col("wu")).alias("error")).where("error > 0")
    dealt = []
    for level in (1, 2, 3):
        size = 0.5**level
        cells = cover(rows, size, ("u0", "v0", "u1", "v1")).where(F.col("cell_x").between(0, 2**level - 1) & F.col("cell_y").between(0, 2**level - 1))
        box = (F.col("cell_x") * size, F.col("cell_y") * size, (F.col("cell_x") + 1) * size, (F.col("cell_y") + 1) * size)
        overlap = (box[0] < F.col("u1")) & (box[2] > F.col("u0")) & (box[1] < F.col("v1")) & (box[3] > F.col("v0"))
        hull = [(F.col(u), F.col(v)) for u, v in _HULL]
        dealt.append(cells.where(overlap & ~polygons.beyond_edge(hull, box)).select(F.lit(level).alias("level"), F.col("cell_x").cast("int").alias("x"), F.col("cell_y").cast("int").alias("y"), "error"))
    every = dealt[0].union(dealt[1]).union(dealt[2])
    return every.groupBy("level", "x", "y").agg(F.count("*").alias("regions"), F.max("error").alias("worst")).select("level", "x", "y", "regions", F.round(F.col("worst") / F.pow(F.lit(2.0), "level") / 256, 9).alias("error"))


@query("surface_summary", f"select surface, count(*) as regions, min(density) as low, max(density) as high, round(min(sqrt((u0 - 0.5e0) * (u0 - 0.5e0) + (v0 - 0.5e0) * (v0 - 0.5e0))), 9) as centre from {_FACED} group by surface")
def surface_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Range of the densities of each surface, and how near to the centre of the view it comes."""
    li = table(spark, folder, "lineitem")
    u, v = (F.col("l_partkey") % 97) / 100.0 - 0.5, (F.col("l_suppkey") % 89) / 100.0 - 0.5
    density = F.col("l_extendedprice") / 100
    return li.groupBy(F.col("l_suppkey").alias("surface")).agg(F.count("*").alias("regions"), F.min(density).alias("low"), F.max(density).alias("high"), F.round(F.min(F.sqrt(u * u + v * v)), 9).alias("centre"))


@query("merged_regions", f"with once as (select u0, v0, u1, v1, max(density) as density from {_FACED} group by all) select floor(u0 * 8)::int as x, floor(v0 * 8)::int as y, count(*) as merged, min(u0) as u0, min(v0) as v0, max(u1) as u1, max(v1) as v1, max(density) as density from once group by floor(u0 * 8), floor(v0 * 8)")
def merged_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Equal regions as one, then those that start in one cell as one that bounds them all."""
    once = regions(spark, folder).groupBy("u0", "v0", "u1", "v1").agg(F.max("density").alias("density"))
    cell = once.groupBy(F.floor(F.col("u0") * 8).cast("int").alias("x"), F.floor(F.col("v0") * 8).cast("int").alias("y"))
    return cell.agg(F.count("*").alias("merged"), F.min("u0").alias("u0"), F.min("v0").alias("v0"), F.max("u1").alias("u1"), F.max("v1").alias("v1"), F.max("density").alias("density"))


# samples

_VOID = (100, 105, 110)
_REMAP = 32767 / 230


@query(
    "valid_samples",
    f"with b as (select raster, x, y, list(value order by band) as v from {PIXELS_SQL} group by raster, x, y), c as (select *, v <> [{', '.join(map(str, _VOID))}]::int[] as valid from b) select raster, x, y, valid, case when valid then v[1] * 2 * 64 else 0 end as height, "
    + ", ".join(f"case when valid then trunc(greatest(0.0e0, least(32767.0e0, (v[{k + 1}] - 10) * ({_REMAP!r}::double))))::int else 0 end as {n}" for k, n in enumerate(("red", "green", "blue")))
    + " from c",
)
def valid_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Samples as heights in 64ths at twice the scale and as 15-bit colours.  A sample
    is void only if every band has that band's no-data value."""
    rows = raster.by_pixel(pixels(spark, folder), "raster")
    valid = ~(F.col("bands") == F.array(*[F.lit(v) for v in _VOID]))

    def colour(k: int) -> Column:
        level = F.greatest(F.lit(0.0), F.least(F.lit(32767.0), (F.get("bands", F.lit(k)) - 10) * _REMAP))
        return F.when(valid, level.cast("int")).otherwise(0)

    height = F.when(valid, F.get("bands", F.lit(0)) * 2 * 64).otherwise(0)
    return rows.select("raster", "x", "y", valid.alias("valid"), height.alias("height"), colour(0).alias("red"), colour(1).alias("green"), colour(2).alias("blue"))


_WIDE, _HIGH, _SAMPLES = 40000.0, 20000.0, 32


@query(
    "fragment_spacing",
    f"select id, level, round(sqrt(pow({_WIDE}::double / (1 << level), 2) + pow({_HIGH}::double / (1 << level), 2)) / {_SAMPLES}, 6) as plane, round(sqrt(2.0e0) * pi() * {geo.RADIUS}::double / (1 << level) / {_SAMPLES}, 6) as globe from {TILES_SQL}",
)
def fragment_spacing(spark: SparkSession, folder: str) -> DataFrame:
    """Spacing of the height samples of a grid diamond, on a plane and on the globe."""
    size = left(F.lit(2 * grid.HALF).cast("long"), 0) / F.pow(F.lit(2.0), "level")
    x, y = (F.pmod(F.col(c).cast("double"), F.pow(F.lit(2.0), "level")) * size - grid.HALF for c in ("col", "row"))
    k = F.lit(grid.HALF)
    d = grid.diamond(grid.point(x, y, k), grid.point(x, y + size, k), grid.point(x + size, y + size, k), grid.point(x + size, y, k))
    g = 2.0 * grid.HALF
    angular = 3.141592653589793 * geo.RADIUS / g
    rows = tiles(spark, folder).select("id", "level", d.alias("d"))
    plane = grid.sample_spacing(F.col("d"), 0, _SAMPLES, (_WIDE / g, _HIGH / g, 0.0))
    return rows.select("id", "level", F.round(plane, 6).alias("plane"), F.round(grid.sample_spacing(F.col("d"), 1, _SAMPLES, (angular, angular, angular)), 6).alias("globe"))


# demands and requests

_AHEAD = 5000.0
_D = f"({_AHEAD}::double / {geo.RADIUS}::double)"


@query(
    "ground_demands",
    f"""with c as (select id, h, radians(lon) as a, radians(lat) as b, radians((id * 37 % 360)::double) as t, id % 10 = 0 as down from {CUSTOMERS_SQL}),
d as (select *, case when down then b else asin(sin(b) * cos({_D}) + cos(b) * sin({_D}) * cos(t)) end as lat2 from c),
e as (select *, case when down then a else a + atan2(sin(t) * sin({_D}) * cos(b), cos({_D}) - sin(b) * sin(lat2)) end as lon2 from d)
select id, round(h, 3) as eye_height, round(sin(lon2) * cos(lat2), 7) as x, round(sin(lat2), 7) as y, round(cos(lon2) * cos(lat2), 7) as z from e""",
)
def ground_demands(spark: SparkSession, folder: str) -> DataFrame:
    """The ground a camera needs next: the point a way ahead on the great circle of its
    view, whatever its pitch; a camera that looks straight down needs the ground below."""
    rows = customers(spark, folder)
    frame = geo.frame(F.col("lon"), F.col("lat"))
    turn, pitch = F.radians((F.col("id") * 37 % 360).cast("double")), F.radians(F.when(F.col("id") % 10 == 0, 90.0).otherwise(F.col("id") % 60))
    forward = [(e * F.sin(turn) + n * F.cos(turn)) * F.cos(pitch) - u * F.sin(pitch) for u, n, e in zip(frame["up"], frame["north"], frame["east"], strict=True)]
    rows = rows.select("id", "h", *[c.alias(f"u{k}") for k, c in enumerate(frame["up"])], *[c.alias(f"f{k}") for k, c in enumerate(forward)])
    u, f = [F.col(f"u{k}") for k in range(3)], [F.col(f"f{k}") for k in range(3)]
    along = u[0] * f[0] + u[1] * f[1] + u[2] * f[2]
    rows = rows.select("id", "h", *u, *[(f[k] - along * u[k]).alias(f"t{k}") for k in range(3)])
    t = [F.col(f"t{k}") for k in range(3)]
    length = F.sqrt(t[0] * t[0] + t[1] * t[1] + t[2] * t[2])
    step = F.lit(_AHEAD / geo.RADIUS)
    ahead = [F.when(length < 1e-8, u[k]).otherwise(u[k] * F.cos(step) + t[k] / length * F.sin(step)) for k in range(3)]
    return rows.select("id", F.round("h", 3).alias("eye_height"), *[F.round(c, 7).alias(n) for c, n in zip(ahead, "xyz", strict=True)])


@query(
    "fetch_outcomes",
    f"with r as (select event_id as id, user_id as consumer, {LON_SQL.format(k='event_id')} as lon, {LAT_SQL.format(k='event_id')} as lat, event_id % 25 as age from events) select consumer, count(*) filter (not (lon - 1 < 60 and lon + 1 > -60 and lat - 1 < 40 and lat + 1 > -40)) as void, count(*) filter (lon - 1 < 60 and lon + 1 > -60 and lat - 1 < 40 and lat + 1 > -40 and age > 10) as dropped, count(*) filter (lon - 1 < 60 and lon + 1 > -60 and lat - 1 < 40 and lat + 1 > -40 and age <= 10) as held from r group by consumer",
)
def fetch_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Requests for boxes: those outside a source's bounds are void without a read;
    results inside that nobody has claimed for over ten ticks are dropped."""
    from tilewright.sources.tables import latitude, longitude

    e = F.col("event_id")
    r = table(spark, folder, "events").select(F.col("user_id").alias("consumer"), longitude(e).alias("lon"), latitude(e).alias("lat"), (e % 25).alias("age"))
    inside = (F.col("lon") - 1 < 60) & (F.col("lon") + 1 > -60) & (F.col("lat") - 1 < 40) & (F.col("lat") + 1 > -40)
    old = F.col("age") > 10
    return r.groupBy("consumer").agg(F.count_if(~inside).alias("void"), F.count_if(inside & old).alias("dropped"), F.count_if(inside & ~old).alias("held"))


_PATH_SQL = "(select o_orderkey as id, '/tiles/' || case when o_orderkey % 11 = 0 then '0' else '' end || (o_orderkey % 20) || '/' || (o_orderkey * 57 % (3 << (o_orderkey % 20)::int)) || '/' || (o_orderkey * 31 % (3 << (o_orderkey % 20)::int)) || case o_orderkey % 4 when 0 then '.jpg' when 1 then '.png' else '' end as path from orders)"


@query(
    "imagery_paths",
    f"""with p as (select id, regexp_extract(path, '^/tiles/(0|[1-9][0-9]*)/(0|[1-9][0-9]*)/(0|[1-9][0-9]*)([.]jpg)?$', ['l', 'x', 'y']) as m from {_PATH_SQL}),
q as (select id, try_cast(m.l as bigint) as level, try_cast(m.x as bigint) as col, try_cast(m.y as bigint) as row from p)
select id, coalesce(level <= 17 and col < (2 << level::int) and row < (1 << level::int), false) as valid, case when level <= 17 and col < (2 << level::int) and row < (1 << level::int) then level end as level from q""",
)
def imagery_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of imagery tiles: numbers without leading zeros, level 17 at most, twice as many columns as rows."""
    o = F.col("o_orderkey")
    level, range3 = o % 20, left(F.lit(3).cast("long"), o % 20)
    end = F.when(o % 4 == 0, ".jpg").when(o % 4 == 1, ".png").otherwise("")
    path = F.concat(F.lit("/tiles/"), F.when(o % 11 == 0, "0").otherwise(""), level.cast("string"), F.lit("/"), (o * 57 % range3).cast("string"), F.lit("/"), (o * 31 % range3).cast("string"), end)
    rows = table(spark, folder, "orders").select(o.alias("id"), path.alias("path"))
    form = r"^/tiles/(0|[1-9][0-9]*)/(0|[1-9][0-9]*)/(0|[1-9][0-9]*)([.]jpg)?$"
    parsed = rows.select("id", *[F.expr(f"try_cast(regexp_extract(path, r'{form}', {k}) as bigint)").alias(n) for k, n in ((1, "level"), (2, "col"), (3, "row"))])
    one = F.lit(1).cast("long")
    fine = F.coalesce((F.col("level") <= 17) & (F.col("col") < left(one, F.col("level") + 1)) & (F.col("row") < left(one, F.col("level"))), F.lit(False))
    return parsed.select("id", fine.alias("valid"), F.when(fine, F.col("level")).alias("level"))


# orders

@query("row_major_places", f"select level, row, col, row_number() over (partition by level order by row, col) as place from (select distinct level, row, col from {TILES_SQL})")
def row_major_places(spark: SparkSession, folder: str) -> DataFrame:
    """The place of each tile of a level in row-major order: tiles are numbered within
    their row, and rows start after the counts of those before, so no level is sorted in one task."""
    rows = tiles(spark, folder).select("level", "row", "col").distinct()
    before = Window.partitionBy("level").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("level", "row").agg(F.count("*").alias("n")).select("level", "row", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("level", "row").orderBy("col")
    return rows.withColumn("k", F.row_number().over(inside)).join(starts, ["level", "row"]).select("level", "row", "col", (F.col("start") + F.col("k")).alias("place"))


@query("poi_order", f"select id, floor(lon / 10)::int as x, floor(lat / 10)::int as y, row_number() over (partition by floor(lon / 10), floor(lat / 10) order by priority desc, id::varchar)::int as place from {PARTS_SQL}")
def poi_order(spark: SparkSession, folder: str) -> DataFrame:
    """Points of interest of each tile in the order of display: higher priority first, then by id as text."""
    rows = parts(spark, folder).select("id", "priority", F.floor(F.col("lon") / 10).cast("int").alias("x"), F.floor(F.col("lat") / 10).cast("int").alias("y"))
    w = Window.partitionBy("x", "y").orderBy(F.desc("priority"), F.col("id").cast("string"))
    return rows.select("id", "x", "y", F.row_number().over(w).alias("place"))


# tile map resources

_XML_SQL = "(select s_suppkey as id, '<TileMap version=\"1.0.0\"><Title>map ' || s_suppkey || '</Title><TileSets profile=\"geodetic\">' || list_aggregate(list_transform(range(0, s_suppkey % 4 + 1), lambda n: '<TileSet href=\"/m/' || s_suppkey || '/' || n || '\" units-per-pixel=\"' || (180 // (n + 1)) || '.5\" order=\"' || n || '\"/>'), 'string_agg', '') || '</TileSets></TileMap>' as xml from supplier)"


@query(
    "tilemap_sets",
    f"with x as (select id, xml, regexp_extract_all(xml, 'href=\"([^\"]*)\"', 1) as h, regexp_extract_all(xml, 'units-per-pixel=\"([^\"]*)\"', 1) as u, regexp_extract_all(xml, 'order=\"([^\"]*)\"', 1) as o from {_XML_SQL}) select id, regexp_extract(xml, '<Title>([^<]*)<', 1) as title, unnest(h) as href, unnest(u)::double as units, unnest(o)::int as place from x",
)
def tilemap_sets(spark: SparkSession, folder: str) -> DataFrame:
    """The tile sets that a tile map's XML resource lists, with their units per pixel."""
    s = F.col("s_suppkey")
    sets = F.transform(F.sequence(F.lit(0).cast("long"), s % 4), lambda n: F.concat(F.lit('<TileSet href="/m/'), s.cast("string"), F.lit("/"), n.cast("string"), F.lit('" units-per-pixel="'), F.floor(180 / (n + 1)).cast("string"), F.lit('.5" order="'), n.cast("string"), F.lit('"/>')))
    xml = F.concat(F.lit('<TileMap version="1.0.0"><Title>map '), s.cast("string"), F.lit('</Title><TileSets profile="geodetic">'), F.array_join(sets, ""), F.lit("</TileSets></TileMap>"))
    rows = table(spark, folder, "supplier").select(s.alias("id"), xml.alias("xml"))
    shape = "Title string, TileSets struct<TileSet: array<struct<_href: string, `_units-per-pixel`: double, _order: int>>>"
    parsed = rows.select("id", F.from_xml("xml", shape).alias("m"))
    return parsed.select("id", F.col("m.Title").alias("title"), F.explode("m.TileSets.TileSet").alias("t")).select("id", "title", F.col("t._href").alias("href"), F.col("t.`_units-per-pixel`").alias("units"), F.col("t._order").alias("place"))


# paths

_UNIT = "[sin(radians({o})) * cos(radians({a})), sin(radians({a})), cos(radians({o})) * cos(radians({a}))]"


@query(
    "route_coordinates",
    f"""with r as (select o_custkey as route, row_number() over w as seq, {LON_SQL.format(k='o_orderkey')} as lon, {LAT_SQL.format(k='o_orderkey')} as lat from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
l as (select route, seq, {_UNIT.format(o='lag(lon) over w', a='lag(lat) over w')} as p, {_UNIT.format(o='lon', a='lat')} as q from r window w as (partition by route order by seq) qualify seq > 1),
g as (select *, acos(greatest(-1.0e0, least(1.0e0, list_dot_product(p, q)))) as w from l)
select route, seq::int as seq, piece, """
    + ", ".join(f"round(case when sin(w) < 1e-9::double then p[{k}] * (1 - piece / 4.0e0) + q[{k}] * (piece / 4.0e0) else (p[{k}] * sin((1 - piece / 4.0e0) * w) + q[{k}] * sin(piece / 4.0e0 * w)) / sin(w) end, 6) as {n}" for k, n in ((1, "x"), (2, "y"), (3, "z")))
    + " from g, (select unnest(range(1, 5))::int as piece)",
)
def route_coordinates(spark: SparkSession, folder: str) -> DataFrame:
    """Points at each quarter of a route's legs, on the great circle."""
    rows = legs(spark, folder).where("seq > 1").select("route", "seq", "plon", "plat", "lon", "lat", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("piece"))
    none = F.lit(1.0 - geo.RADIUS)  # so that the length is 1
    a, b = geo.xyz(F.col("plon"), F.col("plat"), none), geo.xyz(F.col("lon"), F.col("lat"), none)
    at = geo.slerp(a, b, F.col("piece") / 4.0)
    return rows.select("route", "seq", "piece", *[F.round(c, 6).alias(n) for c, n in zip(at, "xyz", strict=True)])
