"""Queries of triangles under a camera: one a customer, on the ground."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.catalog import query
from tilewright.functions import geo
from tilewright.operators import surface_distance
from tilewright.operators import triangles as tri
from tilewright.sources.tables import CUSTOMERS_SQL, LAT_SQL, LON_SQL, customers, latitude, longitude, table

R = geo.RADIUS
_EYE = (0.3 * R, 0.5 * R, 1.1 * R)
_M = geo.multiply(geo.perspective(1.1, 16 / 9, 2e5, 3 * R), geo.look_at(_EYE, (0.0, 0.0, 0.0), (0.0, 1.0, 0.0)))
_W, _H, _COLUMNS, _ROWS, _LEVELS = 1280.0, 720.0, 32, 16, 5
#: Corners east and north of a customer, and how much they are higher; every third triangle turns its back.
_CORNERS = ((0.0, 0.0, 0.0), (4.0, 0.5, 1.0), (1.0, 4.0, 2.0))


def ground(spark: SparkSession, folder: str) -> DataFrame:
    """(id, xyz, uv, row, col): triangles with places, texture and the quad of their first corner."""
    turned = F.col("id") % 3 == 0
    corner = [[F.when(turned, F.lit(_CORNERS[(3 - n) % 3][k])).otherwise(F.lit(_CORNERS[n][k])) for k in range(3)] for n in range(3)]
    lon, lat, h = ([F.col(c) + f * corner[n][k] for n in range(3)] for k, (c, f) in enumerate((("lon", 1.0), ("lat", 1.0), ("h", 5000.0))))
    rows = customers(spark, folder).select("id", "lon", "lat", F.array(*lon).alias("lons"), F.array(*lat).alias("lats"), F.array(*h).alias("hs"))
    xyz = [v for n in range(3) for v in geo.xyz(F.col("lons")[n], F.col("lats")[n], F.col("hs")[n])]
    uv = [v for n in range(3) for v in ((F.col("lons")[n] + 180) / 360.0, (F.col("lats")[n] + 90) / 180.0)]
    n = 1 << _LEVELS
    cell = [F.least(F.floor((90 - F.col("lat")) / 180.0 * n), F.lit(n - 1)).cast("int").alias("row"), F.least(F.floor((F.col("lon") + 180) / 360.0 * 2 * n), F.lit(2 * n - 1)).cast("int").alias("col")]
    return rows.select("id", F.array(*xyz).alias("xyz"), F.array(*uv).alias("uv"), *cell)


def _n(v: float) -> str:
    return f"({v!r}::double)"


def _pick(k: int, n: int) -> str:
    return f"case when id % 3 = 0 then {_CORNERS[(3 - n) % 3][k]}e0 else {_CORNERS[n][k]}e0 end"


def _ground_sql() -> str:
    at = [(f"(lon + 1.0e0 * {_pick(0, n)})", f"(lat + 1.0e0 * {_pick(1, n)})", f"({_n(R)} + (h + 5000.0e0 * {_pick(2, n)}))") for n in range(3)]
    xyz = ", ".join(f"sin(radians({a})) * cos(radians({b})) * {r}, sin(radians({b})) * {r}, cos(radians({a})) * cos(radians({b})) * {r}" for a, b, r in at)
    uv = ", ".join(f"({a} + 180) / 360.0e0, ({b} + 90) / 180.0e0" for a, b, _ in at)
    n = 1 << _LEVELS
    return f"(select id, [{xyz}] as p, [{uv}] as t, least(floor((90 - lat) / 180.0e0 * {n})::int, {n - 1}) as row, least(floor((lon + 180) / 360.0e0 * {2 * n})::int, {2 * n - 1}) as col from {CUSTOMERS_SQL})"


def _clip_sql() -> str:
    row = lambda r, n: " + ".join(f"{_n(_M[4 * r + k])} * p[{3 * n + k + 1}]" for k in range(3)) + f" + {_n(_M[4 * r + 3])}"
    out = f"g as (select * from {_ground_sql()}), c0 as (select *, [{', '.join('[' + ', '.join(row(r, n) for r in range(4)) + f', t[{2 * n + 1}], t[{2 * n + 2}]]' for n in range(3))}] as q from g)"
    a = [f"q[{n}]" for n in (1, 2, 3)]
    terms = []
    for i, j, k in ((1, 2, 4), (2, 4, 1), (4, 1, 2)):
        terms.append(f"{a[0]}[{i}] * (({a[1]}[{j}] - {a[0]}[{j}]) * ({a[2]}[{k}] - {a[0]}[{k}]) - ({a[1]}[{k}] - {a[0]}[{k}]) * ({a[2]}[{j}] - {a[0]}[{j}]))")
    scale = " * ".join(f"greatest({', '.join(f'abs({v}[{i}])' for v in a)})" for i in (1, 2, 4))
    out += f", c1 as (select *, {' + '.join(terms)} > {tri.MARGIN} * ({' + '.join(f'abs({t})' for t in terms)} + {scale}) as away from c0), k0 as (select * from c1)"
    for plane in range(6):
        d = lambda v, plane=plane: f"({v}[4] {'+' if plane % 2 == 0 else '-'} {v}[{plane // 2 + 1}])"
        here, after = "q[i]", "q[i % len(q) + 1]"
        cross = f"list_transform(range(1, 7), lambda x: {here}[x] + ({after}[x] - {here}[x]) * ({d(here)} / ({d(here)} - {d(after)})))"
        out += f", k{plane + 1} as (select id, p, t, away, flatten(list_transform(range(1, len(q) + 1), lambda i: case when {d(here)} >= 0 and {d(after)} < 0 then [{here}, {cross}] when {d(here)} >= 0 then [{here}] when {d(after)} >= 0 then [{cross}] else [] end)) as q from k{plane})"
    x, y = f"((v[1] / v[4] + 1) * {_W / 2})", f"((1 - v[2] / v[4]) * {_H / 2})"
    out += f", s as (select *, not away and len(q) >= 3 as shown, list_transform(q, lambda v: {x}) as xs, list_transform(q, lambda v: {y}) as ys, list_min(list_transform(q, lambda v: v[4])) as depth from k6)"
    det = "((t[3] - t[1]) * (t[6] - t[2]) - (t[4] - t[2]) * (t[5] - t[1]))"
    u = [f"(((p[{4 + k}] - p[{1 + k}]) * (t[6] - t[2]) - (p[{7 + k}] - p[{1 + k}]) * (t[4] - t[2])) / {det})" for k in range(3)]
    v = [f"(((p[{7 + k}] - p[{1 + k}]) * (t[3] - t[1]) - (p[{4 + k}] - p[{1 + k}]) * (t[5] - t[1])) / {det})" for k in range(3)]
    out += f", e as (select *, [{', '.join(u)}] as du, [{', '.join(v)}] as dv from s)"
    jac = lambda r, d, s: "(" + " + ".join(f"{s} * ({_n(_M[4 * r + k])} - c[{r + 1}] / c[4] * {_n(_M[12 + k])}) * {d}[{k + 1}]" for k in range(3)) + ") / depth"
    out += f", j as (select *, list_transform(q, lambda c: [{jac(0, 'du', _W / 2)}, {jac(0, 'dv', _W / 2)}, {jac(1, 'du', _H / 2)}, {jac(1, 'dv', _H / 2)}]) as js from e)"
    size = "sqrt(greatest(0, (j[1] * j[1] + j[3] * j[3] + j[2] * j[2] + j[4] * j[4] + sqrt(pow(j[1] * j[1] + j[3] * j[3] - j[2] * j[2] - j[4] * j[4], 2) + 4 * pow(j[1] * j[2] + j[3] * j[4], 2))) / 2))"
    out += f", shown as (select *, list_max(list_transform(js, lambda j: {size})) as density, abs(list_sum(list_transform(range(1, len(q) + 1), lambda i: xs[i] * ys[i % len(q) + 1] - xs[i % len(q) + 1] * ys[i]))) / 2 as area from j)"
    return out


_PX = {"left": "list_min(xs)", "top": "list_min(ys)", "right": "list_max(xs)", "bottom": "list_max(ys)"}
_UV = {"u0": "list_min(list_transform(q, lambda v: v[5]))", "v0": "list_min(list_transform(q, lambda v: v[6]))", "u1": "list_max(list_transform(q, lambda v: v[5]))", "v1": "list_max(list_transform(q, lambda v: v[6]))"}


@query(
    "projected_triangles",
    f"with {_clip_sql()} select id, case when away then 'culled' when shown then 'shown' else 'outside' end as state, case when shown then len(q) else 0 end::int as points, case when shown then round(area, 3) end as area, "
    + ", ".join(f'case when shown then round({v}, 3) end as "{n}"' for n, v in _PX.items()) + ", " + ", ".join(f"case when shown then round({v}, 9) end as {n}" for n, v in _UV.items())
    + ", case when shown then round(list_min(list_transform(q, lambda v: sqrt(pow(v[1] / v[4], 2) + pow(v[2] / v[4], 2)))), 9) end as centre, case when shown then round(density, 3) end as density from shown",
)
def projected_triangles(spark: SparkSession, folder: str) -> DataFrame:
    """Each triangle culled, or clipped to the view, with its area and boxes."""
    rows = tri.project(ground(spark, folder), _M, _W, _H)
    return rows.select("id", "state", "points", *(F.round(c, 3).alias(c) for c in ("area", *_PX, "density")), *(F.round(c, 9).alias(c) for c in (*_UV, "centre")))


@query(
    "texture_densities",
    f"""with {_clip_sql()}, b as (select id, density, area, {', '.join(f'{v} as {n}' for n, v in _UV.items())} from shown where shown),
c as (select *, unnest(range(greatest(0, floor(v0 * {_ROWS})::int), least({_ROWS} - 1, greatest(ceil(v1 * {_ROWS})::int - 1, floor(v0 * {_ROWS})::int)) + 1)) as row from b where u1 > 0 and v1 > 0 and u0 < 1 and v0 < 1),
d as (select *, unnest(range(greatest(0, floor(u0 * {_COLUMNS})::int), least({_COLUMNS} - 1, greatest(ceil(u1 * {_COLUMNS})::int - 1, floor(u0 * {_COLUMNS})::int)) + 1)) as col from c)
select row::int as row, col::int as col, count(*) as triangles, round(max(density), 3) as density, round(sum(density * area) / sum(area), 3) as mean from d group by row, col""",
)
def texture_densities(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels to a unit of texture in each cell of it that is in view."""
    rows = tri.texture_density(tri.project(ground(spark, folder), _M, _W, _H), _COLUMNS, _ROWS)
    return rows.select("row", "col", "triangles", F.round("density", 3).alias("density"), F.round("mean", 3).alias("mean"))


def _facing_sql() -> str:
    cross = [f"((p[{4 + j}] - p[{1 + j}]) * (p[{7 + k}] - p[{1 + k}]) - (p[{4 + k}] - p[{1 + k}]) * (p[{7 + j}] - p[{1 + j}]))" for j, k in ((1, 2), (2, 0), (0, 1))]
    out = f"with g as (select * from {_ground_sql()}), n as (select row, col, p, {', '.join(f'{c} as n{k}' for k, c in enumerate(cross))} from g), m as (select *, sqrt(n0 * n0 + n1 * n1 + n2 * n2) as length from n)"
    ends = ", ".join(f"min(n{k} / length) as u{k}_lo, max(n{k} / length) as u{k}_hi, min(least(p[{1 + k}], p[{4 + k}], p[{7 + k}])) as p{k}_lo, max(greatest(p[{1 + k}], p[{4 + k}], p[{7 + k}])) as p{k}_hi" for k in range(3))
    out += f", b as (select level, row >> ({_LEVELS} - level) as row, col >> ({_LEVELS} - level) as col, count(*) as triangles, {ends} from m, (select unnest(range({_LEVELS + 1}))::int as level) where length > 0 group by level, row >> ({_LEVELS} - level), col >> ({_LEVELS} - level))"
    products = [[f"u{k}_{s} * ({_n(e)} - p{k}_{t})" for s in ("lo", "hi") for t in ("lo", "hi")] for k, e in enumerate(_EYE)]
    low, high = (" + ".join(f"{f}({', '.join(p)})" for p in products) for f in ("least", "greatest"))
    room = f"{tri.MARGIN} * sqrt(" + " + ".join(f"pow(greatest(abs({_n(e)} - p{k}_lo), abs({_n(e)} - p{k}_hi)), 2)" for k, e in enumerate(_EYE)) + ")"
    return out + f" select level, row::int as row, col::int as col, triangles, case when {low} > {room} then 1 when {high} < -{room} then -1 else 0 end as facing from b"


@query("block_facing", _facing_sql())
def block_facing(spark: SparkSession, folder: str) -> DataFrame:
    """Of each quad's triangles on each level, whether all face the eye, none does, or some may."""
    return tri.facing_blocks(ground(spark, folder), _EYE, _LEVELS)


def _distance_sql() -> str:
    v = [[f"p[{3 * n + k + 1}]" for k in range(3)] for n in range(3)]
    q = ["x", "y", "z"]
    sub = lambda a, b: [f"({s} - {t})" for s, t in zip(a, b, strict=True)]
    dot = lambda a, b: "(" + " + ".join(f"{s} * {t}" for s, t in zip(a, b, strict=True)) + ")"
    cross = lambda a, b: [f"({a[j]} * {b[k]} - {a[k]} * {b[j]})" for j, k in ((1, 2), (2, 0), (0, 1))]
    normal = cross(sub(v[1], v[0]), sub(v[2], v[0]))
    edges = [(v[0], v[1]), (v[1], v[2]), (v[2], v[0])]
    over = " and ".join(f"{dot(cross(sub(b, a), sub(q, a)), ['nx', 'ny', 'nz'])} >= 0" for a, b in edges)
    gaps = []
    for a, b in edges:
        along = f"greatest(0, least(1, {dot(sub(q, a), sub(b, a))} / {dot(sub(b, a), sub(b, a))}))"
        gaps.append("sqrt(" + " + ".join(f"pow({w} - {s} - {along} * ({t} - {s}), 2)" for w, s, t in zip(q, a, b, strict=True)) + ")")
    return f"""with s as (select s_suppkey::bigint as id, sin(radians({LON_SQL.format(k='s_suppkey')})) * cos(radians({LAT_SQL.format(k='s_suppkey')})) * ({_n(R)} + s_suppkey * 7919 % 300 * 10000) as x, sin(radians({LAT_SQL.format(k='s_suppkey')})) * ({_n(R)} + s_suppkey * 7919 % 300 * 10000) as y,
  cos(radians({LON_SQL.format(k='s_suppkey')})) * cos(radians({LAT_SQL.format(k='s_suppkey')})) * ({_n(R)} + s_suppkey * 7919 % 300 * 10000) as z from supplier),
g as (select id as triangle, p, {', '.join(f'{c} as n{a}' for a, c in zip('xyz', normal, strict=True))} from {_ground_sql()}),
d as (select s.id, triangle, case when {over} then abs({dot(sub(q, v[0]), ['nx', 'ny', 'nz'])}) / sqrt(nx * nx + ny * ny + nz * nz) else least({', '.join(gaps)}) end as distance from s, g)
select id, arg_min(triangle, (distance, triangle)) as triangle, round(min(distance), 3) as distance from d group by id"""


@query("surface_distances", _distance_sql())
def surface_distances(spark: SparkSession, folder: str) -> DataFrame:
    """How far each supplier, up to 3,000 km high, is from the nearest ground triangle."""
    s = F.col("s_suppkey")
    places = geo.xyz(longitude(s), latitude(s), (s * 7919 % 300 * 10000).cast("double"))
    points = table(spark, folder, "supplier").select(s.cast("long").alias("id"), *(c.alias(a) for c, a in zip(places, "xyz", strict=True)))
    ground_rows = ground(spark, folder).select(F.col("id").alias("triangle"), F.col("xyz").alias("t"))
    return surface_distance.nearest(points, ground_rows, 400000.0).withColumn("distance", F.round("distance", 3))


_PLANES = geo.planes(_M)


def _segments_sql() -> str:
    end = lambda lon, lat: [f"sin(radians({lon})) * cos(radians({lat})) * {_n(1.2 * R)}", f"sin(radians({lat})) * {_n(1.2 * R)}", f"cos(radians({lon})) * cos(radians({lat})) * {_n(1.2 * R)}"]
    points = end(LON_SQL.format(k="o_custkey"), LAT_SQL.format(k="o_custkey")) + end(LON_SQL.format(k="o_orderkey"), LAT_SQL.format(k="o_orderkey"))
    sides = ", ".join(f"{{'a': {' + '.join(f'{_n(n)} * p[{k + 1}]' for k, n in enumerate(p[:3]))} + {_n(p[3])}, 'b': {' + '.join(f'{_n(n)} * p[{k + 4}]' for k, n in enumerate(p[:3]))} + {_n(p[3])}}}" for p in _PLANES)
    return f"""with s as (select o_orderkey as id, [{', '.join(points)}] as p from orders), d as (select id, unnest([{sides}]) as d from s),
r as (select id, max(case when d.a < 0 and d.b >= 0 then d.a / (d.a - d.b) else 0.0e0 end) as first, min(case when d.a >= 0 and d.b < 0 then d.a / (d.a - d.b) else 1.0e0 end) as last, bool_and(d.a >= 0 or d.b >= 0) as seen from d group by id)
select id, case when seen and first <= last then round(first, 9) end as first, case when seen and first <= last then round(last, 9) end as last from r"""


@query("segments_in_view", _segments_sql())
def segments_in_view(spark: SparkSession, folder: str) -> DataFrame:
    """The part of a straight line between each order's place and its customer's that the view holds."""
    high = F.lit(0.2 * R)
    ends = [geo.xyz(longitude(F.col(k)), latitude(F.col(k)), high) for k in ("o_custkey", "o_orderkey")]
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), *(c.alias(f"{p}{k}") for p, e in zip("ab", ends, strict=True) for k, c in enumerate(e)))
    first, last = geo.clip_segment(*(tuple(F.col(f"{p}{k}") for k in range(3)) for p in "ab"), _PLANES)
    return rows.select("id", F.round(first, 9).alias("first"), F.round(last, 9).alias("last"))
