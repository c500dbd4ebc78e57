"""Queries of cuts of the globe: one camera a supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.catalog import query
from tilewright.functions import geo, grid
from tilewright.operators import globe_cut as cuts
from tilewright.plans.grid import roots
from tilewright.sources.tables import LAT_SQL, LON_SQL, latitude, longitude, table

R, H, Q = geo.RADIUS, grid.HALF, grid.HALF // 2
_THRESHOLD, _SAMPLES, _LEVELS, _HIGH = 0.06, 32, 7, 8000.0
_WIDE, _TALL, _NEAR, _FAR = 0.8, 0.5, 1000.0, 2e7


def cameras(spark: SparkSession, folder: str) -> DataFrame:
    """(camera, eye, planes): over each supplier, tilted to the north by up to 45 degrees."""
    s = F.col("s_suppkey")
    rows = table(spark, folder, "supplier").select(s.cast("long").alias("camera"), longitude(s).alias("lon"), latitude(s).alias("lat"), (200000.0 + s * 7919 % 40 * 100000).alias("h"), F.radians(s % 4 * 15.0).alias("tilt"))
    axes = geo.frame(F.col("lon"), F.col("lat"))
    rows = rows.select("camera", "tilt", F.array(*geo.xyz(F.col("lon"), F.col("lat"), F.col("h"))).alias("eye"), *(F.array(*v).alias(n) for n, v in axes.items()))
    mix = lambda a, p, b, q: F.array(*(F.col(a)[k] * p + F.col(b)[k] * q for k in range(3)))
    rows = rows.select("camera", "eye", F.col("east").alias("right"), mix("north", F.sin("tilt"), "up", -F.cos("tilt")).alias("ahead"), mix("north", F.cos("tilt"), "up", F.sin("tilt")).alias("above"))

    def plane(ahead: float, side: str, sign: float, back: float) -> list:
        n = [F.col("ahead")[k] * ahead + F.col(side)[k] * sign for k in range(3)]
        return [*n, -(n[0] * F.col("eye")[0] + n[1] * F.col("eye")[1] + n[2] * F.col("eye")[2]) + back]

    sides = [plane(w, c, s, 0.0) for c, w in (("right", _WIDE), ("above", _TALL)) for s in (1.0, -1.0)]
    return rows.select("camera", "eye", F.array(*(v for p in [*sides, plane(1.0, "above", 0.0, -_NEAR), plane(-1.0, "above", 0.0, _FAR)] for v in p)).alias("planes"))


# The same in SQL: all diamonds down to the last level first, then a closure over their edges.

_ROOTS = ", ".join(f"([{', '.join(str(v) for c in corners for v in grid.CYLINDER_POINTS[c])}])" for corners in grid.CYLINDER_ROOTS)


def _wrapped(p: str) -> str:
    def fold(a: str, b: str) -> tuple[str, str]:
        over = f"greatest({-Q} - {a}, {a} - {Q})"
        return f"greatest({-Q}, least({Q}, {a}))", f"case when {b} = {Q} then {b} - {over} when {b} = {-Q} then {b} + {over} else {b} end"

    i, k = f"{p}[1]", f"{p}[3]"
    (i1, k1), (k2, i2) = fold(i, k), fold(k, i)
    return f"case when abs({i}) > {Q} then [{i1}, {p}[2], {k1}] when abs({k}) > {Q} then [{i2}, {p}[2], {k2}] else {p} end"


def _lonlat(p: str) -> tuple[str, str]:
    along = f"case when {p}[3] = {Q} then {p}[1] + {Q} - 2.0e0 * {H} when {p}[1] = {Q} then {Q} - {p}[3] - 1.0e0 * {H} when {p}[3] = -{Q} then ({Q} - {p}[1])::double when {p}[1] = -{Q} then {p}[3] + {Q} + 1.0e0 * {H} else 0.0e0 end"
    return f"radians(({along}) * (90.0e0 / {H}))", f"radians({p}[2] * (90.0e0 / {H}))"


def _unit(p: str) -> str:
    a, b = _lonlat(p)
    return f"[sin({a}) * cos({b}), sin({b}), cos({a}) * cos({b})]"


def _dot(a: str, b: str) -> str:
    return f"({a}[1] * {b}[1] + {a}[2] * {b}[2] + {a}[3] * {b}[3])"


def _scaled(a: str) -> str:
    return f"list_transform({a}, lambda v: v / sqrt{_dot(a, a)})"


_GRAPH = f"""
dd as (
  select 0 as level, d from (values {_ROOTS}) r(d)
  union
  select level + 1, case when c = 0 then own || centre || near || ({_wrapped('far')}) else own || ({_wrapped('far')}) || near || centre end from (
    select *, list_transform([1, 2, 3], lambda a: 2 * mid[a] - centre[a]) as far from (
      select level, c, [(d[1] + d[7]) >> 1, (d[2] + d[8]) >> 1, (d[3] + d[9]) >> 1] as centre, d[6 * f + 4 : 6 * f + 6] as own, d[(6 * f + 6 * c) % 12 + 1 : (6 * f + 6 * c) % 12 + 3] as near,
        list_transform([1, 2, 3], lambda a: (d[6 * f + 3 * c + a] + d[(6 * f + 3 * c + 3) % 12 + a]) >> 1) as mid
      from dd, (select unnest([0, 1]) as f), (select unnest([0, 1]) as c) where level < {_LEVELS} and abs(d[6 * f + 5]) <= {H}))),
alld as (select level, d, [(d[1] + d[7]) >> 1, (d[2] + d[8]) >> 1, (d[3] + d[9]) >> 1] as id from dd),
edges as (select level, id, p from (select level, id, unnest([d[4:6], d[10:12]]) as p from alld where level > 0) where abs(p[2]) <= {H}),
shape as (select level, id, {_unit('id')} as z, {_unit('a')} as pa, {_unit('b')} as pb, {_unit('c')} as pc, {_unit('e')} as pe from (
  select level, id, d[1:3] as a, d[7:9] as c, case when abs(d[5]) <= {H} then d[4:6] else d[10:12] end as b, case when abs(d[11]) <= {H} then d[10:12] else d[4:6] end as e from alld)),
turned as (select *, {_scaled('g')} as edge from (select *, list_transform([1, 2, 3], lambda k: (pb[k] - pa[k]) * {R}) as g from shape)),
axes as (select *, {_scaled('g2')} as x from (select *, list_transform([1, 2, 3], lambda k: edge[k] - z[k] * {_dot('z', 'edge')}) as g2 from turned)),
framed as (select level, id, x, z, [-(x[2] * z[3] - x[3] * z[2]), -(x[3] * z[1] - x[1] * z[3]), -(x[1] * z[2] - x[2] * z[1])] as y, [z, pa, pb, pc, pe] as pts from axes),
spans as (select *, {', '.join(f"list_transform(pts, lambda p: {_dot('p', v)} * {R}) || list_transform(pts, lambda p: {_dot('p', v)} * ({R} + {_HIGH})) as s{v}" for v in 'xyz')} from framed),
box as (select level, id, x, y, z, {', '.join(f"(list_max(s{v}) - list_min(s{v})) / 2 as h{v}, (list_max(s{v}) + list_min(s{v})) / 2 as m{v}" for v in 'xyz')} from spans),
placed as (select *, list_transform([1, 2, 3], lambda k: x[k] * mx + y[k] * my + z[k] * mz) as o from box),
cam0 as (select s_suppkey::bigint as camera, radians({LON_SQL.format(k='s_suppkey')}) as a, radians({LAT_SQL.format(k='s_suppkey')}) as b, {R} + 200000.0e0 + s_suppkey * 7919 % 40 * 100000 as r, radians(s_suppkey % 4 * 15.0e0) as t from supplier),
cam1 as (select camera, t, [sin(a) * cos(b) * r, sin(b) * r, cos(a) * cos(b) * r] as eye, [sin(a) * cos(b), sin(b), cos(a) * cos(b)] as up, [-sin(a) * sin(b), cos(b), -cos(a) * sin(b)] as north, [cos(a), 0.0e0, -sin(a)] as "right" from cam0),
cam as (select camera, eye, "right", list_transform([1, 2, 3], lambda k: north[k] * sin(t) - up[k] * cos(t)) as ahead, list_transform([1, 2, 3], lambda k: north[k] * cos(t) + up[k] * sin(t)) as above from cam1),
planes as (select camera, eye, unnest([{', '.join(f"list_transform([1, 2, 3], lambda k: ahead[k] * {w} + {c}[k] * {s})" for c, w in (('"right"', _WIDE), ('above', _TALL)) for s in (1.0, -1.0))}, ahead, list_transform(ahead, lambda v: -v)]) as n, unnest([0.0e0, 0, 0, 0, {-_NEAR}, {_FAR}]) as back from cam),
seen as (select camera, level, id, bool_and({_dot('n', 'o')} - {_dot('n', 'eye')} + back + abs({_dot('n', 'x')}) * hx + abs({_dot('n', 'y')}) * hy + abs({_dot('n', 'z')}) * hz > 0) as visible from planes, placed group by all),
away as (select c.camera, p.*, eye, list_transform([1, 2, 3], lambda k: eye[k] - o[k]) as rel, {_scaled('g3')} as dir from (select camera, eye, p.level, p.id, list_transform([1, 2, 3], lambda k: o[k] - eye[k]) as g3 from cam, placed p) c join placed p using (level, id)),
far as (select *, sqrt({' + '.join(f"pow(greatest(abs({_dot('rel', v)}) - h{v}, 0), 2)" for v in 'xyz')}) as dist, abs({_dot('dir', 'x')}) * 4 * hy * hz + abs({_dot('dir', 'y')}) * 4 * hz * hx + abs({_dot('dir', 'z')}) * 4 * hx * hy as area from away),
sized as (select camera, level, id, visible, case when not visible then 0.0e0 when dist = 0 then {cuts.INSIDE} else sqrt(area) / ({_SAMPLES} * dist) end as priority from far join seen using (camera, level, id)),
steps as (select level as from_level, id as from_id, level - 1 as level, p as id, true as up from edges union all select level - 1, p, level, id, false from edges),
refined as (
  select camera, level, id from sized where level = 0 and priority > {_THRESHOLD} and level < {_LEVELS}
  union
  select r.camera, s.level, s.id from refined r join steps s on s.from_level = r.level and s.from_id = r.id join sized z on z.camera = r.camera and z.level = s.level and z.id = s.id
  where s.up or (z.priority > {_THRESHOLD} and z.level < {_LEVELS})),
made as (select camera, level, id from sized where level = 0 union select r.camera, e.level, e.id from refined r join edges e on e.level = r.level + 1 and e.p = r.id)"""


@query(
    "globe_cut",
    f"""with recursive {_GRAPH},
cutset as (select * from made anti join refined using (camera, level, id)),
side as (select c.camera, c.level, c.id, a.d, bool_or(r.camera is not null and r.id = a.d[4:6]) as s0, bool_or(r.camera is not null and r.id = a.d[10:12]) as s1 from cutset c join alld a using (level, id) left join refined r on r.camera = c.camera and r.level = c.level - 1 and (r.id = a.d[4:6] or r.id = a.d[10:12]) group by all)
select camera, level, id[1] as i, id[2] as j, id[3] as k, case when level = 0 then 3 else s0::int + 2 * s1::int end as sides, visible, round(priority, 6) as priority from side join sized using (camera, level, id)""",
)
def globe_cut(spark: SparkSession, folder: str) -> DataFrame:
    """For each camera the diamonds that show the globe as finely as the threshold asks."""
    rows = cuts.marked(cameras(spark, folder), _THRESHOLD, _SAMPLES, _LEVELS, 0.0, _HIGH).where("not refined")
    return rows.select(*cuts.KEY, "sides", "visible", F.round("priority", 6).alias("priority"))


@query("cut_requests", f"""with recursive {_GRAPH},
asked as (select camera, 'root' as kind, level, id from made where level = 0 union all select camera, 'detail', level, id from refined)
select kind, level, id[1] as i, id[2] as j, id[3] as k, count(*) as cameras, round(max(priority), 6) as priority from asked join sized using (camera, level, id) group by all""")
def cut_requests(spark: SparkSession, folder: str) -> DataFrame:
    """What all cuts need fetched: roots and details of refined diamonds, each once with its highest priority."""
    kinds = F.array_compact(F.array(F.when(F.col("level") == 0, "root"), F.when(F.col("refined"), "detail")))
    asked = cuts.marked(cameras(spark, folder), _THRESHOLD, _SAMPLES, _LEVELS, 0.0, _HIGH).withColumn("kind", F.explode(kinds))
    return asked.groupBy("kind", "level", "i", "j", "k").agg(F.count("*").alias("cameras"), F.round(F.max("priority"), 6).alias("priority"))


def _kids(source: str, sides: str) -> str:
    """SQL of (id, f, c, d): children of the diamonds of a table (id, d) for the given (f, c)."""
    return f"""(select id, f, c, case when c = 0 then own || centre || near || ({_wrapped('far')}) else own || ({_wrapped('far')}) || near || centre end as d from (
  select *, list_transform([1, 2, 3], lambda a: 2 * mid[a] - centre[a]) as far from (
    select id, f, c, [(d[1] + d[7]) >> 1, (d[2] + d[8]) >> 1, (d[3] + d[9]) >> 1] as centre, d[6 * f + 4 : 6 * f + 6] as own, d[(6 * f + 6 * c) % 12 + 1 : (6 * f + 6 * c) % 12 + 3] as near,
      list_transform([1, 2, 3], lambda a: (d[6 * f + 3 * c + a] + d[(6 * f + 3 * c + 3) % 12 + a]) >> 1) as mid from {source}, {sides})))"""


_EACH_SIDE = "(select unnest([0, 1]) as f), (select unnest([0, 1]) as c)"
_FLAT = ", ".join(f"d[{3 * n + k + 1}]::bigint as c{n}_{a}" for n in range(4) for k, a in enumerate(grid.AXES))


@query(
    "cylinder_children",
    f"""with r(root, d) as (values {', '.join(f'({n}, {text})' for n, text in enumerate(_ROOTS[1:-1].split('), (')))}),
s as (select s_suppkey as id, d, s_suppkey // 8 % 2 as f0, s_suppkey // 16 % 2 as c0 from supplier join r on root = s_suppkey % 8),
k as (select q.id, q.d from {_kids('s', _EACH_SIDE)} q join s on s.id = q.id and f = f0 and c = c0)
select id::bigint as id, f::int as side, c::int as child, {_FLAT} from {_kids('k', _EACH_SIDE)}""",
)
def cylinder_children(spark: SparkSession, folder: str) -> DataFrame:
    """The children of one child of a root for each supplier: round the edges of the faces, and beyond the poles."""
    s = F.col("s_suppkey")
    top = roots(spark).select(F.col("root").alias("r"), "d")
    rows = table(spark, folder, "supplier").withColumn("r", (s % 8).cast("int")).join(F.broadcast(top), "r")  # eight roots
    first = [grid.cylinder_child(F.col("d"), f, c) for f in (0, 1) for c in (0, 1)]
    which = F.floor(s / 8) % 2 * 2 + F.floor(s / 16) % 2
    rows = rows.select(s.cast("long").alias("id"), F.get(F.array(*first), which.cast("int")).alias("d"))
    kids = [F.struct(F.lit(f).alias("side"), F.lit(c).alias("child"), grid.cylinder_child(F.col("d"), f, c).alias("d")) for f in (0, 1) for c in (0, 1)]
    out = rows.select("id", F.explode(F.array(*kids)).alias("kid"))
    return out.select("id", "kid.side", "kid.child", *(F.col(f"kid.d.c{n}")[a].alias(f"c{n}_{a}") for n in range(4) for a in grid.AXES))
