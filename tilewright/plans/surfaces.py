"""Queries of height surfaces: one root a supplier, its samples the line items'."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.catalog import query
from tilewright.operators import diamonds, surfaces
from tilewright.sources.tables import table

_HALF, _N, _LEVELS, _TOLERANCE, _UNIT = 16, 4, 4, 2, 100.0
_SIDE = 2 * _HALF


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """(root, px, py, value) of the places that line items stand for."""
    i = table(spark, folder, "lineitem")
    px, py = F.col("l_partkey") * 13 % (_SIDE + 1), (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % (_SIDE + 1)
    rows = i.select(F.col("l_suppkey").cast("long").alias("root"), px.cast("long").alias("px"), py.cast("long").alias("py"), (px * 40 + py * 25 + F.col("l_orderkey") % 97).cast("long").alias("value"))
    return rows.groupBy("root", "px", "py").agg(F.max("value").alias("value"))


def roots(spark: SparkSession, folder: str) -> DataFrame:
    """(root): those that have samples."""
    return table(spark, folder, "lineitem").select(F.col("l_suppkey").cast("long").alias("root")).distinct()


def touched(spark: SparkSession, folder: str, flag: str, quantity: int) -> DataFrame:
    """(root, level, x, y) of diamonds in which certain line items lie."""
    rows = table(spark, folder, "lineitem").where((F.col("l_returnflag") == flag) & (F.col("l_quantity") == quantity) & (F.col("l_partkey") % 5 == 0))
    rows = rows.select(F.col("l_suppkey").cast("long").alias("root"), ((F.col("l_linenumber") - 1) % (_LEVELS + 1)).cast("int").alias("level"), (F.col("l_partkey") * 13 % (_SIDE + 1)).alias("px"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % (_SIDE + 1)).alias("py"))
    x, y = diamonds.locate(F.col("level"), F.col("px"), F.col("py"), _HALF)
    return rows.select("root", "level", x.alias("x"), y.alias("y")).distinct()


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all roots as they can be fetched: some are known to hold no details, some are lost."""
    built = surfaces.build(samples(spark, folder), _HALF, _N, _LEVELS, _TOLERANCE, roots=roots(spark, folder))
    lost, absent = touched(spark, folder, "R", 50).checkpoint(), touched(spark, folder, "A", 49).withColumn("absent", F.lit(True)).checkpoint()
    kept = built.join(lost, surfaces.KEY, "left_anti").join(absent, surfaces.KEY, "left")
    return kept.withColumn("codes", F.when(F.col("absent").isNull(), F.col("codes")))


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """(id, root, px, py, wanted): for each order a height at the supplier of its last item."""
    k = F.col("id")
    orders = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("id")).agg(F.max("l_suppkey").cast("long").alias("root"), F.max("l_partkey").alias("part"))
    return orders.select("id", "root", (k * 7919 % 32001 / F.lit(1000.0)).alias("px"), (k * 104729 % 32001 / F.lit(1000.0)).alias("py"), (100.0 * F.pow(F.lit(2.0), F.col("part") % 5)).alias("wanted"))


# The same in SQL: no patches and index maps, but places, level by level.

def _s(level: int) -> int:
    return _HALF >> (level >> 1)


def _places(level: int, centres: bool = False) -> str:
    """SQL of (i, j, ox, oy): the places of a diamond's corners or centres from its own."""
    n, step, c = _N, _s(level) // _N, "0.5e0" if centres else "0"
    ox, oy = (f"i - j", f"i + j + 2 * {c} - {n}") if level % 2 else (f"2 * (i + {c}) - {n}", f"2 * (j + {c}) - {n}")
    return f"(select i, j, (({ox}) * {step})::bigint as ox, (({oy}) * {step})::bigint as oy from (select unnest(range({n + (not centres)})) as i), (select unnest(range({n + (not centres)})) as j))"


def _div(v: str, by: int) -> str:
    return f"(case when {v} > 0 then ({v} + {by // 2}) // {by} else -((-({v}) + {by // 2}) // {by}) end)"


def _sum(name: str, width: int, places: list[tuple[int, int]], i: str = "k % 4", j: str = "k // 4") -> str:
    return "(" + " + ".join(f"{name}[({j} + {b}) * {width} + {i} + {a} + 1]" for a, b in places) + ")"


_NEAR = [(a, b) for a in (0, 1) for b in (0, 1)]
_RING = [(-1, 0), (-1, 1), (0, -1), (1, -1), (0, 2), (1, 2), (2, 0), (2, 1)]


def _predicted(p: str) -> str:
    near = _sum(p, 5, _NEAR)
    return f"case when k % 4 between 1 and 2 and k // 4 between 1 and 2 then {_div(f'(10 * {near} - {_sum(p, 5, _RING)})', 32)} else {_div(near, 4)} end"


def _gain(d: str) -> str:
    four = _sum(d, 4, [(-a, -b) for a, b in _NEAR], "k % 5", "k // 5")
    return f"case when k % 5 between 1 and 3 and k // 5 between 1 and 3 then {_div(four, 8)} else 0 end"


def _cells(level: int) -> str:
    s, m = _s(level), _SIDE // _s(level) + 1
    which = "a % 2 <> b % 2" if level % 2 else "a % 2 = 1 and b % 2 = 1"
    return f"(select root, a * {s} as x, b * {s} as y from (select distinct root from samples), (select unnest(range({m})) as a), (select unnest(range({m})) as b) where {which})"


_SAMPLES_SQL = f"""samples as (select root, px, py, max(px * 40 + py * 25 + o % 97) as v from (
  select l_suppkey::bigint as root, l_partkey * 13 % {_SIDE + 1} as px, (l_orderkey * 7 + l_linenumber) % {_SIDE + 1} as py, l_orderkey as o from lineitem) group by all)"""


def _built() -> str:
    """SQL of b0 to b4: (root, x, y, p, q, details, codes, back, low) of each level."""
    out = _SAMPLES_SQL + f", f{_LEVELS + 1} as (select * from samples)"
    for level in range(_LEVELS, -1, -1):
        step = 2 * _TOLERANCE + 1 if level == _LEVELS else 1
        for name, centres in (("p", False), ("q", True)):
            inside = [f"case when {c} + {o} < 0 then -({c} + {o}) when {c} + {o} > {_SIDE} then {2 * _SIDE} - ({c} + {o}) else {c} + {o} end" for c, o in (("x", "ox"), ("y", "oy"))]
            out += f", {name}{level} as (select d.root, x, y, list(coalesce(v, 0) order by j, i) as {name} from (select *, {inside[0]} as px, {inside[1]} as py from {_cells(level)}, {_places(level, centres)}) d left join f{level + 1} using (root, px, py) group by d.root, x, y)"
        out += f", c{level} as (select *, list_transform(range(16), lambda k: q[k + 1] - {_predicted('p')}) as details from p{level} join q{level} using (root, x, y))"
        out += f", d{level} as (select *, list_transform(details, lambda v: {_div('v', step)}) as codes from c{level}), e{level} as (select *, list_transform(codes, lambda v: v * {step}) as back from d{level})"
        out += f", b{level} as (select *, list_transform(range(25), lambda k: p[k + 1] + {_gain('back')}) as low from e{level})"
        out += f", f{level} as (select root, x + ox as px, y + oy as py, min(low[j * 5 + i + 1]) as v from b{level}, {_places(level)} where x + ox between 0 and {_SIDE} and y + oy between 0 and {_SIDE} group by all)"
    return out


def _weighed(name: str, size: int) -> str:
    return f"list_sum(list_transform(range(1, {size + 1}), lambda k: {name}[k] * k))::bigint"


@query("surface_records", "with " + _built() + " " + " union all ".join(f"select root, {level} as level, x, y, {_weighed('low', 25)} as low, {_weighed('codes', 16)} as codes, {_TOLERANCE if level == _LEVELS else 0} as tolerance, 'ok' as status from b{level}" for level in range(_LEVELS + 1)))
def surface_records(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every diamond's record and low part, built from the leaves up to the roots."""

    def weighed(c: str):
        return F.aggregate(F.transform(c, lambda v, k: v * (k + 1)), F.lit(0).cast("long"), lambda s, v: s + v).alias(c)

    return surfaces.build(samples(spark, folder), _HALF, _N, _LEVELS, _TOLERANCE, roots=roots(spark, folder)).select("root", "level", "x", "y", weighed("low"), weighed("codes"), "tolerance", "status")


@query("surface_leaves", "with " + _built() + f" select root, x, y, list_max(list_transform(range(1, 17), lambda k: abs(back[k] - details[k])))::bigint as error, 'ok' as status from b{_LEVELS}")
def surface_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Builds all roots, reads them down again, and compares each leaf with its samples:
    corners come back exactly, centres within the tolerance."""
    given = samples(spark, folder)
    built = surfaces.build(given, _HALF, _N, _LEVELS, _TOLERANCE, roots=roots(spark, folder))
    _, leaves = surfaces.synthesise(built.where("level = 0").select("root", "low"), built, _HALF, _N, _LEVELS)
    leaf = surfaces.sampled_leaves(given, _HALF, _N, _LEVELS, roots=roots(spark, folder)).withColumnRenamed("matrix", "given")
    width = 2 * _N + 1

    def errors(name: str, side: int, odd: int):
        place = lambda k: F.floor(k / side).cast("int") * 2 * width + k % side * 2 + odd * (width + 1)
        return F.array_max(F.transform(name, lambda v, k: F.abs(v - F.get("given", place(k)))))

    rows = leaves.join(leaf, ["root", "x", "y"])  # both have every leaf
    return rows.select("root", "x", "y", F.greatest(errors("corners", _N + 1, 0), errors("centres", _N, 1)).alias("error"), "status")


def _located_sql(rows: str, level: str, px: str, py: str) -> str:
    """SQL of rows with x and y, the diamond of their level that holds them."""
    s = f"({_HALF} >> ({level} >> 1))"
    c = [f"((greatest(0, least(floor({v} / (2 * {s})), {_HALF} // {s} - 1)) * 2 + 1) * {s})" for v in (px, py)]
    wide = f"abs({px} - {c[0]}) >= abs({py} - {c[1]})"
    x = f"({c[0]} + case when {level} % 2 = 1 and {wide} then case when {px} < {c[0]} then -{s} else {s} end else 0 end)::bigint"
    y = f"({c[1]} + case when {level} % 2 = 1 and not ({wide}) then case when {py} < {c[1]} then -{s} else {s} end else 0 end)::bigint"
    return f"(select *, {x} as x, {y} as y from {rows})"


def _touched_sql(flag: str, quantity: int) -> str:
    rows = f"(select l_suppkey::bigint as root, ((l_linenumber - 1) % {_LEVELS + 1})::int as level, l_partkey * 13 % {_SIDE + 1} as px, (l_orderkey * 7 + l_linenumber) % {_SIDE + 1} as py from lineitem where l_returnflag = '{flag}' and l_quantity = {quantity} and l_partkey % 5 = 0)"
    return f"select distinct root, level, x, y from {_located_sql(rows, 'level', 'px', 'py')}"


def _rising(level: int) -> str:
    s = _s(level)
    return "true" if level == 0 else f"(x // {s}) % 2 = 1" if level % 2 else f"((x - {s}) // {_s(level - 1)} + (y - {s}) // {_s(level - 1)}) % 2 = 1"


def _read() -> str:
    """SQL of s0 to s4: (root, x, y, low, known and data level of both sides)."""
    out = f", lost as ({_touched_sql('R', 50)}), absent as ({_touched_sql('A', 49)})"
    out += ", s0 as (select b0.root, x, y, low, true as k0, true as k1, 0 as d0, 0 as d1 from b0 anti join lost on lost.root = b0.root and lost.level = 0)"
    for level in range(_LEVELS):
        s, t = _s(level), _s(level + 1)
        codes = "case when a.root is null then back else list_transform(back, lambda v: 0) end"
        edge = f"(s.x in (0, {_SIDE}) or s.y in (0, {_SIDE}))"
        out += f""", r{level} as (select s.root, s.x, s.y, s.low, k0, k1, d0, d1, a.root is not null as smooth, {codes} as back from s{level} s join b{level} b using (root, x, y)
  left join absent a on a.root = s.root and a.level = {level} and a.x = s.x and a.y = s.y
  anti join lost on lost.root = s.root and lost.level = {level} and lost.x = s.x and lost.y = s.y where case when {edge} then k0 or k1 else k0 and k1 end),
g{level} as (select *, list_transform(range(25), lambda k: low[k + 1] - {_gain('back')}) as p from r{level}), h{level} as (select *, list_transform(range(16), lambda k: back[k + 1] + {_predicted('p')}) as q from g{level}),
v{level} as (select root, x, y, x + ox as px, y + oy as py, p[j * 5 + i + 1] as v from h{level}, {_places(level)} union all select root, x, y, x + ox, y + oy, q[j * 4 + i + 1] from h{level}, {_places(level, True)})"""
        # children: where their centres lie, and on which side of the parent
        steps = f"(select * from (values {', '.join(f'({a}, {b})' for a, b in (((-t, -t), (t, -t), (-t, t), (t, t)) if level % 2 else ((0, -s), (-s, 0), (s, 0), (0, s))))}) o(dx, dy))"
        first = (f"case when {_rising(level)} then dy < 0 else dx < 0 end" if level % 2 else f"case when {_rising(level)} then dx + dy < 0 else dx - dy > 0 end")
        out += f", m{level} as (select root, x + dx as x, y + dy as y, x as fx, y as fy, (dy > 0 or dy = 0 and dx > 0) as lower, case when not smooth then {level + 1} when {first} then d0 else d1 end as d from h{level}, {steps} where x + dx between 0 and {_SIDE} and y + dy between 0 and {_SIDE})"
        mirror = [("ox", "-oy"), ("-ox", "oy")] if (level + 1) % 2 else [("-oy", "-ox"), ("oy", "ox")]
        mx, my = (f"case when {_rising(level + 1)} then {a} else {b} end" for a, b in zip(*mirror, strict=True))
        out += f""", w{level + 1} as (select *, {mx} as mx, {my} as my from m{level}, {_places(level + 1)}),
t{level + 1} as (select w.root, w.x, w.y, i, j, coalesce(min(a.v), min(b.v)) as v from w{level + 1} w left join v{level} a on a.root = w.root and a.x = w.fx and a.y = w.fy and a.px = w.x + ox and a.py = w.y + oy
  left join v{level} b on b.root = w.root and b.x = w.fx and b.y = w.fy and b.px = w.x + mx and b.py = w.y + my group by w.root, w.x, w.y, i, j),
u{level + 1} as (select root, x, y, bool_or(lower) as k0, bool_or(not lower) as k1, max(d) filter (lower) as d0, max(d) filter (not lower) as d1 from m{level} group by root, x, y),
s{level + 1} as (select root, x, y, list(v order by j, i) as low, any_value(k0) as k0, any_value(k1) as k1, any_value(d0) as d0, any_value(d1) as d1 from t{level + 1} join u{level + 1} using (root, x, y) group by root, x, y)"""
    return out


def _spacing_sql(level: str) -> str:
    return f"(case when {level} % 2 = 1 then 2.0e0 * ({_HALF} >> ({level} >> 1)) else 2.0e0 * sqrt(2.0e0) * ({_HALF} >> ({level} >> 1)) end / {_N} * {_UNIT})"


def _heights() -> str:
    asked = "(select id, root, id * 7919 % 32001 / 1000.0e0 as px, id * 104729 % 32001 / 1000.0e0 as py, 100.0e0 * pow(2.0e0, part % 5) as wanted from (select l_orderkey::bigint as id, max(l_suppkey)::bigint as root, max(l_partkey) as part from lineitem group by l_orderkey))"
    each = f"(select *, unnest(range({_LEVELS + 1}))::int as level from {asked})"
    patches = " union all ".join(f"select root, {level} as level, x, y, low, k0, k1, d0, d1, {_rising(level)} as rising from s{level}" for level in range(_LEVELS + 1))
    at = lambda i, j: f"low[(case when fb then 4 - ({j}) else {j} end) * 5 + (case when fa then 4 - ({i}) else {i} end) + 1]"
    return f"""with {_built()}{_read()},
patches as ({patches}),
asks as (select * from {_located_sql(each, 'level', 'px', 'py')} where level = 0 or {_spacing_sql('(level - 1)')} > wanted),
z1 as (select *, (px - x) / ({_HALF} >> (level >> 1)) as ex, (py - y) / ({_HALF} >> (level >> 1)) as ey from asks join patches using (root, level, x, y)),
z2 as (select *, greatest(0.0e0, least(4.0e0, case when level % 2 = 1 then (ex + ey + 1) / 2 else (ex + 1) / 2 end * 4)) as a, greatest(0.0e0, least(4.0e0, case when level % 2 = 1 then (ey - ex + 1) / 2 else (ey + 1) / 2 end * 4)) as b from z1),
z3 as (select *, case when rising then a + b when level % 2 = 1 then a + 4 - b else 4 - a + b end as along, along < 4 or along = 4 and k0 as first from z2),
z4 as (select *, (not rising and level % 2 = 0) = first as fa, (not rising and level % 2 = 1) = first as fb from z3 where case when first then k0 else k1 end),
z5 as (select *, case when fa then 4 - a else a end as u, case when fb then 4 - b else b end as w from z4),
z6 as (select *, floor(u)::int - case when floor(u) + floor(w) >= 4 and floor(u) > 0 then 1 else 0 end as i, floor(w)::int - case when floor(u) + floor(w) >= 4 and floor(u) = 0 then 1 else 0 end as j from z5),
z7 as (select id, level, case when first then d0 else d1 end as data_level, case when (u - i) + (w - j) <= 1 or i + j + 1 = 4 then {at('i', 'j')} * (1 - (u - i) - (w - j)) + {at('i + 1', 'j')} * (u - i) + {at('i', 'j + 1')} * (w - j)
  else {at('i + 1', 'j + 1')} * ((u - i) + (w - j) - 1) + {at('i + 1', 'j')} * (1 - (w - j)) + {at('i', 'j + 1')} * (1 - (u - i)) end as height from z6),
best as (select id, max(level) as level, arg_max(data_level, level) as data_level, arg_max(height, level) as height from z7 group by id)
select q.id, level, data_level, round(height, 6) as height, round({_spacing_sql('data_level')}, 3) as spacing, case when level is null then 'unavailable' when {_spacing_sql('data_level')} <= wanted then 'ready' else 'limited' end as state from {asked} q left join best using (id)"""


@query("surface_heights", _heights())
def surface_heights(spark: SparkSession, folder: str) -> DataFrame:
    """The height at every order's place, as fine as wanted where the records of all
    that it depends on could be fetched, else of the coarser patch that could be read."""
    found = records(spark, folder)
    rows = surfaces.answer(requests(spark, folder), found.where("level = 0").select("root", "low"), found, _HALF, _N, _LEVELS, _UNIT)
    return rows.select("id", "level", "data_level", F.round("height", 6).alias("height"), F.round("spacing", 3).alias("spacing"), "state")
