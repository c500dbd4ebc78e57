"""Queries of record stores, hierarchies and dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.catalog import query
from tilewright.functions.bits import right
from tilewright.functions.hashing import OFFSET, PRIME, fnv1a64_hex
from tilewright.operators import loops
from tilewright.sources.tables import TILES_SQL, table
from tilewright.sources.tables import tiles as tile_table

_RECORDS_SQL = "(select p_partkey as key, p_name || ':' || p_size as payload from part where p_partkey % 3 <> 0)"
_REQUESTS_SQL = "(select event_id as seq, user_id as consumer, event_id * 7 % (select max(p_partkey) + 10 from part) as key from events)"


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(key, payload): two of three parts have a record."""
    return table(spark, folder, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("key"), F.concat_ws(":", "p_name", F.col("p_size").cast("string")).alias("payload"))


def requests(spark: SparkSession, folder: str) -> DataFrame:
    top = table(spark, folder, "part").agg((F.max("p_partkey") + 10).alias("top"))
    return table(spark, folder, "events").crossJoin(F.broadcast(top)).select(F.col("event_id").alias("seq"), F.col("user_id").alias("consumer"), (F.col("event_id") * 7 % F.col("top")).alias("key"))


@query(
    "record_fetch",
    f"select seq, q.key, case when payload is not null then 'found' when p_partkey is not null then 'absent' else 'error' end as status, length(payload)::int as bytes from {_REQUESTS_SQL} q left join {_RECORDS_SQL} r on r.key = q.key left join part on p_partkey = q.key",
)
def record_fetch(spark: SparkSession, folder: str) -> DataFrame:
    """Requests joined to records.  A key without a record is absent only if its
    absence is confirmed (here: the part exists); any other is an error."""
    confirmed = table(spark, folder, "part").select(F.col("p_partkey").alias("key"), F.lit(True).alias("known"))
    rows = requests(spark, folder).join(records(spark, folder), "key", "left").join(confirmed, "key", "left")
    status = F.when(F.col("payload").isNotNull(), "found").when(F.col("known"), "absent").otherwise("error")
    return rows.select("seq", "key", status.alias("status"), F.length("payload").alias("bytes"))


@query("record_range", f"select key, length(payload)::int as bytes from {_RECORDS_SQL} where key >= 50 and key < 150")
def record_range(spark: SparkSession, folder: str) -> DataFrame:
    """A range of keys, from the lower bound (included) to the upper (not included)."""
    return records(spark, folder).where("key >= 50 and key < 150").select("key", F.length("payload").alias("bytes"))


@query(
    "record_checksums",
    f"select key, format('{{:016x}}', list_reduce([{OFFSET}::hugeint] || list_transform(range(1, length(payload) + 1), lambda n: ascii(substr(payload, n::int, 1))::hugeint), lambda a, b: (xor(a, b) * {PRIME}::hugeint) % 18446744073709551616::hugeint)::ubigint) as fnv, 'fnv1a64-' || fnv || '-' || length(payload) as etag from {_RECORDS_SQL}",
)
def record_checksums(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(spark, folder).withColumn("fnv", fnv1a64_hex(F.col("payload").cast("binary")))
    return rows.select("key", "fnv", F.concat(F.lit("fnv1a64-"), "fnv", F.lit("-"), F.octet_length("payload").cast("string")).alias("etag"))


_FNV_SQL = "list_reduce([{o}::hugeint] || list_transform(range(1, length({t}) + 1), lambda n: ascii(substr({t}, n::int, 1))::hugeint), lambda a, b: (xor(a, b) * {p}::hugeint) % 18446744073709551616::hugeint)"


@query(
    "payload_validation",
    f"""with sent as (select key, payload, case when key % 5 = 0 then payload || 'x' when key % 7 = 0 then '#' || substr(payload, 2) else payload end as got from {_RECORDS_SQL})
select key, case when length(got) <> length(payload) then 'length' when {_FNV_SQL.format(o=OFFSET, p=PRIME, t="got")} <> {_FNV_SQL.format(o=OFFSET, p=PRIME, t="payload")} then 'checksum' else 'ok' end as status from sent""",
)
def payload_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Declared lengths and checksums against payloads as they arrive, length first;
    every fifth payload has grown, and the first letter of every seventh is another."""
    rows = records(spark, folder).withColumn("declared", fnv1a64_hex(F.col("payload").cast("binary")))
    got = F.when(F.col("key") % 5 == 0, F.concat("payload", F.lit("x"))).when(F.col("key") % 7 == 0, F.concat(F.lit("#"), F.expr("substr(payload, 2)"))).otherwise(F.col("payload"))
    rows = rows.select("key", "declared", F.octet_length("payload").alias("size"), got.alias("got")).withColumn("fnv", fnv1a64_hex(F.col("got").cast("binary")))
    status = F.when(F.octet_length("got") != F.col("size"), "length").when(F.col("fnv") != F.col("declared"), "checksum").otherwise("ok")
    return rows.select("key", status.alias("status"))


@query(
    "dependency_closure",
    f"""with recursive need as (select level, row, col from {TILES_SQL} where level >= 7
union select level - 1, y, x from (select level, unnest([row >> 1, least((row + 1) >> 1, (1 << level) - 1)])::int as y, unnest([col >> 1, least((col + 1) >> 1, (2 << level) - 1)])::int as x from need where level > 0))
select level, count(*) as nodes from need group by level""",
)
def dependency_closure(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes needed for the finest tiles when each needs two parents: its own, and
    the one beside it; shared parents count once."""

    def parents(rows: DataFrame) -> DataFrame:
        level, row, col = F.col("level"), F.col("row"), F.col("col")
        last_row, last_col = F.call_function("shiftleft", F.lit(1), level) - 1, F.call_function("shiftleft", F.lit(2), level) - 1
        one = F.struct(right(row, 1).alias("row"), right(col, 1).alias("col"))
        two = F.struct(F.least(right(row + 1, 1), last_row).alias("row"), F.least(right(col + 1, 1), last_col).alias("col"))
        return rows.where(level > 0).select((level - 1).alias("level"), F.explode(F.array(one, two)).alias("p")).select("level", "p.row", "p.col")

    seed = tile_table(spark, folder).where("level >= 7").select("level", "row", "col")
    return loops.closure(seed, parents, 12).groupBy("level").agg(F.count("*").alias("nodes"))


_RESIDENT = f"(select distinct level, row, col from {TILES_SQL})"


@query(
    "available_cut",
    f"""with recursive have as {_RESIDENT}, groups as (select level, row >> 1 as r, col >> 1 as c, count(*) = 4 as whole from have where level > 0 group by all),
ok as (select level, row, col from have where level = 0 union select h.level, h.row, h.col from have h join ok p on h.level = p.level + 1 and (h.row >> 1) = p.row and (h.col >> 1) = p.col join groups g on g.level = h.level and g.r = p.row and g.c = p.col and g.whole)
select level, count(*) as tiles from ok group by level""",
)
def available_cut(spark: SparkSession, folder: str) -> DataFrame:
    """Tiles available from the roots: a group of four siblings is when all are
    there and their parent is."""
    have = tile_table(spark, folder).select("level", "row", "col").distinct()
    up = [right(F.col("row"), 1).alias("p_row"), right(F.col("col"), 1).alias("p_col")]
    whole = have.where("level > 0").groupBy("level", *up).count().where("count = 4").drop("count")

    def step(rows: DataFrame) -> DataFrame:
        kids = whole.join(rows.select((F.col("level") + 1).alias("level"), F.col("row").alias("p_row"), F.col("col").alias("p_col")), ["level", "p_row", "p_col"], "left_semi")
        pair = F.sequence(F.lit(0), F.lit(1))
        grown = kids.withColumn("dy", F.explode(pair)).withColumn("dx", F.explode(pair))
        return grown.select("level", (F.col("p_row") * 2 + F.col("dy")).cast("int").alias("row"), (F.col("p_col") * 2 + F.col("dx")).cast("int").alias("col"))

    return loops.closure(have.where("level = 0"), step, 30).groupBy("level").agg(F.count("*").alias("tiles"))


@query(
    "deepest_available",
    f"with have as {_RESIDENT}, up as (select id, level, unnest(range(0, level + 1))::int as n, row, col from {TILES_SQL}) select id, max(u.level - n) as shown from up u join have h on h.level = u.level - n and h.row = (u.row >> n) and h.col = (u.col >> n) and (h.row + h.col) % 2 = 0 group by id",
)
def deepest_available(spark: SparkSession, folder: str) -> DataFrame:
    """For each tile the deepest of itself and its ancestors that is there (here: resident with an even place)."""
    rows = tile_table(spark, folder)
    have = rows.where("(row + col) % 2 = 0").select("level", "row", "col").distinct()
    up = rows.select("id", "level", "row", "col", F.explode(F.sequence(F.lit(0), F.col("level"))).alias("n"))
    asks = up.select("id", (F.col("level") - F.col("n")).alias("level"), right(F.col("row"), F.col("n")).alias("row"), right(F.col("col"), F.col("n")).alias("col"))
    return asks.join(have, ["level", "row", "col"]).groupBy("id").agg(F.max("level").alias("shown"))


@query("changed_keys", "select * from (select o_custkey as key, 'removed' as change from orders where o_orderstatus = 'O' except select o_custkey, 'removed' from orders where o_orderstatus = 'F') union all select * from (select o_custkey as key, 'added' as change from orders where o_orderstatus = 'F' except select o_custkey, 'added' from orders where o_orderstatus = 'O')")
def changed_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The symmetric difference of two key sets, by one full outer join."""
    o = table(spark, folder, "orders")
    before = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("key")).distinct().withColumn("a", F.lit(1))
    after = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key")).distinct().withColumn("b", F.lit(1))
    return before.join(after, "key", "full_outer").where("a is null or b is null").select("key", F.when(F.col("b").isNull(), "removed").otherwise("added").alias("change"))


@query("imagery_cut_sizes", f"with n as (select level, row, col, count(*) as users, sum(1.0e0 / (1 << level)) as error from {TILES_SQL} group by all) select level, count(*) as nodes, count(distinct (row + col) % 100) as resources, sum(users)::bigint as users, round(max(error), 9) as worst from n group by level")
def imagery_cut_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes, distinct shared resources and the worst error of each level of a cut."""
    n = tile_table(spark, folder).groupBy("level", "row", "col").agg(F.count("*").alias("users"), F.sum(1.0 / F.pow(F.lit(2.0), "level")).alias("error"))
    return n.groupBy("level").agg(F.count("*").alias("nodes"), F.countDistinct((F.col("row") + F.col("col")) % 100).alias("resources"), F.sum("users").alias("users"), F.round(F.max("error"), 9).alias("worst"))
