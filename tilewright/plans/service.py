"""Queries of the delivery and text side: routes, manifests, validation, redaction, weather."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.catalog import query
from tilewright.functions import geo
from tilewright.sources.tables import table

# request paths from events: known, unknown, malformed and with other methods
_PATH = """case event_id % 6 when 0 then '/v1/datasets/globe/manifest' when 1 then '/v1/datasets/globe/roots/' || event_id % 8 || '/0/1' when 2 then '/v1/datasets/globe/patches/' || event_id % 50 || '/x/3' when 3 then '/v1/datasets/other/manifest' when 4 then '/v1/datasets/globe/patches/' || event_id % 50 || '/2/3' else '/v1/../etc' end"""
_METHOD = "case when event_id % 11 = 0 then 'POST' when event_id % 5 = 0 then 'HEAD' else 'GET' end"


@query(
    "service_routes",
    f"""with r as (select event_id as seq, {_METHOD} as method, {_PATH} as path, string_split({_PATH}, '/') as p from events)
select seq, case when method not in ('GET', 'HEAD') then 405 when len(p) < 5 or p[2] <> 'v1' or p[3] <> 'datasets' or contains(path, '..') then 404 when p[4] <> 'globe' then 404 when p[5] = 'manifest' and len(p) = 5 then 200
 when p[5] in ('roots', 'patches') and len(p) = 8 then case when regexp_full_match(p[6], '-?[0-9]{{1,9}}') and regexp_full_match(p[7], '-?[0-9]{{1,9}}') and regexp_full_match(p[8], '-?[0-9]{{1,9}}') then case when p[6]::int % 4 = 3 then 404 else 200 end else 400 end else 404 end as status from r""",
)
def service_routes(spark: SparkSession, folder: str) -> DataFrame:
    """The status of each request: method, path, dataset, key, and whether the record is there."""
    rows = table(spark, folder, "events").select(F.col("event_id").alias("seq"), F.expr(_METHOD).alias("method"), F.expr(_PATH).alias("path"))
    p = F.split("path", "/")

    def number(k: int) -> Column:
        return F.get(p, F.lit(k)).rlike("^-?[0-9]{1,9}$")

    key = F.when(number(5) & number(6) & number(7), F.when(F.get(p, F.lit(5)).try_cast("int") % 4 == 3, 404).otherwise(200)).otherwise(400)
    bad = (F.size(p) < 5) | (F.get(p, F.lit(1)) != "v1") | (F.get(p, F.lit(2)) != "datasets") | F.contains("path", F.lit(".."))
    status = (
        F.when(~F.col("method").isin("GET", "HEAD"), 405).when(bad, 404).when(F.get(p, F.lit(3)) != "globe", 404)
        .when((F.get(p, F.lit(4)) == "manifest") & (F.size(p) == 5), 200).when(F.get(p, F.lit(4)).isin("roots", "patches") & (F.size(p) == 8), key).otherwise(404)
    )
    return rows.select("seq", status.cast("int").alias("status"))


_URLS = "(select doc_id, 'https://tile.example.com/' || doc_id || '?tk=secret' || doc_id || '&x=1 Token: abc.' || doc_id || ' plain=' || source as text from documents)"


@query("redacted_texts", f"select doc_id, regexp_replace(regexp_replace(text, '([?&](?:tk|token|access_token)=)[^&#\\s]+', '\\1[redacted]', 'gi'), '\\b(tk|token|access_token)(\\s*[:=]\\s*)[A-Za-z0-9._-]+', '\\1\\2[redacted]', 'gi') as text from {_URLS}")
def redacted_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Values of access tokens masked, in urls and in free text."""
    d = table(spark, folder, "documents")
    text = F.concat(F.lit("https://tile.example.com/"), "doc_id", F.lit("?tk=secret"), "doc_id", F.lit("&x=1 Token: abc."), "doc_id", F.lit(" plain="), "source")
    once = F.regexp_replace(text, r"(?i)([?&](?:tk|token|access_token)=)[^&#\s]+", "$1[redacted]")
    return d.select("doc_id", F.regexp_replace(once, r"(?i)\b(tk|token|access_token)(\s*[:=]\s*)[A-Za-z0-9._-]+", "$1$2[redacted]").alias("text"))


@query("page_hosts", r"select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host, url like 'https://%' as allowed, regexp_replace(url, '[?#].*$', '') as path from pages")
def page_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of resource urls, and whether the scheme is allowed."""
    u = F.col("url")
    return table(spark, folder, "pages").select("page_id", F.regexp_extract(u, "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract(u, "^[a-z]+://([^/:?#]+)", 1).alias("host"), u.startswith("https://").alias("allowed"), F.regexp_replace(u, "[?#].*$", "").alias("path"))


_META = """(select o_orderkey as id, case when o_orderkey % 17 = 0 then 2 else 1 end as version, case when o_orderkey % 13 = 0 then 63 else (2 << (o_orderkey % 12)::int) end::int as patch, case when o_orderkey % 11 = 0 then 0.0e0 else 0.015625e0 end as scale, case when o_orderkey % 19 = 0 then '' else 'EPSG:4326' end as srs,
  case o_orderkey % 3 when 0 then 'planar' when 1 then 'globe' else case when o_orderkey % 23 = 0 then 'cone' else 'globe' end end as kind, case when o_orderkey % 29 = 0 then 170.0e0 else 180.0e0 end as east, case when o_orderkey % 3 = 0 then 0.0e0 else 6378000.0e0 end as radius from orders)"""


@query(
    "metadata_status",
    f"select id, case when version <> 1 then 'version' when patch < 2 or patch > 4096 or (patch & (patch - 1)) <> 0 then 'patch' when scale <= 0 then 'scale' when srs = '' then 'srs' when kind not in ('planar', 'globe') then 'transform' when kind = 'planar' and radius <> 0 then 'radius' when kind = 'globe' and east <> 180 then 'bounds' when kind = 'globe' and radius <= 0 then 'radius' else 'ok' end as status from {_META}",
)
def metadata_status(spark: SparkSession, folder: str) -> DataFrame:
    """The first check that a dataset's metadata fail."""
    o = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(
        o.alias("id"), F.when(o % 17 == 0, 2).otherwise(1).alias("version"), F.when(o % 13 == 0, 63).otherwise(F.call_function("shiftleft", F.lit(2), (o % 12).cast("int"))).alias("patch"),
        F.when(o % 11 == 0, 0.0).otherwise(0.015625).alias("scale"), F.when(o % 19 == 0, "").otherwise("EPSG:4326").alias("srs"),
        F.when(o % 3 == 0, "planar").when((o % 3 == 2) & (o % 23 == 0), "cone").otherwise("globe").alias("kind"), F.when(o % 29 == 0, 170.0).otherwise(180.0).alias("east"), F.when(o % 3 == 0, 0.0).otherwise(6378000.0).alias("radius"),
    )
    return rows.select("id", metadata_check(*(F.col(c) for c in ("version", "patch", "scale", "srs", "kind", "east", "radius"))).alias("status"))


def metadata_check(version: Column, patch: Column, scale: Column, srs: Column, kind: Column, east: Column, radius: Column) -> Column:
    globe = kind == "globe"
    tests = (
        ("version", version != 1), ("patch", (patch < 2) | (patch > 4096) | (patch.bitwiseAND(patch - 1) != 0)), ("scale", F.isnan(scale) | (scale <= 0)), ("srs", srs == ""),
        ("transform", ~kind.isin("planar", "globe")), ("radius", ~globe & (radius != 0)), ("bounds", globe & (east != 180)), ("radius", globe & (radius <= 0)),
    )
    out = F.lit("ok")
    for name, failed in reversed(tests):
        out = F.when(failed, name).otherwise(out)
    return out


@query("manifests", """select r_regionkey as id, '{"schema":"tileset","schema_version":1,"dataset_id":"' || lower(r_name) || '","levels":{"minimum":0,"maximum":' || (20 + r_regionkey) || '}}' as manifest from region""")
def manifests(spark: SparkSession, folder: str) -> DataFrame:
    body = F.struct(F.lit("tileset").alias("schema"), F.lit(1).alias("schema_version"), F.lower("r_name").alias("dataset_id"), F.struct(F.lit(0).alias("minimum"), (20 + F.col("r_regionkey")).alias("maximum")).alias("levels"))
    return table(spark, folder, "region").select(F.col("r_regionkey").alias("id"), F.to_json(body).alias("manifest"))


@query("tilemap_configs", "select n_nationkey as id, n_name as title, 10 + n_nationkey as max_level, round(360.0e0 / 256 / (1 << (n_nationkey % 10)), 12) as units_per_pixel from nation")
def tilemap_configs(spark: SparkSession, folder: str) -> DataFrame:
    """Configurations written as XML, parsed again."""
    xml = F.format_string('<tilemap><title>%s</title><levels max="%d"/><size>256</size></tilemap>', "n_name", 10 + F.col("n_nationkey"))
    rows = table(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), xml.alias("xml"))
    size = F.xpath_int("xml", F.lit("/tilemap/size"))
    return rows.select("id", F.xpath_string("xml", F.lit("/tilemap/title")).alias("title"), F.xpath_int("xml", F.lit("/tilemap/levels/@max")).alias("max_level"), F.round(360.0 / size / F.pow(F.lit(2.0), F.col("id") % 10), 12).alias("units_per_pixel"))


_REPORTS = """(select c_custkey as id, printf('ABCD %02d%02d30Z %03d%02dKT 9999 %s%02d/M%02d Q%04d', c_custkey % 28 + 1, c_custkey % 24, c_custkey * 10 % 360, c_custkey % 70, case when c_custkey % 4 = 0 then 'M' else '' end, c_custkey % 30, c_custkey % 9, 980 + c_custkey % 60) as report from customer)"""


def reports(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("c_custkey")
    text = F.format_string("ABCD %02d%02d30Z %03d%02dKT 9999 %s%02d/M%02d Q%04d", c % 28 + 1, c % 24, c * 10 % 360, c % 70, F.when(c % 4 == 0, "M").otherwise(""), c % 30, c % 9, 980 + c % 60)
    return table(spark, folder, "customer").select(c.alias("id"), text.alias("report"))


def parse_report(report: Column) -> dict[str, Column]:
    """Fields of a METAR report; null where a group is missing."""

    def part(pattern: str, group: int = 1) -> Column:
        found = F.regexp_extract(report, pattern, group)
        return F.when(found != "", found)

    def signed(pattern: str) -> Column:
        v = part(pattern)
        return F.when(v.startswith("M"), -F.substring(v, 2, 2).cast("int")).otherwise(F.regexp_replace(v, "M", "").cast("int"))

    time = r"(?:^| )(\d{2})(\d{2})(\d{2})Z(?= |$)"
    wind = r"(?:^| )(\d{3}|VRB)(\d{2,3})(?:G(\d{2,3}))?KT(?= |$)"
    temperature = r"(?:^| )(M?\d{2})/(M?\d{2})(?= |$)"
    return {
        "station": part(r"(?:^| )([A-Z]{4})(?= |$)"),
        "day": part(time).cast("int"), "hour": part(time, 2).cast("int"), "minute": part(time, 3).cast("int"),
        "direction": F.when(part(wind) != "VRB", part(wind)).try_cast("int"), "speed": part(wind, 2).cast("int"), "gust": part(wind, 3).cast("int"),
        "visibility": F.when(F.contains(report, F.lit("CAVOK")), 10000).otherwise(part(r"(?: )(\d{4})(?= |$)").cast("int")),
        "temperature": signed(temperature), "dew": signed(r"(?:^| )M?\d{2}/(M?\d{2})(?= |$)"), "pressure": part(r"(?: )Q(\d{4})(?= |$)").cast("int"),
    }


_SECTOR_SQL = "[" + ", ".join(f"'{s}'" for s in geo.SECTORS) + "]"
_BEAUFORT_SQL = "case " + " ".join(f"when speed <= {top} then {n}" for n, top in enumerate(geo.BEAUFORT)) + " else 12 end"
_VP = "(6.112e0 * 10.0e0 ** (7.5e0 * {t} / (237.7e0 + {t})))"


@query(
    "weather_reports",
    f"""with w as (select id, 'ABCD' as station, (id % 28 + 1)::int as day, (id % 24)::int as hour, 30 as minute, (id * 10 % 360)::int as direction, (id % 70)::int as speed, case when id % 4 = 0 then -(id % 30) else id % 30 end::int as temperature, -(id % 9)::int as dew, (980 + id % 60)::int as pressure from {_REPORTS})
select *, {_SECTOR_SQL}[floor(direction / 22.5e0)::int % 16 + 1] as sector, {_BEAUFORT_SQL} as beaufort, round(100 * {_VP.format(t='dew')} / {_VP.format(t='temperature')}, 6) as humidity, round(temperature + 5.0e0 / 9 * ({_VP.format(t='dew')} - 10), 6) as humidex,
  round(case when temperature <= 10 and speed * 1.852e0 > 4.8e0 then 13.12e0 + 0.6215e0 * temperature - 11.37e0 * (speed * 1.852e0) ** 0.16e0 + 0.3965e0 * temperature * (speed * 1.852e0) ** 0.16e0 else temperature end, 6) as chill from w""",
)
def weather_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Reports parsed, with wind names, Beaufort numbers and derived quantities."""
    fields = parse_report(F.col("report"))
    names = ("station", "day", "hour", "minute", "direction", "speed", "temperature", "dew", "pressure")
    w = reports(spark, folder).select("id", *[fields[n].alias(n) for n in names])
    t, d, kmh = F.col("temperature").cast("double"), F.col("dew").cast("double"), F.col("speed") * 1.852
    return w.select(
        "id", *names, geo.wind_sector(F.col("direction")).alias("sector"), geo.beaufort(F.col("speed")).alias("beaufort"), F.round(geo.relative_humidity(t, d), 6).alias("humidity"),
        F.round(geo.humidex(t, d), 6).alias("humidex"), F.round(geo.wind_chill(t, kmh), 6).alias("chill"),
    )


@query("readable_sizes", "select o_orderkey as id, case when o_orderkey * 997 < 1024 then (o_orderkey * 997) || ' B' when o_orderkey * 997 < 1048576 then round(o_orderkey * 997 / 1024.0e0, 1) || ' KiB' else round(o_orderkey * 997 / 1048576.0e0, 1) || ' MiB' end as size from orders")
def readable_sizes(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("o_orderkey") * 997
    text = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(F.round(n / 1024.0, 1).cast("string"), F.lit(" KiB"))).otherwise(F.concat(F.round(n / 1048576.0, 1).cast("string"), F.lit(" MiB")))
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), text.alias("size"))


@query("valid_pois", "select p_partkey as id, regexp_full_match(p_brand, '[A-Za-z0-9#_ -]{1,64}') and p_retailprice >= 0 and count(*) over (partition by p_partkey) = 1 as valid from part")
def valid_pois(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    alone = F.count("*").over(Window.partitionBy("p_partkey")) == 1
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), (F.col("p_brand").rlike("^[A-Za-z0-9#_ -]{1,64}$") & (F.col("p_retailprice") >= 0) & alone).alias("valid"))


