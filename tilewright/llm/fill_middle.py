"""Fill-in-middle arrangements of whole texts, all in Spark's own functions.

A text is cut into an array of units by a pattern.  A hash of the document's id
gives two cuts, and so a prefix, a middle and a suffix, which are put in another
order behind sentinels.  Texts are parted at the sentinels to restore them: a
text that holds one itself stays plain, and as no end of a sentinel is the start
of one, none can arise where two pieces meet.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentinels before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 documents so many stay plain, and of 100 others so many begin with the suffix.
PLAIN, SUFFIX_FIRST = 10, 20
#: A unit: one code point.
UNIT = "."


def _number(group: int) -> Column:
    """The group of eight hexadecimal digits of the hash, as an unsigned number."""
    return F.conv(F.substring("hash", 1 + 8 * group, 8), 16, 10).cast("long")


def _joined(first: Column | int, count: Column) -> Column:
    return F.array_join(F.slice("units", F.lit(first) if isinstance(first, int) else first, count), "")


def _pattern(sentinels: tuple[str, str, str]) -> str:
    return "|".join(re.escape(s) for s in sentinels)


def arranged(docs: DataFrame, seed: int = 1, unit: str = UNIT, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Every document as doc_id, text, n (units), form (plain, psm or spm), prefix,
    middle, suffix (null if plain) and output.

    ``unit`` is a pattern without groups; what it doesn't match is cut into code
    points.  Cuts follow ``seed`` and doc_id alone, so repeated rows and other
    partitions give the same.  A null text is an empty one and plain; a null
    doc_id is hashed as no digits; very long texts stay whole, as one array of
    their units; further columns, whatever their names, aren't read; an empty
    table gives no rows."""
    if len(set(sentinels)) < 3 or any(a[k:] and b.startswith(a[k:]) for a in sentinels for b in sentinels for k in range(a == b, len(a))):
        raise ValueError(f"sentinels {sentinels} must differ and none may begin within another")
    before_prefix, before_suffix, before_middle = (F.lit(s) for s in sentinels)
    cut = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "text", F.regexp_extract_all("text", F.lit("(?s)." if unit == UNIT else f"(?s){unit}|."), F.lit(0)).alias("units"),
        F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).alias("hash"),
    )
    held = F.lit(False)
    for s in sentinels:
        held = held | F.contains("text", F.lit(s))
    n = F.size("units")
    at = [_number(k) % (n + 1) for k in (0, 1)]
    form = F.when((F.col("text") == "") | held | (_number(2) % 100 >= 100 - plain), "plain").when(_number(3) % 100 < suffix_first, "spm").otherwise("psm")
    chosen = cut.select("doc_id", "text", "units", n.cast("long").alias("n"), F.least(*at).cast("int").alias("first"), F.greatest(*at).cast("int").alias("second"), form.alias("form"))
    plain_form = F.col("form") == "plain"
    pieces = chosen.select(
        "doc_id", "text", "n", "form",
        F.when(~plain_form, _joined(1, F.col("first"))).alias("prefix"),
        F.when(~plain_form, _joined(F.col("first") + 1, F.col("second") - F.col("first"))).alias("middle"),
        F.when(~plain_form, _joined(F.col("second") + 1, F.greatest(n - F.col("second"), F.lit(0)))).alias("suffix"),
    )
    head, tail = F.concat(before_prefix, "prefix"), F.concat(before_suffix, "suffix")
    output = F.when(plain_form, F.col("text")).when(F.col("form") == "psm", F.concat(head, tail, before_middle, "middle")).otherwise(F.concat(tail, head, before_middle, "middle"))
    return pieces.withColumn("output", output)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text of an output: the pieces between its sentinels, in the text's order."""
    parts = F.split(output, _pattern(sentinels))
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    out = F.when(form == "plain", output)
    for name, places in order.items():
        out = out.when(form == name, F.concat(*(F.get(parts, F.lit(k)) for k in places)))
    return out


def digests(docs: DataFrame) -> DataFrame:
    """The arrangement of each document, and the text restored from it, as digests."""
    rows = arranged(docs).select("doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"), "output")
    texts = rows.withColumn("restored", restored(F.col("output"), F.col("form")))
    return texts.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def oracle_sql() -> str:
    return f"""
with docs as (
  select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
numbers as (
  select *, ('0x' || h[1:8])::ubigint % (n + 1) as a, ('0x' || h[9:16])::ubigint % (n + 1) as b, ('0x' || h[17:24])::ubigint % 100 as c, ('0x' || h[25:32])::ubigint % 100 as d from docs),
cuts as (
  select doc_id, text, n, least(a, b)::bigint as p, greatest(a, b)::bigint as q,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or c >= {100 - PLAIN} then 'plain' when d < {SUFFIX_FIRST} then 'spm' else 'psm' end as form from numbers),
pieces as (
  select *, substr(text, 1, p) as prefix, substr(text, p + 1, q - p) as middle, substr(text, q + 1) as suffix from cuts),
outputs as (
  select *, case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end as output from pieces),
places as (
  select *, instr(output, '<P>') as at_p, instr(output, '<S>') as at_s, instr(output, '<M>') as at_m from outputs)
select doc_id, n, form, case when form <> 'plain' then p end as prefix_chars, case when form <> 'plain' then q - p end as middle_chars, sha256(output) as output_sha256,
  sha256(case form when 'plain' then output
    when 'psm' then substr(output, at_p + 3, at_s - at_p - 3) || substr(output, at_m + 3) || substr(output, at_s + 3, at_m - at_s - 3)
    else substr(output, at_p + 3, at_m - at_p - 3) || substr(output, at_m + 3) || substr(output, at_s + 3, at_p - at_s - 3) end) as restored_sha256
from places"""
