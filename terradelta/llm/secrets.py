"""Secret scans with ownership frequency (operator 10), in DataFrame functions alone.

Patterns find candidates and their places. Over the whole corpus each value's hash is then counted by distinct
repositories (documents) and owners (sources): values of many owners, or in many repositories, are copied examples, the others look live.
Tokens of letters and digits that look live are added as spans of kind `owned`, also where a base span holds them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("assign", "access", "hex", "owned")
# fixed values: the patterns of the base kinds
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 characters and more
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
BLOCK = 256
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")


@dataclass(frozen=True)
class Settings:
    least_value: int = 12  # characters of an assigned value
    example_owners: int = 3  # a value of so many owners is a copied example,
    example_repositories: int = 20  # and so is one in so many repositories, whoever owns them
    distinct_chars: int = 8  # of a token that looks live


def _places(text: Column, pattern: str, kind: int, group: int, may: Column, good) -> Column:
    """Structs (start, kind, end, value) of the matches whose value passes, in code points.

    What split() leaves between the matches gives the places, without a function in another language.
    """
    shape = "array<struct<start:int,kind:int,end:int,value:string>>"
    pieces = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = whole if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    each = F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("gap"), F.transform(whole, F.length).alias("size"), values.alias("value"))
    # spans are gathered block by block, so that a list of many matches is not copied at each of them
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(each) - 1) / BLOCK).cast("int")), lambda k: F.slice(each, k * BLOCK + 1, F.lit(BLOCK)))

    def step(acc: Column, x: Column) -> Column:
        a, b = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["size"]
        span = F.struct(a.alias("start"), F.lit(kind).alias("kind"), b.alias("end"), x["value"].alias("value"))
        return F.struct(b.alias("at"), F.when(good(x["value"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, x: Column) -> Column:
        one = F.aggregate(x, F.struct(acc["at"].alias("at"), F.array().cast(shape).alias("out")), step)
        return F.struct(one["at"].alias("at"), F.concat(acc["out"], F.array(one["out"])).alias("out"))

    found = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{shape}>").alias("out")), block)
    return F.when(may & (F.size(whole) > 0), F.flatten(found["out"])).otherwise(F.array().cast(shape))


def candidates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, owner, text_hash and spans for each row; one pass over the whole texts."""
    text = F.col("text")
    low = F.lower(text)
    named = low.contains(WORDS[0])
    for w in WORDS[1:]:
        named |= low.contains(w)
    always = F.lit(True)
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, ""))) >= s.distinct_chars)
    spans = F.concat(
        _places(text, ASSIGN, 0, 2, named, lambda v: F.length(v) >= s.least_value),
        _places(text, ACCESS, 1, 0, text.contains("AKIA"), lambda v: always),
        _places(text, HEX, 2, 0, text.rlike(HEX), lambda v: always),
        _places(text, TOKEN, 3, 0, text.rlike(TOKEN), mixed),
    )
    return docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("doc_id", "owner", F.xxhash64("text").alias("text_hash"), spans.alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def scan(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row for each document: counts of the base kinds, their digest, all spans, and how many values look live or copied.

    Null texts are empty and have none; very long ones are searched whole. Spans that start together are in order of their kinds. Rows that repeat doc_id and text share their spans; a null doc_id or source is a value of its own. Other
    columns aren't read. An empty table gives an empty result.
    """
    found = cut(candidates(docs, s))
    each = found.select("doc_id", "owner", "text_hash", F.explode("spans").alias("x")).select("doc_id", "owner", "text_hash", "x.start", "x.kind", "x.end", F.unhex(F.md5(F.encode("x.value", "UTF-8"))).alias("value"))
    owners = each.select("value", "owner", "doc_id").distinct().groupBy("value", "owner").agg(F.count("*").alias("repositories"))
    spread = owners.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    judged = each.join(spread, "value").withColumn("live", (F.col("owners") < s.example_owners) & (F.col("repositories") < s.example_repositories))
    kept = judged.where((F.col("kind") < 3) | F.col("live")).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "kind", "end", "live")).alias("all"))
    kept = kept.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    spans = F.coalesce("all", F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>"))
    base = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return (
        found.join(kept, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
        .select("doc_id", base(0).alias("n_assign"), base(1).alias("n_access"), base(2).alias("n_hex"), F.sha2(_joined(F.filter("spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"), _joined(spans).alias("spans"), F.size(F.filter(spans, lambda x: x["live"])).cast("long").alias("n_live"), F.size(F.filter(spans, lambda x: ~x["live"])).cast("long").alias("n_copied"))
    )
