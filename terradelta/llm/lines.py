"""Line dedup over the whole corpus (operator 12), in DataFrame functions alone.

Texts are exploded into normalised lines, each line's hash is counted by distinct documents, lines of hashes in many documents go from all documents
but the first one, and the others are put together again by position. Only hashes and positions are shuffled to find the lines; each text is then
shuffled once to meet the positions that it loses.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keyed
from .hotkeys import join_counted

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROW = "_row"


@dataclass(frozen=True)
class LineRules:
    least_chars: int = 10  # code points of a normalised line; shorter ones always stay
    least_documents: int = 2  # a line in so many documents goes


def normalised(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case and no other letter changed."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(docs: DataFrame, rules: LineRules) -> DataFrame:
    """_row, doc_id, pos and the 128-bit hash of each line that is long enough."""
    each = docs.select(ROW, "doc_id", F.posexplode(_lines(F.col("text"))).alias("pos", "line")).select(ROW, "doc_id", "pos", normalised(F.col("line")).alias("line"))
    return each.where(F.length("line") >= rules.least_chars).select(ROW, "doc_id", "pos", F.unhex(F.md5("line")).alias("hash"))


def repeated(hashes: DataFrame, rules: LineRules) -> DataFrame:
    """hash, documents and lines that have it, and the smallest doc_id, of the hashes in many documents."""
    each = hashes.groupBy("hash", "doc_id").agg(F.count("*").alias("lines"))  # dealt out by both, so no hash is hot
    counts = each.groupBy("hash").agg(F.count("*").alias("documents"), F.sum("lines").alias("lines"), F.min("doc_id").alias("first"))
    return counts.where(F.col("documents") >= rules.least_documents)


def _without(text: Column, dropped: Column) -> Column:
    """The text's lines whose positions aren't in dropped, joined; lines are split once, whatever their number."""
    both = F.array(F.struct(_lines(text).alias("lines"), dropped.alias("dropped")))
    kept = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["dropped"])
    return F.transform(both, lambda x: F.array_join(F.transform(kept(x), lambda i: F.get(x["lines"], i)), "\n"))[0]


def dedup_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """doc_id, text without the lines that many documents have, n_lines before, and n_dropped, for each row of docs.

    Such a line stays in the document of the smallest doc_id that has it, as often as it stands there. A null text is one empty line. A null doc_id
    is larger than all others, and rows of one doc_id (or of null) are one document: they keep or lose a line together; each is put together by
    itself. Very long texts are exploded like others; only the positions that a text loses are gathered, never the lines of a hash. Other columns
    aren't read. An empty table gives an empty result.
    """
    rows = keyed(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), ROW)
    hashes = cut(line_hashes(rows, rules))
    lost = join_counted(hashes, cut(repeated(hashes, rules)), "hash", "lines", hashes.count()).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    positions = lost.groupBy(ROW).agg(F.collect_list("pos").alias("dropped"))
    joined = rows.join(positions, ROW, "left")
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("dropped")))
    return joined.select("doc_id", text.alias("text"), F.size(_lines(F.col("text"))).cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))
