"""Interaction of filters (operator 11): one table of failing ids for each filter, and left-semi and left-anti joins of them.

What a filter removes depends on the filters before it, not on their order, so the prefixes of all orders are the sets of filters. Ids are split
by one left-semi and one left-anti join with each filter's table; ids that fail the same filters are counted together from there on, and the
prefixes' survivors, removals and redundancies are left-anti and left-semi joins of these counted groups with the relation of failing groups.
So each id takes part in ten joins, not in one for every prefix.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keyed
from .hotkeys import join_counted

ROW = "_row"
SPACE = " \t\n\x0b\x0c\r"


def failing_ids(docs: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The documents (_row, doc_id, part), and the table of failing rows of each filter.

    A: under 100 words; B: under 80 % of the words are different; C: over 10 % of the characters are A-Z; D: holds one of #$%&*|; E: the text of a
    smaller doc_id. One pass over the texts; equal texts are found by their SHA-256.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = keyed(docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text")), ROW)
    bare = F.btrim("text", F.lit(SPACE))
    split = rows.select(ROW, "doc_id", "part", "text", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \t-\r]+")).alias("words"))
    words, different = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = {"A": words < 100, "B": 100 * different < 80 * words, "C": 100 * capitals > 10 * F.length("text"), "D": F.col("text").rlike("[#$%&*|]")}
    seen = cut(split.select(ROW, "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(v.alias(k) for k, v in fails.items())))
    tables = {k: cut(seen.where(k).select(ROW)) for k in fails}
    texts = seen.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
    later = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    tables["E"] = cut(join_counted(seen.select(ROW, "doc_id", "digest"), cut(texts), "digest", "n", seen.count()).where(later).select(ROW))
    return seen.select(ROW, "doc_id", "part"), tables


def _bits(letters: list[str]) -> Column:
    """The letters whose bit is set in column cell."""
    bits = F.array(*(F.lit(1 << i) for i in range(len(letters))))
    return F.filter(F.array(*map(F.lit, letters)), lambda x, i: F.col("cell").bitwiseAND(F.get(bits, i)) != 0)


def _constant(rows: list[dict], fields: str) -> Column:
    """Each of a few fixed rows, for every row."""
    return F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>"))


def groups(docs: DataFrame, failing: dict[str, DataFrame], labels: DataFrame) -> DataFrame:
    """part, cell (bit i: they fail filter i), and how many documents there are, how many of them good and how many toxic."""
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    split = docs.join(known, "doc_id", "left").select(ROW, "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.lit(0).alias("cell"))
    for i, ids in enumerate(failing.values()):
        removed, stay = split.join(ids, ROW, "left_semi"), split.join(ids, ROW, "left_anti")
        split = cut(removed.withColumn("cell", F.col("cell") + (1 << i)).unionByName(stay))
    return split.groupBy("part", "cell").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def interactions(docs: DataFrame, failing: dict[str, DataFrame], labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, zeros included: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs: _row (one for each document), doc_id, part. failing: by one-letter name, a table with the _row of each document that fails. labels: doc_id,
    quality, toxic; a doc_id with several rows is good (toxic) if any says so, a null doc_id has none. Equal counts need no order. No documents: no rows.
    """
    spark, letters = docs.sparkSession, list(failing)
    cells = cut(groups(docs, failing, labels))
    n = len(letters)
    sets = [(p, letters[i], factorial(p.bit_count()) * factorial(n - 1 - p.bit_count())) for p in range(1 << n) for i in range(n) if not p >> i & 1]
    steps = [("".join(order), k + 1, sum(1 << letters.index(x) for x in order[:k]), order[k]) for order in permutations(letters) for k in range(n)]
    members = spark.createDataFrame([(p, letters[i]) for p in range(1 << n) for i in range(n) if p >> i & 1] or [(0, "")], "prefix int, filter string")
    fails = cells.select("cell").distinct().select("cell", F.explode(_bits(letters)).alias("filter"))
    gone = fails.join(members, "filter").select("prefix", "cell").distinct()  # groups that a filter of the prefix removes
    each = _constant([{"prefix": p, "filter": f, "orders": w} for p, f, w in sets], "prefix:int,filter:string,orders:long")
    judged = cells.withColumn("x", each).select("part", "cell", "n", "good", "toxic", "x.*")
    survivors = judged.join(gone, ["prefix", "cell"], "left_anti")
    removed = survivors.join(fails, ["cell", "filter"], "left_semi")
    kept = survivors.join(fails, ["cell", "filter"], "left_anti")
    redundant = judged.join(fails, ["cell", "filter"], "left_semi").join(gone, ["prefix", "cell"], "left_semi")
    zero = F.lit(0).cast("long")
    counts = ("kept", "removed", "redundant", "good_lost", "toxic_lost")

    def tagged(df: DataFrame, **what: str) -> DataFrame:
        return df.select("part", "prefix", "filter", "orders", *(F.col(what[k]).cast("long").alias(k) if k in what else zero.alias(k) for k in counts))

    events = tagged(removed, removed="n", good_lost="good", toxic_lost="toxic").unionByName(tagged(kept, kept="n")).unionByName(tagged(redundant, redundant="n"))
    sums = cut(events.groupBy("part", "prefix", "filter", "orders").agg(*(F.sum(k).alias(k) for k in counts)))
    others = F.size(F.array(*map(F.lit, letters))) - 1
    alone = F.when(F.bit_count("prefix") == others, F.col("removed")).otherwise(0)
    whole = sums.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"), F.sum(alone).alias("unique_fails"))
    plan = _constant([{"filter_order": o, "step": k, "prefix": p, "filter": f} for o, k, p, f in steps], "filter_order:string,step:int,prefix:int,filter:string")
    grid = cells.select("part").distinct().withColumn("x", plan).select("part", "x.*")
    out = grid.join(sums.drop("orders"), ["part", "prefix", "filter"], "left").join(whole, ["part", "filter"], "left")
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return out.select("part", "filter_order", "step", *(F.coalesce(k, zero).alias(k) for k in names))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """interactions() of the five filters on docs; a null lang is the part '' and a null text is empty.

    A repeated doc_id is counted as often as it has rows; rows of one doc_id don't fail E by each other, and a null doc_id is larger than all others.
    Very long texts are split into words one at a time. Other columns aren't read. An empty table gives an empty result.
    """
    rows, failing = failing_ids(docs)
    return interactions(rows, failing, labels)
