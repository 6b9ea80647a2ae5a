"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .audit import audit
from .common import table
from .langid import identify
from .latent import contamination
from .lines import dedup_lines
from .nearcopies import near_classes
from .packing import pack
from .periodic import periodic_runs
from .pseudonyms import pseudonymise
from .repetition import repetition
from .secrets import scan
from .suffixes import digests
from .toxicity import severity
from .urls import Rule, judge


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_latent_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered_words")


def op3_hash_compared_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def op4_prob_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def op5_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


#: The key of the pseudonyms where the session has none: an example, known to everyone.
PSEUDONYM_KEY = b"terradelta-example-key"


def pseudonym_key(spark: SparkSession) -> bytes:
    """The secret key that the caller gives in terradelta.pseudonym.key of the session, or the example."""
    found = spark.conf.get("terradelta.pseudonym.key", None)
    return found.encode() if found else PSEUDONYM_KEY


def op6_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), pseudonym_key(spark), counts=True)


#: The rules of the url query.
URL_RULES = [Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def op7_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), URL_RULES).drop("alias_of")


def op8_ordinal_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_ownership_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op11_failing_id_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_exploded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def _planted(doc_id: Column, text: Column) -> Column:
    """The text, but of one document in ten from word a on as repeats of its own words a, a + 1, ..., a + p - 1 (part of the query's contract)."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    split = F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), "[ \t-\r]+")
    n = F.size(split)
    start = F.struct(split.alias("w"), (g % n).cast("int").alias("a"), (F.lit(1) + F.floor((n - g % n) / (3 + g % 8))).cast("int").alias("p"))
    word = lambda x, i: F.get(x["w"], F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]))
    again = F.transform(F.array(start), lambda x: F.array_join(F.transform(F.sequence(F.lit(0), F.size(x["w"]) - 1), lambda i: word(x, i)), " "))[0]
    return F.when((h % 10 == 0) & text.rlike("[^ \t-\r]"), again).otherwise(text)


def op13_basic_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    each = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best")["start"], F.col("best")["length"], -F.col("best")["period"]
    return each.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_latent_retrieval": op1_latent_retrieval,
        "op2_suffix_repetition": op2_suffix_repetition,
        "op3_hash_compared_suffixes": op3_hash_compared_suffixes,
        "op4_prob_min_hash": op4_prob_min_hash,
        "op5_vector_best_fit": op5_vector_best_fit,
        "op6_feistel_pseudonyms": op6_feistel_pseudonyms,
        "op7_redirect_equivalence": op7_redirect_equivalence,
        "op8_ordinal_severity": op8_ordinal_severity,
        "op9_nearest_centroid": op9_nearest_centroid,
        "op10_ownership_frequency": op10_ownership_frequency,
        "op11_failing_id_relations": op11_failing_id_relations,
        "op12_exploded_lines": op12_exploded_lines,
        "op13_basic_factors": op13_basic_factors,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_suffix_repetition": sql.REPETITION,
        "op7_redirect_equivalence": sql.URLS,
        "op10_ownership_frequency": sql.SECRETS,
        "op11_failing_id_relations": sql.AUDIT,
        "op12_exploded_lines": sql.LINES,
        "op13_basic_factors": sql.RUNS,
    }
