"""A corpus pipeline of five stages: quality, near copies, decontamination, personal data, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns the rows that go on, with the columns of documents. The last
returns the packed pieces. run() writes what a stage returns to the shared folder and reads it as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terradelta.llm import latent, nearcopies, packing, pseudonyms, repetition
from terradelta.llm.common import cut, table
from terradelta.llm.queries import pseudonym_key, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text passes the rules of operator 2.

    Null, empty and short texts have too few words and go. Repeated rows are judged each by itself, nulls in other columns don't matter, very long texts
    are a batch of their own, other columns are kept whatever their names, and no rows give no rows.
    """
    return repetition.keep_quality(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the one of the least doc_id, a null one before all; of repeated rows any one.

    Null texts are classes of their own and stay; equal texts, empty ones too, are one class. Very long texts are batches of their own, other columns
    are kept whatever their names (but for "number of a row of docs"), and no rows give no rows.
    """
    return nearcopies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text holds no item of the table benchmark.

    Null and empty texts hold nothing and stay. Repeated rows, null doc_ids and ties don't matter: each row is judged by its own text. Very long
    texts are searched in overlapping sections, other columns are kept whatever their names, and no rows, or no benchmark, give the rows as they are.
    """
    return latent.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with validated numbers, dates and names of the text replaced by pseudonyms of their format, the same for the same value everywhere.

    Null and empty texts stay. Repeated rows stay repeated, very long texts are batches of their own, other columns are kept whatever their names.
    The key comes from the session (terradelta.pseudonym.key).
    """
    return pseudonyms.pseudonymise(docs, pseudonym_key(spark))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and where they are packed; a null text is an empty one and still ends with its token.

    Repeated rows are packed each, ties of length are dealt in any order, very long texts are cut into pieces, and other columns aren't read.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("near copies", near_copies),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("best-fit packing", best_fit),
]

#: SQL can't express the signatures, the latent search, the permutations or the packing; tests/llm compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
