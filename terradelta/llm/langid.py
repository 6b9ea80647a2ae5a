"""Language identification by nearest centroid (operator 9).

Texts become normalised TF-IDF vectors of hashed byte 2- and 3-grams. Each language has several centroids (spherical
k-means of its texts); the nearest by cosine names the language, and texts farther from it than nearly all of
its own learning texts are marked as rejected. Document frequencies count every learning text; the centroids
are fitted on at most `sample` different texts of each language, those with the smallest hashes. A rejected text keeps
the nearest language as its prediction, beside the mark: a name is asked for every text that has letters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import by_batch, cut, slices, utf8

UNDETERMINED = "und"
#: Texts whose vectors are held at once.
ROWS = 512
_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[[i for i in range(128) if not chr(i).isalpha()]] = 32


@dataclass(frozen=True)
class Settings:
    features: int = 4096
    centroids: int = 4
    sample: int = 600  # texts of a language for the centroids
    rounds: int = 12
    reject_quantile: float = 0.995


def gram_counts(column: pa.Array, features: int) -> np.ndarray:
    """Rows of hashed 2- and 3-gram counts; letters of ASCII and all other bytes count, the rest is a space."""
    buf, offsets = utf8(pc.utf8_lower(column))
    n = len(offsets) - 1
    out = np.zeros((n, features), np.float32)
    if not len(buf):
        return out
    for low in range(0, len(buf), bw.CHUNK):  # a very long text's bytes a part at a time
        high = min(low + bw.CHUNK + 2, len(buf))
        text = _KEEP[buf[low:high]].astype(np.uint32)
        near = np.clip(offsets, low, high)
        place = np.repeat(np.arange(n, dtype=np.int64) * features, np.diff(near))
        for size in (2, 3):
            many = min(high - size + 1, low + bw.CHUNK) - low  # grams that begin in this part
            if many < 1:
                continue
            code = np.full(many, size, np.uint32)
            for k in range(size):
                code = (code << np.uint32(8)) | text[k : many + k]
            blank = np.uint32(0x2020 if size == 2 else 0x202020)
            use = (place[:many] == place[size - 1 : size - 1 + many]) & ((code & np.uint32(0xFFFFFF if size == 3 else 0xFFFF)) != blank)
            slot = ((code * np.uint32(2654435761)) >> np.uint32(15)) % np.uint32(features)
            out += np.bincount(place[:many][use] + slot[use], minlength=n * features).reshape(n, features).astype(np.float32)
    return out


def vectors(column: pa.Array, idf: np.ndarray) -> np.ndarray:
    out = np.sqrt(gram_counts(column, len(idf))) * idf
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """At most k unit centroids; starts from rows far from each other, so the result depends on the rows alone."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    centres = x[chosen].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        for j in range(len(centres)):
            if (own == j).any():
                total = x[own == j].sum(axis=0)
                centres[j] = total / max(float(np.linalg.norm(total)), 1e-12)
    return centres


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script; null has none."""
    buf, offsets = utf8(column)
    found = bw.count_by_row((_KEEP[buf] != 32) & (buf < 128), offsets) > 0
    for i in np.flatnonzero(~found & (bw.count_by_row(buf >= 128, offsets) > 0)):
        found[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return found


@dataclass
class Model:
    idf: np.ndarray
    centres: np.ndarray
    languages: list[str]
    radius: np.ndarray  # the distance beyond which a text is rejected, by centroid


def fit(learning: DataFrame, s: Settings = Settings()) -> Model:
    """Learn from columns doc_id, text, lang, all not null. The driver gets one number for each feature and the centroids."""
    size = s.features

    def frequency(batches):
        total, n = np.zeros(size, np.int64), 0
        for batch in slices(batches, rows=ROWS):
            total += (gram_counts(batch.column(0), size) > 0).sum(axis=0)
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({"feature": np.arange(-1, size, dtype=np.int32), "df": np.concatenate([[n], total])})

    df = np.zeros(size + 1)
    for feature, many in learning.select("text").mapInArrow(frequency, "feature int, df long").groupBy("feature").agg(F.sum("df")).collect():
        df[feature + 1] = many
    idf = (np.log((1 + df[0]) / (1 + df[1:])) + 1).astype(np.float32)

    # the texts with a language's smallest hashes: a threshold leaves about twice the sample, so no group of a window is large
    hashed = learning.withColumn("h", F.xxhash64("doc_id", "text"))
    many = hashed.groupBy("lang").agg(F.count("*").alias("many"))
    low = F.least(F.lit(1.0), 2.0 * s.sample / F.col("many")) * 2.0**64 - 2.0**63
    few = hashed.select("lang", "h").join(F.broadcast(cut(many.select("lang", low.alias("low")))), "lang").where("h <= low").select("lang", "h").distinct()  # one row a language
    pick = Window.partitionBy("lang").orderBy("h")
    chosen = cut(few.withColumn("nth", F.row_number().over(pick)).where(F.col("nth") <= s.sample).select("lang", "h"))
    texts = hashed.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("text", "lang")  # at most `sample` hashes a language; equal rows count once

    def to_vectors(batch):
        x = vectors(batch.column(0), idf)
        return {"lang": batch.column(1), "x": pa.ListArray.from_arrays(np.arange(0, x.size + 1, size, dtype=np.int32), pa.array(x.ravel(), pa.float32()))}

    made = by_batch(texts, to_vectors, "lang string, x array<float>", rows=ROWS)

    def cluster(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["x"].to_numpy())
        x = x[np.lexsort(x[:, :8].T)]
        centres = spherical_kmeans(x, s.centroids, s.rounds)
        cosine = x @ centres.T
        own = np.argmax(cosine, axis=1)
        radius = [float(np.quantile(1 - cosine[own == j, j], s.reject_quantile)) if (own == j).any() else 0.0 for j in range(len(centres))]
        return pd.DataFrame({"lang": key[0], "centre": list(centres), "radius": radius})

    found = sorted(made.groupBy("lang").applyInPandas(cluster, "lang string, centre array<float>, radius double").collect(), key=lambda r: (r["lang"], r["radius"]))
    centres = np.array([r["centre"] for r in found], np.float32).reshape(-1, size)
    return Model(idf, centres, [r["lang"] for r in found], np.array([r["radius"] for r in found]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (cosine, 0 to 1) and rejected for each row, from its text alone."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = np.array([*model.languages, UNDETERMINED], object)

    def work(batch):
        letters = has_letter(batch.column(1))
        best, score = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows)
        far = np.ones(batch.num_rows, bool)
        if model.languages:
            cosine = vectors(batch.column(1), model.idf) @ model.centres.T
            top = np.argmax(cosine, axis=1)
            value = cosine[np.arange(len(top)), top]
            best[letters], score[letters] = top[letters], np.clip(value[letters].astype(float), 0, 1)
            far = ~letters | (1 - value > model.radius[top] + 1e-6)
        return {"doc_id": batch.column(0), "lang_pred": pa.array(names[best], pa.string()), "score": score, "rejected": far}

    return by_batch(docs.select("doc_id", F.col("text").cast("string").alias("text")), work, f"doc_id {kind}, lang_pred string, score double, rejected boolean", rows=ROWS)


def held_out() -> F.Column:
    """crc32 of doc_id as text, modulo 3, is 1; false for a null doc_id, which is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Learn from the rows that aren't held out and have a doc_id, text and lang; predict every row from its text.

    Null texts and those without a letter get 'und' and score 0; so does everything if there is nothing to learn from. Repeated
    rows get a row each; of languages equally near the first by name is taken; a very long text is a batch of its own. Other columns aren't read; an
    empty table gives an empty result.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    learning = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    return predict(docs, fit(learning, settings)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
