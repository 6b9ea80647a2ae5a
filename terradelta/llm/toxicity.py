"""Severity of toxic texts by cumulative-link ordinal regression (operator 8).

P(grade >= j) = sigmoid(w.x - theta_j) with one weight vector for all grades and thresholds theta_1 < theta_2 < ...;
x holds the presence of hashed words and word beginnings. The model is fitted on at most `sample` labelled texts (those with the
smallest hash of doc_id), on the words that differ most between toxic and other texts; every text is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import by_batch, cut, utf8_lower


#: Words whose slots are found at once.
WORDS = 1 << 18


@dataclass(frozen=True)
class Settings:
    slots: int = 1 << 20  # hashed words and stems
    stems: tuple[int, ...] = (4, 5, 6, 7, 8)  # bytes
    words: int = 1024  # words that get a weight
    sample: int = 8_000  # labelled texts to learn from
    least_texts: int = 4
    least_z: float = 4.0
    ridge: float = 3e-5
    rounds: int = 400
    threshold: float = 0.3


@dataclass
class Model:
    weights: np.ndarray  # by slot
    thresholds: np.ndarray


def slots_of(column: pa.Array, slots: int, stems: tuple[int, ...], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot, each pair once and in order, of lower-case words and of their first bytes, so that inflected and compounded forms share a slot.

    wanted: by slot, whether it matters; others are left out before pairs are made unique.
    """
    buf, offsets = utf8_lower(column)
    folded = bw.FOLD[buf]
    starts, ends = bw.runs(folded != 32, offsets)
    rows = bw.rows_of(starts, offsets)
    found = [np.zeros(0, np.int64)]
    for i in range(0, len(starts), WORDS):  # a very long text's words a part at a time
        a, b, row = starts[i : i + WORDS], ends[i : i + WORDS], rows[i : i + WORDS]
        hashes, where = [bw.hashes(folded, a, b)], [row]
        for n in stems:
            long = b - a >= n
            hashes.append(bw.hashes(folded, a[long], a[long] + n) + np.uint64(n))
            where.append(row[long])
        row, slot = np.concatenate(where), (np.concatenate(hashes) % np.uint64(slots)).astype(np.int64)
        if wanted is not None:
            row, slot = row[wanted[slot]], slot[wanted[slot]]
        found.append(np.unique(row * slots + slot))
    pairs = np.unique(np.concatenate(found))
    return pairs // slots, pairs % slots


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 not toxic, 1 toxic, 2 toxic and of low quality. Labels of one document count as their highest; those without doc_id or toxic are left out."""
    grade = F.when(F.col("toxic") == 0, 0).when(F.coalesce(F.col("quality"), F.lit(1)) == 1, 1).otherwise(2)
    return labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(grade).alias("grade"))


def fit_links(x: np.ndarray, grade: np.ndarray, grades: int, ridge: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds of largest likelihood less a ridge, by full-batch Adam."""
    n, m = x.shape
    share = np.array([max((grade >= j).mean(), 1e-4) for j in range(1, grades)])
    base = np.log((1 - share) / share)
    gaps = np.maximum(np.diff(base), 0.1)
    p = np.concatenate([np.zeros(m), [base[0]], np.log(gaps)])
    first, second = np.zeros_like(p), np.zeros_like(p)

    def unpack(p):
        return p[:m], p[m] + np.concatenate([[0.0], np.cumsum(np.exp(p[m + 1 :]))])

    for t in range(1, rounds + 1):
        w, theta = unpack(p)
        s = (x @ w.astype(x.dtype)).astype(float)
        above = 1 / (1 + np.exp(-np.clip(s[:, None] - theta, -30, 30)))
        edge = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        chance = np.maximum(edge[at, grade] - edge[at, grade + 1], 1e-9)
        slope = edge * (1 - edge)
        up, down = slope[at, grade] / chance, slope[at, grade + 1] / chance
        g = np.zeros_like(p)
        g[:m] = -((up - down).astype(x.dtype) @ x) / n + ridge * w
        by_theta = np.zeros(grades + 1)
        np.add.at(by_theta, grade, up / n)
        np.add.at(by_theta, grade + 1, -down / n)
        by_theta = by_theta[1:-1]
        g[m] = by_theta.sum()
        if grades > 2:
            g[m + 1 :] = np.cumsum(by_theta[::-1])[::-1][1:] * np.exp(p[m + 1 :])
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        p -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return unpack(p)


def fit(docs: DataFrame, grades: DataFrame, s: Settings = Settings()) -> Model:
    """Learn from docs (doc_id, text) and grades (doc_id, grade). The driver gets the words of at most `sample` texts, as slots; the sample is a documented bound of the classifier."""
    some = cut(grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample))
    texts = docs.where(F.col("text").isNotNull()).join(F.broadcast(some), "doc_id").select("text", "grade", "doc_id")  # at most `sample` rows of 12 bytes
    kind = texts.schema["doc_id"].dataType.simpleString()

    def work(batch):
        rows, slot = slots_of(batch.column(0), s.slots, s.stems)
        ends = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
        return {"doc_id": batch.column(2), "grade": batch.column(1), "slots": pa.ListArray.from_arrays(ends, pa.array(slot.astype(np.int32)))}

    # of several texts of one doc_id the one with the least slots, so at most `sample` rows go to the driver
    found = by_batch(texts, work, f"doc_id {kind}, grade int, slots array<int>").groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("slots").alias("slots")).select("grade", "slots").toArrow()
    grade = np.array(found.column(0).to_pylist(), np.int64)
    weights = np.zeros(s.slots)
    top = int(grade.max(initial=0))
    if top == 0 or not (grade == 0).any():  # nothing to tell apart
        return Model(weights, np.full(max(top, 1), 30.0))
    lists = found.column(1).combine_chunks()
    slot = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(grade), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    bad = grade > 0
    in_bad, in_all = np.bincount(slot[bad[row]], minlength=s.slots), np.bincount(slot, minlength=s.slots)
    share = in_all / len(grade)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / bad.sum() + 1 / (~bad).sum()))
    z = np.abs(in_bad / bad.sum() - (in_all - in_bad) / (~bad).sum()) / spread
    z[in_all < s.least_texts] = 0
    chosen = np.argsort(-z, kind="stable")[: s.words]
    chosen = chosen[z[chosen] >= s.least_z]
    column = np.full(s.slots, -1)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((len(grade), len(chosen)), np.float32)
    has = column[slot] >= 0
    x[row[has], column[slot[has]]] = 1
    w, theta = fit_links(x, grade, top + 1, s.ridge, s.rounds)
    weights[chosen] = w
    return Model(weights, theta)


def score(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """doc_id, severity (the likeliest grade), expected_severity, toxic (P(grade >= 1) over the threshold) for each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    used = np.flatnonzero(model.weights)
    light = model.weights[used]

    def work(batch):
        weights = np.zeros(s.slots)
        weights[used] = light
        rows, slot = slots_of(batch.column(1), s.slots, s.stems, weights != 0)
        total = np.bincount(rows, weights[slot], batch.num_rows)
        above = 1 / (1 + np.exp(-np.clip(total[:, None] - model.thresholds, -30, 30)))
        edge = np.concatenate([np.ones((len(total), 1)), above, np.zeros((len(total), 1))], axis=1)
        return {"doc_id": batch.column(0), "severity": pa.array(np.argmax(edge[:, :-1] - edge[:, 1:], axis=1), pa.int32()), "expected_severity": above.sum(axis=1), "toxic": above[:, 0] >= s.threshold}

    return by_batch(docs.select("doc_id", F.col("text").cast("string").alias("text")), work, f"doc_id {kind}, severity int, expected_severity double, toxic boolean")


def severity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fit on the labelled texts and score every document.

    Null and empty texts have no words and get what the thresholds alone say. Repeated rows get a row each. Without labels of both
    kinds nothing is toxic. A doc_id with several labels has its worst one; of its texts that whose list of word slots comes first is learnt from. A
    very long text is a batch of its own. A null doc_id is scored and never learnt from. Other columns aren't read; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return score(docs, fit(docs, graded(labels), settings), settings)
