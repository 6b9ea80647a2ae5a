"""Periodic runs of words (operator 13), by a dictionary of basic factors.

For each power of two L, each stretch of L words gets a name; stretches of one name are equal. Successive occurrences of a name within twice its
length form arithmetic progressions, and the gaps of these propose periods. A proposal stands if it can't be moved to the left; it is extended to
the right through the names, from the longest to the shortest, and kept if it is long enough. Of proposals of one stretch the least period stays.

All documents of a batch are named together; a word of another document is another word, and no stretch crosses documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch


@dataclass(frozen=True)
class RunRules:
    least_words: int = 12  # of a run,
    least_periods: int = 2  # and so many of its periods; 2 or more


def dictionary(words: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each power of two L, while any stretch of L words occurs twice: the name of the stretch at each place, -1 where it occurs once."""
    levels, size, n = [], 1, len(words)
    keys, places = words, np.arange(n)
    while len(places):
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        again = counts > 1
        new = np.cumsum(again) - 1
        many = again[inverse]
        names = np.full(n, -1, np.int32)
        places = places[many]
        names[places] = new[inverse[many]]
        if not len(places):
            break
        levels.append((size, names))
        places = places[places + size < n]
        places = places[names[places + size] >= 0]
        keys = names[places].astype(np.int64) * (int(again.sum()) + 1) + names[places + size]
        size *= 2
    return levels


def proposals(words: np.ndarray, names: np.ndarray, size: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i and gaps d from least to most so that equal stretches of `size` words stand at i and i + d and the words before them differ.

    Where a name recurs within half its length it is periodic, and its occurrences are a progression; unless the progression begins at i, only the
    first members of later progressions can have another word before them, so only they are looked at, and the pairs stay linear in the words.
    """
    places = np.flatnonzero(names >= 0)
    places = places[np.argsort(names[places], kind="stable")]
    name = names[places].astype(np.int64)
    width = len(words) + most + 1
    at = name * width + places
    same = np.zeros(len(places), bool)
    same[1:] = name[1:] == name[:-1]
    gap = np.zeros(len(places), np.int64)
    gap[1:] = places[1:] - places[:-1]
    begins = ~(same & (gap <= size // 2))
    following = np.zeros(len(places), np.int64)
    following[:-1] = np.where(same[1:] & (gap[1:] <= size // 2), gap[1:], 0)
    inner = (following > 0) & (words[places - 1] == words[places - 1 + following])
    out = []
    for which, list_ in ((~inner, np.arange(len(places))), (inner, np.flatnonzero(begins))):
        chosen = np.flatnonzero(which)
        if not len(chosen) or not len(list_):
            continue
        a, b = np.searchsorted(at[list_], at[chosen] + least), np.searchsorted(at[list_], at[chosen] + most, "right")
        count = b - a
        first = np.repeat(a - (np.cumsum(count) - count), count)
        i, j = np.repeat(places[chosen], count), places[list_[first + np.arange(len(first))]]
        good = words[i - 1] != words[j - 1]
        out.append((i[good], j[good] - i[good]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def extended(words: np.ndarray, levels: list[tuple[int, np.ndarray]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words are equal from i and j on."""
    a, b = i.copy(), j.copy()
    for size, names in reversed(levels):
        step = np.where((names[a] >= 0) & (names[a] == names[b]), size, 0)
        a += step
        b += step
    return a - i


def runs(words: np.ndarray, rules: RunRules = RunRules()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and least periods of all runs, in order of start and period. Words before and after each document must be all different."""
    levels = dictionary(words)
    # a run of period d has equal stretches of max(least_words - d, d) words or more at its start and d later
    base = 1
    while 2 * base <= rules.least_words / 2:
        base *= 2
    found = []
    for size, names in levels:
        if size >= base:
            i, d = proposals(words, names, size, 1 if size == base else size, 2 * size - 1)
            length = d + extended(words, levels, i, i + d)
            good = (length >= rules.least_words) & (length >= rules.least_periods * d)
            found.append((i[good], length[good], d[good]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate([x[k] for x in found]) for k in range(3))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (between ASCII white space) and where each row's begin, one more entry for the end."""
    lists = pc.ascii_split_whitespace(text.fill_null("").cast(pa.large_string()))
    values, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(values), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return values.filter(full), before[ends - ends[0]]


def work(batch: pa.RecordBatch, rules: RunRules) -> dict:
    words, offsets = split_words(batch.column(1))
    rows = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
    ids = words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
    # each document between two numbers that no word has; a word of another document has another number
    padded = -1 - np.arange(len(words) + batch.num_rows + 1)
    place = np.arange(len(words)) + rows + 1
    padded[place] = ids * batch.num_rows + rows
    start, length, period = runs(padded, rules)
    row = np.searchsorted(offsets[1:] + np.arange(1, batch.num_rows + 1), start, "right")
    # words after a run's first period go
    edge = np.zeros(len(padded) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    kept = np.cumsum(edge)[place] == 0
    before = np.concatenate([[0], np.cumsum(kept)])
    texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(before[offsets], pa.int64()), words.filter(pa.array(kept))), pa.scalar(" ", pa.large_string()))
    each = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - row - 1 - offsets[row], length, period)], names=["start", "length", "period"])
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
    return {"doc_id": batch.column(0), "n_words": pa.array(np.diff(offsets)), "runs": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each), "text": texts.cast(pa.string())}


def periodic_runs(docs: DataFrame, rules: RunRules = RunRules()) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, in order of start and period) and the text with every run cut to its first period, for each row.

    A run is a stretch of words of a least period that no neighbouring word extends. The text's words are joined by one space. Null and empty texts
    have no words and no runs. Rows are judged by themselves, so nulls in doc_id and repeated rows don't matter; of proposals for the same stretch the
    least period stays. A very long text is a batch of its own, with about 100 bytes a word held in its task. Other columns aren't read. An empty
    table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return by_batch(plain, lambda batch: work(batch, rules), f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")
