"""Quality rules by repetition (operator 2).

Each document's words get a suffix array by prefix doubling. The longest repeat at a word is the depth of the deepest longest-common-prefix interval
that holds its suffix, which is the larger of the common prefixes with its two neighbours; the intervals themselves needn't be listed. Common prefixes
are found by 64-bit hashes of the words. Maximal repeats of at least `min_repeat` words are united into spans, and a document is rejected when they
cover too much of it or one of them is too long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import by_batch, utf8

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class RepetitionRules:
    min_words: int = 10
    window: int = 5  # base rule: words in windows of so many found twice or more
    max_window_percent: int = 20
    min_repeat: int = 8  # repeats of so many words count as covered
    max_covered_percent: int = 18
    max_repeat: int = 60  # words of the longest repeat


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling: starts of the suffixes in order.

    Ranks are the places of a group's head in suffix order; only positions that still share a rank are sorted again.
    """
    n = len(symbols)
    _, inverse, counts = np.unique(symbols, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[inverse]
    active, h = np.flatnonzero(counts[inverse] > 1), 1
    del inverse
    while active.size:
        after = np.zeros(active.size, np.int64)
        inside = active + h < n
        after[inside] = rank[active[inside] + h] + 1
        old = rank[active]
        order = np.argsort(old * (n + 1) + after, kind="stable")
        active, old, after = active[order], old[order], after[order]
        place = np.arange(active.size)
        new_group = np.ones(active.size, bool)
        new_group[1:] = old[1:] != old[:-1]
        new_part = new_group.copy()
        new_part[1:] |= after[1:] != after[:-1]
        group_at = np.maximum.accumulate(np.where(new_group, place, 0))
        part_at = np.maximum.accumulate(np.where(new_part, place, 0))
        rank[active] = old + part_at - group_at
        last = np.ones(active.size, bool)
        last[:-1] = new_part[1:]
        active = active[~(new_part & last)]
        h *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For each position, how many symbols from there on are found elsewhere too: the deepest LCP interval that holds its suffix.

    Neighbouring suffixes' common prefixes are found by doubling and then halving steps over prefix hashes of the symbols.
    """
    n = len(symbols)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    suffixes = suffix_array(symbols)
    pair = np.flatnonzero(symbols[suffixes[:-1]] == symbols[suffixes[1:]])
    a, b = suffixes[pair], suffixes[pair + 1]
    del suffixes
    pre = bw.prefix(symbols)
    lcp, step = np.ones(len(a), np.int64), 1
    open_ = np.arange(len(a))

    def extend(which: np.ndarray, size: int) -> np.ndarray:
        """Those of `which` whose suffixes agree in `size` more symbols, which are then counted."""
        x, y = a[which] + lcp[which], b[which] + lcp[which]
        room = np.maximum(x, y) + size <= n
        which, x, y = which[room], x[room], y[room]
        which = which[bw.stretch(pre, x, x + size) == bw.stretch(pre, y, y + size)]
        lcp[which] += size
        return which

    while len(open_):  # as long as all agree, steps double
        open_, step = extend(open_, step), 2 * step
    every = np.arange(len(a))
    while step > 1:
        step //= 2
        extend(every, step)
    np.maximum.at(best, a, lcp)
    np.maximum.at(best, b, lcp)
    return best


def maximal_spans(best: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the repeats of at least `least` symbols that no repeat one symbol to the left holds."""
    before = np.zeros(len(best), np.int64)
    before[1:] = best[:-1]
    keep = np.flatnonzero((best >= least) & ((before < least) | (best > before - 1)))
    return keep, best[keep]


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """True for each position in the union of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(batch: pa.RecordBatch, rules: RepetitionRules) -> dict:
    buf, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
    n = batch.num_rows
    starts, ends = bw.runs(~bw.SPACE[buf], offsets)
    rows = bw.rows_of(starts, offsets)
    n_words = bw.per_row(rows, n)
    word_chars = bw.count_by_row(~bw.SPACE[buf] & ((buf & 0xC0) != 0x80), offsets)
    n_symbols = bw.count_by_row(SYMBOLS[buf], offsets)
    # lines with a word, by row and content
    a, b = bw.runs(buf != 10, offsets)
    with_word = np.searchsorted(starts, b) > np.searchsorted(starts, a)
    a, b = a[with_word], b[with_word]
    line_rows = bw.rows_of(a, offsets)
    salt = bw.mix(np.arange(1, n + 1, dtype=np.uint64))
    _, first = np.unique(bw.hashes(buf, a, b) ^ salt[line_rows], return_index=True)
    n_dup = bw.per_row(line_rows, n) - bw.per_row(line_rows[first], n)
    # a word is another symbol in each document, so no repeat crosses documents
    best = longest_repeats(bw.hashes(buf, starts, ends) ^ salt[rows])
    again = covered(len(best), *maximal_spans(best, rules.window))
    n_again = bw.per_row(rows[again], n)
    spans = maximal_spans(best, rules.min_repeat)
    n_covered = bw.per_row(rows[covered(len(best), *spans)], n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, rows, best)
    failed = (n_words < rules.min_words) | (100 * n_again > rules.max_window_percent * n_words)
    kept = ~failed & (100 * n_covered <= rules.max_covered_percent * n_words) & (longest <= rules.max_repeat)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_again, "base_failed": failed, "kept": kept, "n_covered_words": n_covered, "longest_repeat": longest, "n_maximal_repeats": bw.per_row(rows[spans[0]], n)}


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered_words long, longest_repeat long, n_maximal_repeats long"


def repetition(docs: DataFrame, rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """One row of measures for each document, in one pass without a shuffle.

    Null and empty texts have no words and fail the base rule. A very long text is sorted whole, as a batch of its own. A null doc_id is passed on. Repeated rows each get their row.
    Other columns of docs, whatever their names, are not read. An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    name = "doc_id"

    def work(batch: pa.RecordBatch) -> dict:
        return {name: batch.column(0), **{k: pa.array(v) for k, v in measure(batch, rules).items()}}

    return by_batch(docs.select("doc_id", F.col("text").cast("string").alias("text")), work, f"doc_id {kind}, {MEASURES}")


def keep_quality(docs: DataFrame, rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """The rows of docs, all columns, whose text passes; nulls have no words and go."""
    schema, at = docs.schema, "text"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(measure(batch.select([at]), rules)["kept"]))

    return by_batch(docs, work, schema)
