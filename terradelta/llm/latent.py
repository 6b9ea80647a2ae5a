"""Benchmark decontamination by latent semantic retrieval (operator 1).

Passages are TF-IDF vectors of hashed words. A randomised SVD of all passages of the benchmark and of the corpus gives a latent space; passages near
a benchmark item in it by cosine are candidates, and the longest common subsequence of words decides: nearly the whole item, or most of it and its
answer (its last words). Frequencies count all words of the corpus, the space is fitted on all words of all rows, and every passage of every document
is searched. Items of fewer words than a latent vector can tell apart are found exactly: where a whole line has their words and no others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import by_batch, cut, release, slices, utf8, utf8_lower


@dataclass(frozen=True)
class Settings:
    slots: int = 1 << 15  # hashed words
    rank: int = 96
    share: float = 0.25  # the corpus's energy against the items' in what the basis is fitted on
    passages: tuple[int, ...] = (8, 16, 32)  # words; an item is searched with the longest that it fills
    least_cosine: float = 0.4
    least_common: float = 0.8  # share of the item's words, in order
    least_paraphrase: float = 0.6  # the same where the answer is found too
    answer: int = 5  # last words of an item
    least_words: int = 5  # shorter items can't be told from chance within a sentence: they are found where they are a whole line
    items: int = 1_024  # different items that one scan searches
    seed: int = 7


#: Words of the blocks that passages are put together from, and words whose latent vectors are held at once.
BLOCK, WORDS = 4, 1 << 15


def _passages(rows: np.ndarray, slot: np.ndarray, weights: np.ndarray, n: int, sizes: tuple[int, ...]):
    """For each size: first words of passages and their latent sums. A passage has that many words and begins every half passage of its row; the last ends with the row."""
    first = np.searchsorted(rows, np.arange(n + 1))
    many = np.diff(first)
    blocks = -(-many // BLOCK)
    room = np.where(many > 0, np.maximum(blocks, max(sizes) // BLOCK), 0)  # zero blocks fill up short rows
    base = np.cumsum(room) - room
    place = np.arange(len(rows)) - first[rows]
    filled = np.full((int(room.sum()), BLOCK), len(weights) - 1)  # the last weights are zeros
    filled[base[rows] + place // BLOCK, place % BLOCK] = slot
    sums = weights.take(filled[:, 0], axis=0)
    for j in range(1, BLOCK):
        sums += weights.take(filled[:, j], axis=0)
    for size in sizes:
        wide = size // BLOCK
        step, last = wide // 2, np.maximum(blocks - wide, 0)
        count = np.where(many > 0, -(-last // step) + 1, 0)
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.minimum(k * step, np.repeat(last, count))
        block = np.repeat(base, count) + at
        total = sums.take(block, axis=0)
        for j in range(1, wide):
            total += sums.take(block + j, axis=0)
        yield size, np.repeat(first[:-1], count) + at * BLOCK, total


def slots_of(docs: DataFrame, s: Settings) -> DataFrame:
    """The slots of each row's words as bytes."""
    kind = np.min_scalar_type(s.slots - 1)  # short integers are smaller and sorted faster

    def work(batch):
        rows, words, _ = bw.lower_words(*utf8_lower(batch.column(0)))
        ends = np.searchsorted(rows, np.arange(batch.num_rows + 1)) * kind.itemsize
        slot = (words % np.uint64(s.slots)).astype(kind)
        return {"slots": pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(slot)])}

    return by_batch(docs.select("text"), work, "slots binary")


def _pieces(column: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """slots_of() cut up: all slots, where passages begin (one more entry for the end), and their rows. Passages don't overlap; a row's last may be shorter than the others."""
    data, offsets = utf8(column)
    slot = data.view(np.min_scalar_type(s.slots - 1))
    first, size = offsets // slot.itemsize, max(s.passages)
    many = -(-np.diff(first) // size)
    k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return slot, np.append(np.repeat(first[:-1], many) + size * k, len(slot)), np.repeat(np.arange(len(many)), many)


def _latent_sums(slot: np.ndarray, begin: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's passage, and each passage's latent sum."""
    length = np.diff(begin)
    size, passage = int(length.max()), np.repeat(np.arange(len(length)), length)
    filled = np.full((size, len(length)), len(weights) - 1)  # the last weights are zeros
    filled[np.arange(len(slot)) - np.repeat(begin[:-1], length), passage] = slot
    total = np.zeros((len(length), weights.shape[1]), np.float32)
    held = np.empty((1024, weights.shape[1]), np.float32)
    for a in range(0, len(total), 1024):  # so few that their sums stay in the processor's cache
        x = total[a : a + 1024]
        for j in range(size):
            np.take(weights, filled[j, a : a + 1024], axis=0, out=held[: len(x)], mode="clip")
            x += held[: len(x)]
    return passage, total


#: Rows that are added up at once for one slot, and passages that are multiplied at once.
LEVELS, GROUP = 32, 8192


def add_rows(total: np.ndarray, slot: np.ndarray, at: np.ndarray, x: np.ndarray) -> None:
    """total[slot] += x[at], slots repeat: each slot's rows are dealt into parts of up to LEVELS, all parts' j-th rows are added at once, and the parts' sums in the same way."""
    while len(slot):
        order = np.argsort(slot, kind="stable")
        slot, at = slot[order], at[order]
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        many = np.diff(np.append(first, len(slot)))
        parts = -(-many // LEVELS)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, size = np.repeat(first, parts) + LEVELS * k, np.minimum(np.repeat(many, parts) - LEVELS * k, LEVELS)
        longest = np.argsort(-size, kind="stable")
        begin, size, own = begin[longest], size[longest], np.repeat(slot[first], parts)[longest]
        sums, held = np.empty((len(begin), x.shape[1]), x.dtype), np.empty((2048, x.shape[1]), x.dtype)
        for a in range(0, len(begin), 2048):
            b, n, y = begin[a : a + 2048], size[a : a + 2048], sums[a : a + 2048]
            np.take(x, at[b], axis=0, out=y, mode="clip")
            for j in range(1, int(n[0])):
                m = int(np.searchsorted(-n, -j))  # these have more than j rows
                np.take(x, at[b[:m] + j], axis=0, out=held[:m], mode="clip")
                y[:m] += held[:m]
        if len(own) == len(first):
            total[own] += sums
            return
        slot, at, x = own, np.arange(len(own)), sums


def counted(words: DataFrame, s: Settings) -> tuple[np.ndarray, int]:
    """How often each slot stands in all rows of slots_of(), and how many passages these are cut into."""

    def run(batches):
        counts, passages = np.zeros(s.slots, np.int64), 0
        for batch in slices(batches, "slots"):
            slot, begin, _ = _pieces(batch.column(0), s)
            counts += np.bincount(slot, minlength=s.slots)
            passages += len(begin) - 1
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"slot": used.astype(np.int32), "n": counts[used]})
        yield pa.RecordBatch.from_pydict({"slot": pa.nulls(1, pa.int32()), "n": np.array([passages])})

    counts, passages = np.zeros(s.slots), 0
    for slot, n in words.select("slots").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n")).collect():  # one row a slot
        if slot is None:
            passages = n
        else:
            counts[slot] = n
    return counts, passages


def _weights(basis: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """(slots + 1, rank + 1): what a word adds to a latent vector, and to the squared norm; zeros in the last row."""
    return np.pad(np.concatenate([basis * idf[:, None], (idf**2)[:, None]], axis=1).astype(np.float32), ((0, 1), (0, 0)))


def randomised_svd(rows: DataFrame, idf: np.ndarray, s: Settings) -> np.ndarray:
    """An orthonormal basis (slots, rank) of the strongest directions of all passages of all rows. rows: slots and weight.

    Each task multiplies its own passages; sums by slot meet in a grouped sum. A task's sums are as large as the basis whatever it reads, so there are
    two tasks a core. The driver holds matrices of slots times rank only.
    """
    spark = rows.sparkSession

    def given(total: np.ndarray):
        used = np.flatnonzero(total.any(axis=1))
        for a in range(0, len(used), 2000):
            x = total[used[a : a + 2000]]
            yield pa.RecordBatch.from_pydict({"slot": used[a : a + 2000].astype(np.int32), "x": pa.array([v.tobytes() for v in x], pa.binary())})

    def multiply(basis: np.ndarray) -> np.ndarray:
        """A'A times basis, where A has a row of norm `weight` for each passage."""
        shared = spark.sparkContext.broadcast(_weights(basis, idf))

        def run(batches):
            total = np.zeros((s.slots, s.rank), np.float32)
            for batch in slices(batches, "slots"):
                slot, begin, row = _pieces(batch.column(0), s)
                weight = batch.column(1).to_numpy()[row] ** 2
                for a in range(0, len(row), GROUP):
                    own = begin[a : a + GROUP + 1]
                    some = slot[own[0] : own[-1]]
                    passage, latent = _latent_sums(some, own - own[0], shared.value)
                    scale = (weight[a : a + GROUP] / np.maximum(latent[:, -1], 1e-9)).astype(np.float32)
                    add_rows(total, some, passage, latent[:, :-1] * scale[:, None])
            total *= idf[:, None]
            yield from given(total)
            release()

        def add(batches):
            total = np.zeros((s.slots, s.rank), np.float32)
            for batch in batches:
                slot = batch.column(0).to_numpy()
                add_rows(total, slot, np.arange(len(slot)), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(len(slot), s.rank))
            yield from given(total)

        part = rows.select("slots", "weight").coalesce(2 * spark.sparkContext.defaultParallelism).mapInArrow(run, "slot int, x binary")
        summed = part.repartition("slot").mapInArrow(add, "slot int, x binary").toArrow()  # one row a slot
        shared.unpersist()
        out = np.zeros((s.slots, s.rank), np.float32)
        out[summed.column("slot").to_numpy()] = np.frombuffer(b"".join(summed.column("x").to_pylist()), np.float32).reshape(-1, s.rank)
        return out

    basis = np.random.default_rng(s.seed).standard_normal((s.slots, s.rank)).astype(np.float32)
    for _ in range(2):
        basis = np.linalg.qr(multiply(basis))[0].astype(np.float32)
    return basis


def word_bits(item: list[int]) -> dict[int, int]:
    """The places of each word of the item, as bits."""
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    return where


def common_words(where: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence of words and an item of `size` words, a bit for each word of the item."""
    full = (1 << size) - 1
    state = full
    for w in words:
        m = where.get(w, 0)
        if m:
            u = state & m
            state = ((state + u) | (state - u)) & full
    return size - state.bit_count()


@dataclass
class Items:
    """Benchmark items of one scan: id, number of words, bits of all and of the last words, and by passage length the scaled latent vectors of all their passages with the item of each."""

    ids: list
    sizes: list[int]
    bits: list[dict[int, int]]
    sets: list[frozenset]
    answers: list[tuple[int, dict[int, int]]]
    vectors: dict[int, tuple[np.ndarray, np.ndarray]]
    short: tuple[np.ndarray, np.ndarray]  # hashes of the whole items under least_words words, in order, and which items they are


def _whole(words: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Hashes of the stretches of `many` words from `first` on."""
    return bw.hash64(bw.prefix(words), first, first + many)


def _short_lines(column: pa.Array, rows: np.ndarray, words: np.ndarray, starts: np.ndarray, items: Items) -> dict[tuple[int, int], tuple]:
    """As find(), of short items that are a whole line of words."""
    known, which = items.short
    if not len(known) or not len(rows):
        return {}
    buf, _ = utf8_lower(column)
    line = np.searchsorted(np.flatnonzero(buf == 10), starts)
    begin = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (line[1:] != line[:-1])))
    many = np.diff(np.append(begin, len(rows)))
    few = many <= max(items.sizes[k] for k in which)
    begin, many = begin[few], many[few]
    found = _whole(words, begin, many)
    a, b = np.searchsorted(known, found), np.searchsorted(known, found, "right")
    first, best = np.searchsorted(rows, rows[begin]), {}
    for at, n, low, high, start in zip(begin.tolist(), many.tolist(), a.tolist(), b.tolist(), first.tolist(), strict=True):
        for k in which[low:high].tolist():
            if items.sizes[k] == n:
                best.setdefault((int(rows[at]), k), (1.0, n, n, at - start, at - start + n))
    return best


def encode_items(table: pa.Table, weights: np.ndarray, s: Settings) -> Items:
    """The items that are searched with these weights."""
    column = table.column("text").combine_chunks()
    rows, words, _ = bw.lower_words(*utf8_lower(column))
    slot = (words % np.uint64(s.slots)).astype(np.int64)
    many = np.bincount(rows, minlength=len(column))
    first = np.cumsum(many) - many
    size = np.array([max((p for p in s.passages if p <= n), default=0) if n >= s.least_words else 0 for n in many])
    size[(many >= s.least_words) & (size == 0)] = min(s.passages)
    vectors: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for p in s.passages:
        own = np.flatnonzero(size == p)
        out, item = [], []
        for i in own:
            a, b = first[i], first[i] + many[i]
            for at in sorted({*range(a, max(b - p, a) + 1, p // 4), max(b - p, a)}):  # closer than the documents' passages, so one of them is near
                out.append(weights[slot[at : min(at + p, b)]].sum(axis=0))
                item.append(i)
        total = np.array(out, np.float32).reshape(-1, s.rank + 1)
        latent, norm = total[:, :-1], np.sqrt(total[:, -1:])
        # what the basis holds of an item differs; scaled so that the item itself scores 1
        held = np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 0.1 * norm + 1e-9)
        vectors[p] = (latent * norm / held**2, np.array(item, np.int64))
    texts = [words[a : a + n].tolist() for a, n in zip(first.tolist(), many.tolist(), strict=True)]
    answers = [(len(x[-s.answer :]), word_bits(x[-s.answer :])) for x in texts]
    short = np.flatnonzero((many > 0) & (many < s.least_words))
    whole = _whole(words, first[short], many[short])
    order = np.argsort(whole, kind="stable")
    return Items(table.column("item_id").to_pylist(), many.tolist(), [word_bits(x) for x in texts], [frozenset(x) for x in texts], answers, vectors, (whole[order], short[order]))


def _sections(rows: np.ndarray, n: int, size: int) -> list[np.ndarray]:
    """Groups of (row, first, end): each row's words, cut into sections that overlap by `size` words where there are many; a group has about WORDS words."""
    out, group, held = [], [], 0
    first = np.searchsorted(rows, np.arange(n + 1)).tolist()
    for row, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        while a < b:
            end = min(a + WORDS, b)
            group.append((row, a, end))
            held += end - a
            if held >= WORDS:
                out.append(np.array(group))
                group, held = [], 0
            a = b if end == b else end - size
    return [*out, np.array(group)] if group else out


def find(column: pa.Array, items: Items, weights: np.ndarray, s: Settings) -> dict[tuple[int, int], tuple]:
    """By (row, item found in it): cosine, common words, item's words, first and end word of the best place."""
    rows, words, starts = bw.lower_words(*utf8_lower(column))
    slot = (words % np.uint64(s.slots)).astype(np.int64)
    first = np.searchsorted(rows, np.arange(len(column) + 1))
    best = _short_lines(column, rows, words, starts, items)
    widest = max(items.sizes, default=0)
    for group in _sections(rows, len(column), max(s.passages)):
        size = group[:, 2] - group[:, 1]
        at_word = np.repeat(group[:, 1] - np.cumsum(size) + size, size) + np.arange(size.sum())
        for p, starts, total in _passages(np.repeat(np.arange(len(group)), size), slot[at_word], weights, len(group), s.passages):
            vectors, item = items.vectors[p]
            if not len(item):
                continue
            # the cosine's norm is that of the whole vector, not of what the basis holds of it
            x = total[:, :-1] * (1 / np.sqrt(np.maximum(total[:, -1:], 1e-9)))
            for a in range(0, len(x), 4096):
                cosine = x[a : a + 4096] @ vectors.T
                i, j = np.divmod(np.flatnonzero(cosine >= s.least_cosine), len(item))
                around, tried = -1, set()
                for at, k, c in zip(at_word[starts[a + i]].tolist(), item[j].tolist(), cosine[i, j].tolist(), strict=True):
                    n = items.sizes[k]
                    if at != around:
                        row = int(rows[at])
                        start, end, around, tried = int(first[row]), int(first[row + 1]), at, set()
                        near = set(words[max(start, at - widest) : min(end, at + p + widest)].tolist())
                    if k in tried or len(items.sets[k] & near) < 0.5 * s.least_paraphrase * len(items.sets[k]):
                        continue
                    tried.add(k)
                    old = best.get((row, k))
                    if old is not None and old[1] == n:
                        continue
                    low, high = max(start, at - n), min(end, at + p + n)
                    here = words[low:high].tolist()
                    common = common_words(items.bits[k], n, here)
                    if common < s.least_paraphrase * n:
                        continue
                    many, answer = items.answers[k]
                    if (common >= s.least_common * n or common_words(answer, many, here) == many) and (old is None or common > old[1]):
                        best[row, k] = (c, common, n, low - start, high - start)
    return best


def fitted(docs: DataFrame, texts: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """The weights (slots + 1, rank + 1) for the texts of docs and the benchmark's: frequencies from all words of docs, the basis from all passages of both."""
    words, own = (cut(slots_of(x.select(F.col("text").cast("string").alias("text")), s)) for x in (docs, texts))
    (counts, passages), (_, many) = counted(words, s), counted(own, s)
    idf = (np.log((1 + counts.sum()) / (1 + counts)) ** 2).astype(np.float32)  # squared: common words make nothing alike
    light = float(np.sqrt(s.share * many / max(passages, 1)))
    return _weights(randomised_svd(words.withColumn("weight", F.lit(light)).union(own.withColumn("weight", F.lit(1.0))), idf, s), idf)


def _searches(docs: DataFrame, benchmark: DataFrame, s: Settings):
    """The benchmark's different texts (number, text), and for each scan what it searches: items and weights, broadcast."""
    texts = cut(cut(benchmark.where("text is not null").select(F.col("text").cast("string").alias("text")).distinct()).select("text", F.monotonically_increasing_id().alias("item_id")))
    weights = fitted(docs, texts, s)
    blocks = 1
    block = lambda: F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    while (texts.groupBy(block().alias("b")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > s.items:
        blocks *= 2  # so that no scan has more than `items`
    for k in range(blocks):
        found = encode_items(texts.where(block() == k).toArrow(), weights, s)
        yield texts, docs.sparkSession.sparkContext.broadcast((found, weights))  # at most `items` items and slots * rank numbers


def contamination(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row for each document row and benchmark item found in it: doc_id, item_id, cosine, common (words), item_words, first_word, end_word of the best place.

    Items of one text are searched once and each found; `items` different ones are searched in a scan, so what is broadcast has a bound. Null and empty
    texts hold nothing; items that are null or have no words are left out, those of under `least_words` words are found where they are a whole line. A null doc_id is passed on, repeated rows are
    found each, other columns aren't read, long texts are searched in overlapping sections, and empty tables give an empty result.
    """
    kind, out = docs.schema["doc_id"].dataType.simpleString(), None
    for texts, shared in _searches(docs, benchmark, s):

        def work(batch, shared=shared):
            items, weights = shared.value
            best = find(batch.column(1), items, weights, s)
            columns = list(zip(*best.values(), strict=True)) or [[]] * 5
            return {
                "doc_id": batch.column(0).take(pa.array([r for r, _ in best], pa.int64())), "number": pa.array([items.ids[k] for _, k in best], pa.int64()), "cosine": pa.array(columns[0], pa.float64()),
                "common": pa.array(columns[1], pa.int64()), "item_words": pa.array(columns[2], pa.int64()), "first_word": pa.array(columns[3], pa.int64()), "end_word": pa.array(columns[4], pa.int64()),
            }

        found = by_batch(docs.select("doc_id", F.col("text").cast("string").alias("text")), work, f"doc_id {kind}, number long, cosine double, common long, item_words long, first_word long, end_word long", limit=512 << 10)
        out = found if out is None else out.union(found)
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    ids = named.join(texts.select("text", F.col("item_id").alias("number")), "text").select("number", "item_id")
    return out.join(ids, "number").select("doc_id", "item_id", "cosine", "common", "item_words", "first_word", "end_word")


def keep_clean(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs, all columns, without the rows that hold a benchmark item. Each row is judged by its own text, whatever its doc_id; nothing is shuffled."""
    schema, out = docs.schema, docs
    for i, (_, shared) in enumerate(_searches(docs, benchmark, s)):

        def work(batch, shared=shared):
            items, weights = shared.value
            clean = np.ones(batch.num_rows, bool)
            clean[[r for r, _ in find(batch.column(batch.schema.get_field_index("text")), items, weights, s)]] = False
            return batch.filter(pa.array(clean))

        out = by_batch(cut(out) if i else out, work, schema, limit=512 << 10)
    return out
