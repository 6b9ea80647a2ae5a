"""Best-fit packing of token sequences (operator 5).

Documents are tokenised once; pieces of at most `capacity` tokens then go into sequences by vector
best-fit: a sequence has three capacities (tokens, documents, attention cost = sum of squared lengths), and a piece
goes where the weighted norm of what stays free is smallest, among sequences that have room in every one.

Pieces of one length are alike, so the choice is made for whole classes of equal sequences: the driver sees only
how many pieces have each length (at most `capacity` numbers), never the pieces. The plan has one line for
each (length, class of sequences); pieces find their line by their rank among the pieces of their length.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HELD, cut, slices

#: Bytes of text tokenised at once, and words whose ids a worker keeps (about 120 MB); when full it starts anew.
BYTES, CACHE_WORDS = 2 << 20, 800_000
#: The worker's tokenizer and cache; another operator's task lets them go.
_state: dict = {}
HELD.append(_state.clear)
_SPACE = re.compile(r"[ \t\n\r]")


@dataclass(frozen=True)
class Limits:
    capacity: int = 4096
    max_documents: int = 4096
    max_attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)  # of tokens, documents and attention cost in the norm
    end_id: int = 1


#: A tokenizer that treats this text's words apart as it does in the text may be given words; another gets whole texts.
PROBE = "The cat's mat, 12 DOGS' x.y,z a1b2. don't. ÉTÉ, naïve. I\u0307, \u0130stanbul, (see: [3]) ... 日本語, привет. a-b_c @you #1 \U0001f600, 3.14 e.g., ,x .y\nnew line.\tend"


def _tokenizer(path: str):
    if _state.get("path") != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        last = np.zeros(found.get_vocab_size(), bool)
        last[[i for x, i in found.get_vocab().items() if x.endswith("</w>")]] = True
        _state.update(path=path, tokenizer=found, last=last, cache={}, by_word=False)
        words, whole = PROBE.split(), found.encode(PROBE, add_special_tokens=False).ids
        _learn(set(words), found, _state["cache"])
        _state["by_word"] = b"".join(map(_state["cache"].__getitem__, words)) == np.array(whole, "<u4").tobytes()
    return _state["tokenizer"], _state["cache"]


def _letters(word: str) -> bool:
    """Whether the tokenizer sees letters alone, after it has composed and lower-cased them: a few letters become several characters."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


def _learn(words: set[str], tokenizer, cache: dict[str, bytes]) -> None:
    """Add the ids of words to the cache.

    The tokenizer divides letters from a '.' or ',' behind them, so such a word is its stem and its mark. Stems of letters alone
    go through the tokenizer as one text: each is one run of letters, and the last token of a run ends with </w>.
    """
    stems = {w: (w[:-1], w[-1]) if w[-1] in ".," and _letters(w[:-1]) else (w, "") for w in words}
    new = {s for pair in stems.values() for s in pair if s and s not in cache}
    letters = [s for s in new if _letters(s)]
    ids = np.array(tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
    ends = np.flatnonzero(_state["last"][ids]) + 1
    if len(ends) == len(letters):
        data, a = ids.tobytes(), 0
        for s, b in zip(letters, (4 * ends).tolist(), strict=True):
            cache[s] = data[a:b]
            a = b
        new.difference_update(letters)
    rest = list(new)
    for s, found in zip(rest, tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
        cache[s] = np.array(found.ids, "<u4").tobytes()
    for w, (stem, mark) in stems.items():
        if mark:
            cache[w] = cache[stem] + cache[mark]


def _parts(text: str) -> Iterator[str]:
    """The text cut at white space into parts of little more than BYTES characters."""
    a = 0
    while a < len(text):
        m = _SPACE.search(text, a + BYTES) if len(text) > a + BYTES else None
        b = m.end() if m else len(text)
        yield text[a:b]
        a = b


def token_bytes(texts: list[str | None], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and no token spans it, so words are tokenised apart and kept, about BYTES of text
    at a time. Python's split() also divides at U+001C to U+001F; a text with those is tokenised whole.
    """
    tokenizer, cache = _tokenizer(path)
    out: list[list[bytes]] = [[] for _ in texts]
    held: list[tuple[int, list[str]]] = []

    def flush() -> None:
        missing = set().union(*(w for _, w in held)) - cache.keys()
        if len(cache) + len(missing) > CACHE_WORDS:
            cache.clear()
            missing = set().union(*(w for _, w in held))
        _learn(missing, tokenizer, cache)
        for i, w in held:
            out[i].append(b"".join(map(cache.__getitem__, w)))
        held.clear()

    size = 0
    for i, x in enumerate(texts):
        if x and (not _state["by_word"] or any(c in x for c in "\x1c\x1d\x1e\x1f")):
            out[i].append(np.array(tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes())
            continue
        for part in _parts(x or ""):
            held.append((i, part.split()))
            size += len(part)
            if size > BYTES:
                flush()
                size = 0
    flush()
    return [b"".join(x) for x in out]


def pieces(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits()) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, part (its task) and nth (its rank among the task's pieces of that length)."""
    kind, size = docs.schema["doc_id"].dataType.simpleString(), limits.capacity
    end = np.array([limits.end_id], "<u4").tobytes()

    def run(batches):
        seen: dict[int, int] = {}
        part = TaskContext.get().partitionId()
        for batch in slices(batches, limit=BYTES):
            rows, columns = [], [[] for _ in range(5)]
            for i, ids in enumerate(token_bytes(pc.ascii_lower(batch.column(1)).to_pylist(), tokenizer_path)):
                ids += end
                for k, a in enumerate(range(0, len(ids), 4 * size)):
                    data = ids[a : a + 4 * size]
                    n = len(data) // 4
                    rows.append(i)
                    for column, value in zip(columns, (k, a // 4, n, zlib.crc32(data), seen.get(n, 0)), strict=True):
                        column.append(value)
                    seen[n] = seen.get(n, 0) + 1
            k, start, n, crc, nth = columns
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).take(pa.array(rows, pa.int64())), "piece": pa.array(k, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "part": pa.array([part] * len(rows), pa.int32()), "nth": pa.array(nth, pa.int64())})
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def plan(histogram: dict[int, int], limits: Limits = Limits()) -> list[tuple[int, int, int, int, int]]:
    """Lines (length, rank from, how many, first sequence, offset): pieces of that length with ranks from .. from + many - 1 go to consecutive sequences.

    Longest first. A class is so many sequences that hold the same lengths: what each has free, how many there
    are, and the number of the first. Sequences that take several pieces of a length get one line for each.
    """
    top = np.array([limits.capacity, limits.max_documents, limits.max_attention], float)
    weight = np.array(limits.weights)
    free, meta, n = np.zeros((1024, 3)), np.zeros((1024, 2), np.int64), 0  # by class: what is free; how many, first number
    lines: list[tuple[int, int, int, int, int]] = []
    opened, lengths = 0, sorted(histogram, reverse=True)
    for place, length in enumerate(lengths):
        left, rank, demand = histogram[length], 0, np.array([length, 1, length * length], float)
        while left:
            after = free[:n] - demand
            fits = np.flatnonzero((after >= 0).all(axis=1))
            if n + 2 > len(free):
                free, meta = np.concatenate([free, np.zeros_like(free)]), np.concatenate([meta, np.zeros_like(meta)])
            if fits.size:
                c = fits[np.argmin(((after[fits] / top) ** 2 * weight).sum(axis=1))]
                many, offset = min(left, int(meta[c, 0])), limits.capacity - int(free[c, 0])
                if many < meta[c, 0]:  # the rest of the class stays as it was
                    free[n], meta[n] = free[c], (meta[c, 0] - many, meta[c, 1] + many)
                    meta[c, 0] = many
                    n += 1
            else:
                fit = max(1, int((top // demand).min()))
                many, offset, c = max(1, left // fit), 0, n  # full ones now; a rest opens another class
                free[c], meta[c] = top, (many, opened)
                opened, n = opened + many, n + 1
            lines.append((length, rank, many, int(meta[c, 1]), offset))
            free[c] -= demand
            left, rank = left - many, rank + many
        if place + 1 < len(lengths):  # classes that no later piece fits go
            use = (free[:n] >= (lengths[-1], 1, lengths[-1] ** 2)).all(axis=1)
            free[: use.sum()], meta[: use.sum()], n = free[:n][use], meta[:n][use], int(use.sum())
    return lines


def pack(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits()) -> DataFrame:
    """One row for each piece with its sequence_id and offset.

    Null and empty texts have the end id alone. Documents longer than the capacity are cut into pieces of the capacity
    and a rest; no other is cut, and a very long text is tokenised as a batch of its own. Pieces of equal length may change places. A null doc_id is passed on, repeated rows are packed each, an empty table gives
    an empty result, and other columns of docs are not read.
    """
    spark = docs.sparkSession
    cut_pieces = cut(pieces(docs, tokenizer_path, limits))
    counts = cut(cut_pieces.groupBy("length", "part").agg(F.count("*").alias("many")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("many").alias("n")).collect()}  # at most `capacity` rows
    lines = plan(histogram, limits)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("length", "part", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("before"))
    table = np.array(sorted(lines), np.int64).reshape(-1, 5)
    starts = {int(n): (a, b) for n, a, b in zip(*_segments(table[:, 0]), strict=True)}
    shared = spark.sparkContext.broadcast((table, starts))  # as many lines as lengths and classes, not as pieces
    kind = docs.schema["doc_id"].dataType.simpleString()

    def place(batches):
        lines, where = shared.value
        for batch in batches:
            length, rank = batch.column(4).to_numpy(), batch.column(6).to_numpy()
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                a, b = where[int(n)]
                at[own] = a + np.searchsorted(lines[a:b, 1], rank[own], "right") - 1
            found = lines[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2)), batch.column(4), batch.column(3), pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut_pieces.join(ranks.hint("merge"), ["length", "part"]).select("doc_id", "piece", "start", "ids_crc32", "length", "part", (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _segments(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, first, many = np.unique(values, return_index=True, return_counts=True)
    return found, first, first + many
