"""Removal of repeated byte strings by a hash-compared suffix sort (operator 3).

A byte goes if a string of `length` bytes that covers it also starts earlier. Suffixes are compared through prefix polynomial
hashes: binary search finds their common extension, so a comparison takes logarithmic time; a mergesort orders
them, and neighbours of equal hash are compared byte by byte.

Not every suffix needs sorting. Each stretch of `length` bytes has an anchor, the place of its least `gram`-byte hash (the first
of equal ones); equal stretches have their anchor at the same place. Neighbouring stretches of one anchor are a segment. A segment that an equal
one precedes in its batch, byte by byte, is settled there, so a common segment leaves each batch once; across batches the
gram's and the whole segment's 64-bit hashes settle it. Only segments that share the anchor's gram with a different
segment have their suffixes sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import new_path, scratch
from . import bytewords as bw
from .common import by_batch, cut, keyed, tidy, utf8

#: A segment's place in its text in one number: start, number of stretches.
_MANY = 7
_AT = np.uint64((1 << 30) - 1)
#: Parts of what settle() gives out.
SURE, COMMON, FIRST = 0, 1, 2
#: Bytes that are searched for anchors at once: longer texts are cut into overlapping stretches.
CHUNK = 2 << 20


@dataclass(frozen=True)
class Settings:
    length: int = 100  # bytes of a repeated string
    gram: int = 36  # bytes of an anchor; length - gram < 127
    hot: int = 256  # different segments of one anchor from which each stretch is dealt by its own hash
    block: int = 150_000  # suffixes sorted at once
    sampled: float = 1 / 64  # share of the segments in which common grams are looked for; it decides how rows are dealt, not what is found
    common: int = 64  # a gram is common that has more of these and more than one in `tasks`, so there are fewer than `tasks` common ones
    tasks: int = 20_000


def pack_place(start, many):
    return (start << _MANY) | many


def unpack_place(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return place >> _MANY, place & ((1 << _MANY) - 1)


# --- the sort -------------------------------------------------------------------------------------------------


def common_extension(pre: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at a and b, at most `most`, by binary search over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), most)
    equal = bw.stretch(pre, a, a + most) == bw.stretch(pre, b, b + most)
    low[equal] = most
    left = np.flatnonzero(~equal)
    while len(left):
        mid = (low[left] + high[left]) // 2  # the answer is in [low, high)
        x, y = a[left], b[left]
        same = bw.stretch(pre, x, x + mid) == bw.stretch(pre, y, y + mid)
        low[left[same]], high[left[~same]] = mid[same], mid[~same]
        left = left[high[left] - low[left] > 1]
    return low


def _before(text: np.ndarray, pre: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """-1, 0 or 1 as suffix a comes before, equals or comes after b in their first `most` bytes."""
    n = common_extension(pre, a, b, most)
    end = n >= most
    x, y = text[np.where(end, a, a + n)].astype(np.int16), text[np.where(end, b, b + n)].astype(np.int16)
    return np.where(end, 0, np.sign(x - y))


def suffix_mergesort(text: np.ndarray, pre: np.ndarray, at: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """A stable order of the suffixes at `at` within each group (equal groups stand together), by their first `most` bytes.

    Bottom-up: runs of width 1, 2, 4, ... are merged in all groups at once; each suffix finds its rank in the
    other run by binary search.
    """
    n = len(at)
    order = np.arange(n)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    head, many = np.repeat(first, size), np.repeat(size, size)
    place = np.arange(n) - head
    width = 1
    while n and width < size.max():
        mine = np.flatnonzero(many > width)  # groups with more than one run
        p, h, m = place[mine], head[mine], many[mine]
        run = p // width
        right = run % 2 == 1
        a = np.where(right, run - 1, run + 1) * width  # the partner run
        low, high = np.minimum(a, m), np.minimum(a + width, m)
        start = low.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            c = _before(text, pre, at[order[h[open_] + mid]], at[order[mine[open_]]], most)
            goes = (c < 0) | ((c == 0) & right[open_])  # the partner's element stands before mine
            low[open_[goes]], high[open_[~goes]] = mid[goes] + 1, mid[~goes]
        pair = (run // 2) * 2 * width
        target = h + pair + (p - run * width) + (low - start)
        new = order.copy()
        new[target] = order[mine]
        order = new
        width *= 2
    return order


def repeats(text: np.ndarray, at: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """True for each suffix whose first `most` bytes an earlier one of its group has; `at` in order of precedence within a group."""
    pre = bw.prefix(text)
    order = suffix_mergesort(text, pre, at, group, most)
    out = np.zeros(len(at), bool)
    a, b = order[:-1], order[1:]
    alike = np.flatnonzero((group[a] == group[b]) & (bw.stretch(pre, at[a], at[a] + most) == bw.stretch(pre, at[b], at[b] + most)))
    for part in np.array_split(alike, len(alike) // 50_000 + 1):  # equal hashes prove nothing: the bytes decide
        span = np.arange(most)
        same = (text[at[a[part]][:, None] + span] == text[at[b[part]][:, None] + span]).all(axis=1)
        out[b[part[same]]] = True
    return out


# --- anchors --------------------------------------------------------------------------------------------------


def segments(buf: np.ndarray, offsets: np.ndarray, s: Settings) -> dict[str, np.ndarray]:
    """row, start in the row, number of stretches, anchor's offset, gram hash and segment hash of each segment, in order."""
    n, w = len(buf), s.length - s.gram + 1
    if n > int(_AT):
        raise ValueError("a batch has over 2**30 bytes")
    empty = dict.fromkeys(("row", "start", "many", "off", "gram", "whole"), np.zeros(0, np.int64))
    if n < s.length:
        return empty
    pre = bw.prefix(buf)
    at = np.arange(n - s.gram + 1)
    grams = bw.mix(bw.stretch(pre, at, at + s.gram))
    least = (grams & ~_AT) | at.astype(np.uint64)  # the first of equal hashes is least
    width = 1
    while 2 * width <= w:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < w:
        least = np.minimum(least[: len(least) - (w - width)], least[w - width :])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    p = np.flatnonzero(row[: n - s.length + 1] == row[s.length - 1 :])  # stretches within one row
    if not len(p):
        return empty
    anchor = (least[p] & _AT).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)
    k = np.flatnonzero(new)
    many = np.diff(np.append(k, len(p)))
    a = p[k]
    off = anchor[k] - a
    whole = bw.mix(bw.hash64(pre, a, a + many - 1 + s.length) + off.astype(np.uint64))
    return {"row": row[a], "start": a - offsets[row[a]], "many": many, "off": off, "gram": grams[anchor[k]], "whole": whole}


def _stretches(offsets: np.ndarray, s: Settings) -> list[tuple[int, int]]:
    """First and last byte of overlapping stretches of at most CHUNK bytes; every string of `length` bytes is whole in one."""
    n = int(offsets[-1])
    return [(a, min(a + CHUNK + s.length - 1, n)) for a in range(0, n, CHUNK)]


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether buf[a:a+size] and buf[b:b+size] are equal, for arrays of places and sizes of at least 1."""
    out = np.empty(len(a), bool)
    for i in range(0, len(a), 10_000):
        x, y, n = a[i : i + 10_000, None], b[i : i + 10_000, None], size[i : i + 10_000, None]
        span = np.minimum(np.arange(n.max()), n - 1)
        out[i : i + 10_000] = (buf[x + span] == buf[y + span]).all(axis=1)
    return out


def anchors(docs: DataFrame, s: Settings) -> DataFrame:
    """key, place, gram, whole of each segment; gram is null where an equal segment stands before it in the same batch, which settles it."""

    def work(batch):
        buf, offsets = utf8(batch.column(1))
        ids = batch.column(0).to_numpy()
        for low, high in _stretches(offsets, s):
            near = np.clip(offsets, low, high) - low
            x = segments(buf[low:high], near, s)
            row, a = x["row"], x["start"] + near[x["row"]]  # a: in buf[low:high]
            key, place = ids[row], pack_place(a + low - offsets[row], x["many"])
            # rows come in any order of key: the least place of equal segments stays
            order = np.lexsort((place, key, x["whole"]))
            one, two = order[:-1], order[1:]
            k = np.flatnonzero((x["whole"][one] == x["whole"][two]) & (x["gram"][one] == x["gram"][two]) & (x["many"][one] == x["many"][two]))
            k = k[same_bytes(buf[low:high], a[one[k]], a[two[k]], x["many"][one[k]] - 1 + s.length)]
            again = np.zeros(len(order), bool)
            again[two[k]] = True
            yield {"key": key, "place": place, "gram": pa.array(x["gram"].view(np.int64), mask=again), "whole": x["whole"].view(np.int64)}

    return by_batch(docs.select("key", "text"), work, "key long, place long, gram long, whole long", limit=CHUNK, rows=1 << 20)


def settle(found: DataFrame, s: Settings = Settings()) -> DataFrame:
    """From anchors with a gram: segments equal to an earlier one (gram null), and the first of each where its gram has several (gram kept).

    The rows of a gram meet in one task, but those of common grams: their first segments are a grouped minimum, combined before the shuffle, and are
    all kept, so no task gets all copies of a common segment. All segments of common grams come with a null gram too, in part COMMON, without having
    been shuffled: those that are also in part FIRST stay.
    """
    part = found.sample(s.sampled, 1).select("gram")
    most = max(s.common, part.count() // s.tasks)
    hot = F.broadcast(part.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > most).select("gram"))  # fewer than `tasks` rows
    common = found.join(hot, "gram", "left_semi")
    first = common.groupBy("gram", "whole").agg(F.min(F.struct("key", "place")).alias("x")).select("x.key", "x.place", "gram", F.lit(FIRST).alias("part"))
    every = common.select("key", "place", F.lit(None).cast("long").alias("gram"), F.lit(COMMON).alias("part"))
    rest = found.join(hot, "gram", "left_anti").select("key", "place", "gram", "whole")
    return _settled(rest).withColumn("part", F.lit(SURE)).union(every).union(first)


def _settled(found: DataFrame) -> DataFrame:
    """The same, with all rows of a gram in one task."""

    def run(batches):
        held = None  # the last gram's last first segment: (key, place, gram, whole), and whether it was given out
        for batch in batches:
            ids, place, gram, whole = (batch.column(i).to_numpy() for i in range(4))
            out = np.ones(len(ids), bool)
            if held is not None:
                ids, place, gram, whole = (np.concatenate([[x], y]) for x, y in zip(held[0], (ids, place, gram, whole), strict=True))
                out = np.concatenate([[not held[1]], out])
            if not len(ids):
                continue
            new_gram = np.append(True, gram[1:] != gram[:-1])
            first = new_gram | np.append(True, whole[1:] != whole[:-1])
            run_of = np.cumsum(new_gram) - 1
            several = np.bincount(run_of, first) > 1
            if held is not None and held[1]:
                several[0] = True
            last = np.flatnonzero(first)[-1]
            shared = first & several[run_of]
            give = (shared | ~first) & out
            held = ((ids[last], place[last], gram[last], whole[last]), bool(several[-1]))
            yield pa.RecordBatch.from_pydict({"key": ids[give], "place": place[give], "gram": pa.array(gram[give], mask=~shared[give])})

    return found.repartition("gram").sortWithinPartitions("gram", "whole", "key", "place").select("key", "place", "gram", "whole").mapInArrow(run, "key long, place long, gram long")


# --- the operator ---------------------------------------------------------------------------------------------


def _by_document(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows of each document in one list; a document's segments are no more than its bytes."""
    return rows.groupBy("key").agg(F.collect_list(F.struct(*columns)).alias("found"))


def _take_suffixes(joined: DataFrame, s: Settings) -> DataFrame:
    """bucket, key, place and bytes of each segment to sort. A hot gram's stretches go to buckets of their own."""

    def work(batch):
        buf, offsets = utf8(batch.column(2))
        lists = batch.column(1)
        flat = lists.flatten()
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        place, gram, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        start, many = unpack_place(place)
        a = offsets[row] + start
        one = np.flatnonzero(hot)
        if len(one):
            size = many[one]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            k = np.repeat(one, size)
            b = a[k] + inner
            own, ordered = np.empty(len(b), np.int64), np.argsort(b, kind="stable")
            own[ordered] = bw.hashes(buf, b[ordered], b[ordered] + s.length).view(np.int64)
            cold = np.flatnonzero(~hot.astype(bool))
            row, a = np.concatenate([row[cold], row[k]]), np.concatenate([a[cold], b])
            place = np.concatenate([place[cold], pack_place(start[k] + inner, 1)])
            gram, many = np.concatenate([gram[cold], own]), np.concatenate([many[cold], np.ones(len(k), np.int64)])
        # the anchor: where the gram stands among the stretches is the same for equal ones
        ends = a + many - 1 + s.length
        data, key = buf.tobytes(), batch.column(0).to_numpy()[row]
        for i in range(0, len(a), 100_000):
            pieces = [data[x:y] for x, y in zip(a[i : i + 100_000].tolist(), ends[i : i + 100_000].tolist(), strict=True)]
            yield {"bucket": gram[i : i + 100_000], "key": key[i : i + 100_000], "place": place[i : i + 100_000], "bytes": pa.array(pieces, pa.binary())}

    return by_batch(joined.select("key", "found", "text"), work, "bucket long, key long, place long, bytes binary")


def _sorted_repeats(suffixes: DataFrame, s: Settings) -> DataFrame:
    """key and place of each run of stretches that stand earlier too: the suffix sort, bucket by bucket."""

    def anchor_in(text, pre, head, size, many, bucket):
        """Where each segment has its anchor: the first gram, among those that all its stretches hold, whose hash is the bucket's; 0 in hot buckets."""
        out, open_ = np.zeros(len(head), np.int64), np.arange(len(head))
        for step in range(s.length - s.gram + 1):
            q = many[open_] - 1 + step
            inside = q + s.gram <= size[open_]
            open_, q = open_[inside], q[inside]
            x = head[open_] + q
            hit = bw.mix(bw.stretch(pre, x, x + s.gram)).view(np.int64) == bucket[open_]
            out[open_[hit]] = q[hit]
            open_ = open_[~hit]
        return out

    def solve(bucket, ids, place, pieces, kept):
        """The repeats among these rows; `kept` (bucket, offsets, suffixes) holds what the first bucket had before."""
        start, many = unpack_place(place)
        text = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.array([len(x) for x in pieces])
        head = np.cumsum(size) - size
        row = np.repeat(np.arange(len(ids)), many)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        # equal stretches have the anchor at the same place, so only those are sorted together
        off = anchor_in(text, bw.prefix(text), head, size, many, bucket)[row] - inner
        at, of = head[row] + inner, bucket[row]
        if kept and len(kept[2]):
            old = np.frombuffer(b"".join(kept[2]), np.uint8)
            at = np.concatenate([np.arange(len(kept[2])) * s.length, at + len(old)])
            of, off, text = np.concatenate([np.full(len(kept[2]), kept[0]), of]), np.concatenate([kept[1], off]), np.concatenate([old, text])
        order = np.lexsort((off, of))
        new = np.append(True, (of[order][1:] != of[order][:-1]) | (off[order][1:] != off[order][:-1]))
        again = np.empty(len(at), bool)
        again[order] = repeats(text, at[order], np.cumsum(new), s.length)
        mine = again[len(at) - len(row) :]
        fresh = np.flatnonzero((of == bucket[-1]) & ~again)
        # neighbouring repeated stretches of one segment are one run
        k = np.flatnonzero(mine)
        joined = np.zeros(len(k), bool)
        joined[1:] = (row[k[1:]] == row[k[:-1]]) & (k[1:] == k[:-1] + 1)
        firsts = np.flatnonzero(~joined)
        length = np.diff(np.append(firsts, len(k)))
        k = k[firsts]
        return {"key": ids[row[k]], "place": pack_place(start[row[k]] + inner[k], length)}, (bucket[-1], off[fresh], [text[x : x + s.length].tobytes() for x in at[fresh].tolist()])

    def run(batches):
        waiting, n, kept = [], 0, None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            many = unpack_place(columns[2])[1]
            ends = np.searchsorted(np.cumsum(many), np.arange(s.block, many.sum() + s.block, s.block), "right").tolist()
            a = 0
            for b in [*dict.fromkeys(ends), len(many)]:
                b = min(max(b, a + 1), len(many))
                if a >= len(many):
                    break
                waiting.append([c[a:b] for c in columns])
                n += int(many[a:b].sum())
                a = b
                if n >= s.block:
                    found, kept = solve(*(np.concatenate(x) for x in zip(*waiting, strict=True)), kept)
                    waiting, n = [], 0
                    yield pa.RecordBatch.from_pydict(found)
        if waiting:
            yield pa.RecordBatch.from_pydict(solve(*(np.concatenate(x) for x in zip(*waiting, strict=True)), kept)[0])

    return suffixes.repartition("bucket").sortWithinPartitions("bucket", "key", "place").select("bucket", "key", "place", "bytes").mapInArrow(run, "key long, place long")


def united(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the maximal runs that the stretches [a, b) of the rows cover; touching ones are one run."""
    order = np.lexsort((a, row))
    row, a, b = row[order], a[order], b[order]
    if not len(row):
        return row, a, b
    first = np.append(True, row[1:] != row[:-1])
    wide = int(b.max()) + 1
    reach = np.maximum.accumulate(b + row * wide) - row * wide  # the farthest end so far in the row
    new = first | np.append(True, a[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return row[at], a[at], reach[np.append(at[1:], len(row)) - 1]


def _cut_out(joined: DataFrame, s: Settings) -> DataFrame:
    def work(batch):
        buf, offsets = utf8(batch.column(2))
        lists, n = batch.column(1), batch.num_rows
        row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
        place, part = (lists.flatten().field(i).to_numpy() for i in range(2))
        # the first segments among those of common grams stay
        named = row * (int(place.max(initial=0)) + 1) + place
        goes = (part == SURE) | ((part == COMMON) & ~np.isin(named, named[part == FIRST]))
        row, (start, many) = row[goes], unpack_place(place[goes])
        row, a, b = united(row, start, start + many - 1 + s.length)
        data, kept, at = buf.tobytes(), [], [0] * n
        pieces: list[list[bytes]] = [[] for _ in range(n)]
        for r, x, y in zip(row.tolist(), a.tolist(), b.tolist(), strict=True):
            pieces[r].append(data[offsets[r] + at[r] : offsets[r] + x])
            at[r] = y
        for r, p in enumerate(pieces):
            p.append(data[offsets[r] + at[r] : offsets[r + 1]])
            kept.append(b"".join(p))
        size = np.diff(offsets)
        return {"doc_id": batch.column(0), "n_bytes": size, "n_removed": size - np.array([len(x) for x in kept], np.int64), "n_spans": bw.per_row(row, n), "kept": pa.array(kept, pa.binary())}

    kind = joined.schema["doc_id"].dataType.simpleString()
    return by_batch(joined.select("doc_id", "found", "text"), work, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def _gone(named: DataFrame, s: Settings, path: str) -> DataFrame:
    """key, place and part of the segments and runs that _cut_out() goes by, written to `path`. What is written on the way goes as soon as the next step has it."""
    spark = named.sparkSession
    with scratch(spark):
        here = new_path(spark, "cut")
        with scratch(spark):
            found = cut(anchors(named, s))
            again = found.where("gram is null").select("key", "place", "gram", F.lit(SURE).alias("part"))
            settled = cut(settle(found.where("gram is not null"), s).union(again), here)
        rivals = settled.where("gram is not null")
        hot = rivals.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > s.hot).select("gram", F.lit(True).alias("hot"))
        marked = rivals.join(hot.hint("merge"), "gram", "left").select("key", "place", "gram", F.coalesce("hot", F.lit(False)).alias("hot"))
        wanted = _by_document(marked, "place", "gram", "hot")
        suffixes = _take_suffixes(named.join(wanted.hint("merge"), "key"), s)
        late = _sorted_repeats(suffixes, s).withColumn("part", F.lit(SURE))
        return cut(late.union(settled.where(f"gram is null or part = {FIRST}").select("key", "place", "part")), path)


def remove_repeats(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of each row.

    Null and empty texts have no bytes. doc_ids may be of any type with an order; a null one comes before all others. Rows of one doc_id come in
    the order of a hash of their texts, equal rows in any, so one of them keeps its bytes. Long texts are searched in overlapping stretches. Other
    columns aren't read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    with tidy(spark):
        named = keyed(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "key")
        gone = _gone(named, s, new_path(spark, "cut"))
    spans = _by_document(gone, "place", "part")
    joined = named.join(spans.hint("merge"), "key", "left").select("doc_id", F.coalesce("found", F.array().cast("array<struct<place:long,part:int>>")).alias("found"), "text")
    return _cut_out(joined, s)


def digests(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    return remove_repeats(docs, s).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
