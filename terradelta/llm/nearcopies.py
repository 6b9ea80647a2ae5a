"""Near-duplicate classes by ProbMinHash (operator 4).

A document's different five-word shingles are elements. Each runs a Poisson process, of its weight's rate, whose arrivals fall on random
components of the signature; a component keeps the element that came first, and an element stops as soon as it can
no longer be first anywhere. Equal components estimate the probability Jaccard similarity. Bands of components gather
candidates; the exact similarity decides, at `similarity` or more: the probability Jaccard similarity of the weighted shingles, or the plain one of
the sets, so that no near copy is lost because a menu or a refrain repeats. Classes are the connected components.

A shingle that a document has n times weighs 1.5 - 0.5 / n, from 1 to under 1.5. Sets whose plain similarity is 0.8 then have a weighted one of at
least 0.8 / (0.8 + 0.2 * 1.5) = 0.72, at which 40 bands of 6 components miss two pairs in a thousand. Without `count_weights` each weighs 1.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import by_batch, cut, keyed, utf8, utf8_lower
from .components import components

#: Elements that compete at once.
ELEMENTS = 1 << 19
_STEP, _OTHER = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


@dataclass(frozen=True)
class Settings:
    shingle: int = 5  # words
    similarity: float = 0.8
    count_weights: bool = True  # a shingle weighs more where it repeats in the document
    bands: int = 40
    rows: int = 6  # components in a band
    estimate: float = 0.7  # pairs beside the bands' centres are checked when their signatures say so much; 4 standard errors below 0.8; less for repeated shingles
    block: int = 4096  # documents of a band's group that meet in one task; larger groups meet block by block
    partners: int = 1_000  # a text of more pairs, and more than one in `tasks` of all, is dealt in copies, so there are fewer than `tasks` such texts
    tasks: int = 10_000


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each shingle of lower-case words, repeats included, rows in order; a shorter text is one shingle."""
    rows, words, _ = bw.lower_words(*utf8_lower(column))
    n = len(rows)
    pre = bw.prefix(words)
    first = np.searchsorted(rows, np.arange(len(column)))
    many = np.diff(np.append(first, n))
    a = np.arange(n)
    full = np.zeros(n, bool)
    if n >= size:
        full[: n - size + 1] = rows[: n - size + 1] == rows[size - 1 :]
    short = first[(many > 0) & (many < size)]
    at = np.sort(np.concatenate([a[full], short]))
    end = np.where(full[at], at + size, at + many[rows[at]])
    return rows[at], bw.hash64(pre, at, end)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each different shingle of a row, sorted by row."""
    rows, hashes = shingles(column, size)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return rows[at], hashes[at], np.diff(np.append(at, len(rows)))


def weights_of(counts: np.ndarray, s: Settings) -> np.ndarray:
    return 1.5 - 0.5 / counts if s.count_weights else np.ones(len(counts))


def prob_min_hash(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures (n, k): in each component the element whose Poisson process of rate `weight` reached it first; 0 in rows without elements."""
    best, who = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
    latest = np.full(n, np.inf)
    for a in range(0, len(rows), ELEMENTS):
        _arrivals(rows[a : a + ELEMENTS], elements[a : a + ELEMENTS], weights[a : a + ELEMENTS], n, k, best, who, latest)
    return who.reshape(n, k)


def _arrivals(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, k: int, best: np.ndarray, who: np.ndarray, latest: np.ndarray) -> None:
    """Let these elements' arrivals compete in best (times), who (elements) and latest (by row, the last component's time)."""
    time, t = np.zeros(len(rows)), 0
    while len(rows):
        t += 1
        draw = bw.mix(elements + np.uint64(t * int(_STEP) & (1 << 64) - 1))
        time = time - np.log1p(-(draw >> np.uint64(11)).astype(float) * 2.0**-53) / weights
        on = time < latest[rows]  # later arrivals can change nothing any more
        rows, elements, weights, time, draw = rows[on], elements[on], weights[on], time[on], draw[on]
        if not len(rows):
            break
        slot = rows * k + ((bw.mix(draw ^ _OTHER) >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(best, slot, time)
        won = time == best[slot]
        who[slot[won]] = elements[won]
        live = np.unique(rows) if t > 4 else np.arange(n)
        latest[live] = best.reshape(n, k)[live].max(axis=1)


def signatures(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, h (digest of the text, null for null), keys (one 64-bit number a band; none without words), sketch (a byte a component) and extra.

    extra: by what share the weights of all shingles are more than their number.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    k = s.bands * s.rows

    def work(batch):
        column, n = batch.column(1), batch.num_rows
        rows, elements, counts = shingle_sets(column, s.shingle)
        weights = weights_of(counts, s)
        who = prob_min_hash(rows, elements, weights, n, k)
        many = np.bincount(rows, minlength=n)
        has = many > 0
        extra = np.bincount(rows, weights - 1, n) / np.maximum(many, 1)
        bands = who.reshape(n, s.bands, s.rows)
        keys = np.broadcast_to(np.arange(1, s.bands + 1, dtype=np.uint64), (n, s.bands)).copy()
        for j in range(s.rows):
            keys = bw.mix(keys * _STEP + bands[:, :, j])
        ends = np.concatenate([[0], np.cumsum(has * s.bands)]).astype(np.int32)
        buf, offsets = utf8(column)
        digests = [None if null else hashlib.blake2b(buf[a:b].tobytes(), digest_size=16).digest() for a, b, null in zip(offsets[:-1].tolist(), offsets[1:].tolist(), column.is_null().to_pylist(), strict=True)]
        sketch = (who & np.uint64(255)).astype(np.uint8)
        return {"doc_id": batch.column(0), "h": pa.array(digests, pa.binary()), "keys": pa.ListArray.from_arrays(ends, pa.array(keys[has].ravel().view(np.int64))), "sketch": pa.array([x.tobytes() for x in sketch], pa.binary()), "extra": pa.array(extra.astype(np.float32))}

    return by_batch(docs.select("doc_id", F.col("text").cast("string").alias("text")), work, f"doc_id {kind}, h binary, keys array<long>, sketch binary, extra float")


def similarities(one: tuple, two: tuple, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By row (n of them), the probability Jaccard similarity of two weighted sets, each (rows, elements, weights), and the plain one; 0 for empty ones.

    An element i of both adds 1 / sum over j of max(x_j / x_i, y_j / y_i). In order of x/y, the elements before i count by y, the others by x.
    """
    rows, elements = (np.concatenate(z) for z in zip(one[:2], two[:2], strict=True))
    x, y = np.concatenate([one[2], np.zeros(len(two[0]))]), np.concatenate([np.zeros(len(one[0])), two[2]])
    if not len(rows):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((elements, rows))
    rows, elements, x, y = rows[order], elements[order], x[order], y[order]
    at = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (elements[1:] != elements[:-1])))
    rows, x, y = rows[at], np.add.reduceat(x, at), np.add.reduceat(y, at)
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.lexsort((ratio, rows))
    rows, x, y, ratio = rows[order], x[order], y[order], ratio[order]
    first = np.searchsorted(rows, np.arange(n + 1))
    total_x, total_y = (np.concatenate([[0.0], np.cumsum(z)]) for z in (x, y))
    new = np.append(True, (rows[1:] != rows[:-1]) | (ratio[1:] != ratio[:-1]))
    low = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))  # where elements of this ratio begin
    both = np.flatnonzero((x > 0) & (y > 0))
    r, low = rows[both], low[both]
    share = 1 / ((total_x[first[r + 1]] - total_x[low]) / x[both] + (total_y[low] - total_y[first[r]]) / y[both])
    return np.bincount(r, share, n), np.bincount(r, minlength=n) / np.maximum(np.bincount(rows, minlength=n), 1)


def probability_jaccard(one: tuple, two: tuple, n: int) -> np.ndarray:
    return similarities(one, two, n)[0]


def verified(pairs: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """Of pairs (a, b) of doc_ids, a written table, those whose shingle sets have the similarity.

    Whole texts meet by joins on the ids, first of a, then of b; all texts are shuffled once for both. A text of very many pairs goes to several
    tasks, each with a part of its pairs.
    """
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    most = max(s.partners, 2 * pairs.count() // s.tasks)
    uses = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).groupBy("doc_id").agg(F.count("*").alias("n"))
    hubs = F.broadcast(uses.where(F.col("n") > most).select("doc_id", F.ceil(F.col("n") / most).alias("copies")))  # fewer than `tasks` rows
    copies = texts.join(hubs, "doc_id", "left").select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))

    def with_text(rows: DataFrame, end: str, name: str) -> DataFrame:
        dealt = rows.join(hubs.withColumnRenamed("doc_id", end), end, "left").withColumn(f"{end}_copy", F.coalesce(F.pmod(F.xxhash64("a", "b"), F.col("copies")), F.lit(0)))
        met = dealt.join(copies.alias("t").hint("merge"), (F.col(end) == F.col("t.doc_id")) & (F.col(f"{end}_copy") == F.col("t.copy")))
        return met.select(*rows.columns, F.col("t.text").alias(name))

    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch):
        sets = []
        for name in ("one", "other"):
            rows, elements, counts = shingle_sets(batch.column(batch.schema.get_field_index(name)), s.shingle)
            sets.append((rows, elements, weights_of(counts, s)))
        chosen = np.maximum(*similarities(*sets, batch.num_rows)) >= s.similarity - 1e-9
        keep = pa.array(chosen)
        return {"u": batch.column(batch.schema.get_field_index("a")).filter(keep), "v": batch.column(batch.schema.get_field_index("b")).filter(keep)}

    joined = with_text(with_text(pairs, "a", "one"), "b", "other")
    return by_batch(joined, work, f"u {kind}, v {kind}", text="one", limit=512 << 10)


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows (key, band, doc_id, label, sketch, earlier, extra) with a group in which they meet: groups of over `block` rows meet by pairs of blocks, so none is unbounded."""
    size = rows.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    split = rows.join(size, "key").withColumn("own", own).withColumn("other", other)
    return split.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "key", "band", "doc_id", "label", "sketch", "earlier", "extra")


def alike_across(rows: DataFrame, kind: str, s: Settings) -> DataFrame:
    """Pairs of different labels in one group whose sketches are alike enough, found within tasks; only those leave the task.

    `earlier` has a document's keys of the bands before the row's: a pair that shares several keys leaves from the first of them. At worst all extra
    weights of both lie on shingles that they don't share, which divides their weighted similarity by 1 + the sum of their shares, so their estimate
    may be less by as much.
    """

    def run(batches):
        held = None
        for batch in batches:  # a group has at most 2 * `block` rows
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            g = held.column(0).to_numpy()
            cut_at = int(np.searchsorted(g, g[-1])) if len(g) else 0  # the last group may go on
            if cut_at:
                yield from compare(held.slice(0, cut_at))
                held = held.slice(cut_at)
        if held is not None and held.num_rows:
            yield from compare(held)

    def compare(batch):
        g, key, band = (batch.column(i).to_numpy() for i in range(3))
        ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
        sketch = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(len(g), -1)
        before = np.arange(s.bands) < band[:, None]
        earlier = np.zeros(before.shape, np.int64)
        earlier[before] = batch.column(6).flatten().to_numpy()
        extra = batch.column(7).to_numpy()
        at, d = np.arange(len(g)), 0
        while True:
            d += 1
            at = at[at + d < len(g)]
            at = at[g[at] == g[at + d]]
            if not len(at):
                return
            x = at[(labels[at] != labels[at + d]) & (key[at] == key[at + d])]
            for part in np.array_split(x, len(x) // 20_000 + 1):
                same = (sketch[part] == sketch[part + d]).mean(axis=1)
                p = part[(same - 1 / 256) / (1 - 1 / 256) * (1 + extra[part] + extra[part + d]) >= s.estimate]
                p = p[~((earlier[p] == earlier[p + d]) & before[p]).any(axis=1)]
                if len(p):
                    yield pa.RecordBatch.from_pydict({"a": np.minimum(ids[p], ids[p + d]), "b": np.maximum(ids[p], ids[p + d])})

    spread = rows.repartition("g").sortWithinPartitions("g")
    return spread.select("g", "key", "band", "doc_id", "label", "sketch", "earlier", "extra").mapInArrow(run, f"a {kind}, b {kind}").where("a <> b").distinct()


def near_classes(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) for each row.

    Equal texts are one class, also without words; a null text is in a class of its own; rows of one doc_id are one document, whatever their
    texts; a null doc_id has a null class; a very long text is a batch of its own. Other columns aren't read, and an empty table gives an empty result.

    1. One document stands for each text. 2. In each group of equal band keys the one with most partners overall is the
    centre, and every other is checked against it. 3. What is then joined needs no more checks; all pairs of documents that share a group
    but no class yet are compared by signature within tasks, and the likely ones checked.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sig = cut(signatures(docs, s))
    named = sig.where("doc_id is not null")
    texts = cut(named.where("h is not null").groupBy("h").agg(F.min(F.struct("doc_id", "keys", "sketch", "extra")).alias("x")).select("h", "x.*"))
    rows = texts.select(F.posexplode("keys").alias("band", "key"), "doc_id")
    groups = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(rows.join(groups.hint("merge"), "key"))
    partners = shared.groupBy("doc_id").agg(F.sum("n").alias("partners"))
    ranked = shared.join(partners.hint("merge"), "doc_id").select("key", "doc_id", "partners")
    centre = ranked.groupBy("key").agg(F.min(F.struct((-F.col("partners")).alias("p"), "doc_id")).getField("doc_id").alias("b"))
    pairs = cut(shared.select("key", F.col("doc_id").alias("a")).join(centre.hint("merge"), "key").where("a <> b").select("a", "b").distinct())
    links = cut(verified(pairs, docs, s))
    # rows of one doc_id with different texts are one document
    same = named.where("h is not null").select("doc_id", "h").join(texts.select("h", F.col("doc_id").alias("first")), "h").where("doc_id <> first").select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    links = links.union(same)
    label = cut(components(links))
    labelled = shared.select("key", "band", "doc_id").join(label, shared.doc_id == label.node, "left").select("key", "band", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    rest = cut(labelled.join(open_keys.hint("merge"), "key"))
    with_sketch = rest.join(texts.select("doc_id", "sketch", "keys", "extra").hint("merge"), "doc_id").withColumn("earlier", F.slice("keys", F.lit(1), F.col("band")))
    more = alike_across(_blocks(with_sketch, s.block), kind, s)
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    late = verified(cut(more.join(ordered, ["a", "b"], "left_anti")), docs, s)
    final = cut(components(label.select(F.col("node").alias("u"), F.col("label").alias("v")).union(late)))
    out = sig.select("doc_id")
    return out.join(final.hint("merge"), out.doc_id == final.node, "left").select("doc_id", F.coalesce("label", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs with one row of each class: that of the least doc_id, a null one before all. Each row is judged by its text, also where doc_ids repeat or lack."""
    key = "number of a row of docs"
    named = keyed(docs, key)
    classes = near_classes(named.select(F.col(key).alias("doc_id"), "text"), s).where("class_id < doc_id").select(F.col("doc_id").alias(key))
    return named.join(classes.hint("merge"), key, "left_anti").select(*docs.columns)
