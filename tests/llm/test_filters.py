"""Filter interaction audit, line dedup and periodic runs against plain versions, and their odd cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terradelta.llm import audit, hotkeys, lines, periodic
from terradelta.llm import queries as q

from .test_operators import SCHEMA, documents, odd, prose  # noqa: F401

LABELS = "doc_id long, quality int, toxic int"


# 11 -----------------------------------------------------------------------------------------------------------


def plain_fails(rows):
    """The failed letters of each row (doc_id, text)."""
    out = []
    for doc_id, text in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        key = lambda i: math.inf if i is None else i
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text))}
        fails["E"] = any((t or "") == text and key(i) < key(doc_id) for i, t in rows)
        out.append({k for k, v in fails.items() if v})
    return out


def plain_audit(rows, labels):
    fails = plain_fails([r[:2] for r in rows])
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    out = {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            alive = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in alive if f in x[1]]
                failing = [x for x in mine if f in x[1]]
                alive = [x for x in alive if f not in x[1]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(alive), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in mine), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def audited(docs, labels):
    rows = audit.audit(docs, labels).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    out = {(r.part, r.filter_order, r.step): [r[k] for k in names] for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit(spark):
    r, rows = random.Random(11), []
    for i in range(60):
        n = r.choice([0, 5, 99, 100, 130])
        words = [r.choice(["Aa", "B", "c"]) if r.random() < 0.3 else f"w{j}" for j in range(n)]
        text = " ".join(words) + r.choice(["", " #", " %x"])
        rows.append((i, r.choice([text, rows[r.randrange(len(rows))][1] if rows else text, None, "ABC DEF"]), r.choice(["en", "de", None, ""])))
    labels = [(i, r.randrange(2), r.choice([0, 1, None])) for i in range(0, 80, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert audited(docs, spark.createDataFrame(labels, LABELS)) == plain_audit(rows, labels)


def test_audit_odd(spark, odd):  # noqa: F811
    labels = spark.createDataFrame([(4, 1, 1)], LABELS)
    rows = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    assert audited(odd, labels) == plain_audit(rows, [(4, 1, 1)])
    assert audit.audit(odd.limit(0), labels).count() == 0
    assert audited(odd, labels.limit(0)) == plain_audit(rows, [])


def test_interactions_of_other_filters(spark):
    docs = spark.range(10).select(F.col("id").alias("_row"), F.col("id").alias("doc_id"), F.lit("p").alias("part"))
    failing = {k: spark.createDataFrame([(i,) for i in ids], "_row long") for k, ids in {"x": [1, 2, 3], "y": [3, 4]}.items()}
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in audit.interactions(docs, failing, spark.createDataFrame([], LABELS)).collect()}
    assert got == {("xy", 1): (7, 3, 0, 2, 5), ("xy", 2): (6, 1, 1, 1, 3), ("yx", 1): (8, 2, 0, 1, 3), ("yx", 2): (6, 2, 1, 2, 5)}


def test_join_of_hot_keys(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    counted = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("more", F.col("k") + 1)
    got = hotkeys.join_counted(rows, counted, "k", "n", 3000)
    assert got.count() == 3000 and got.where("more <> k + 1").count() == 0


# 12 -----------------------------------------------------------------------------------------------------------


def plain_key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({i: i + 32 for i in range(65, 91)})


def plain_lines(rows, least=2, chars=10):
    docs = [(i, (t or "").split("\n")) for i, t in rows]
    seen = collections.defaultdict(set)
    for i, ls in docs:
        for line in ls:
            seen[plain_key(line)].add(math.inf if i is None else i)
    out = []
    for i, ls in docs:
        keep = [x for x in ls if len(plain_key(x)) < chars or len(seen[plain_key(x)]) < least or min(seen[plain_key(x)]) == (math.inf if i is None else i)]
        out.append((i, "\n".join(keep), len(ls), len(ls) - len(keep)))
    return sorted(out, key=str)


def test_lines(spark):
    r = random.Random(12)
    pool = ["short", "a line of text", " A Line of TEXT\t", "ÉCOLE normale sup", "école normale sup", "ten chars!", "nine char", "", "  ", "\x0bvertical tab line\x0c", "nbsp line here ", "one more line\r"]
    rows = [(i * 7 % 61, "\n".join(r.choice(pool) if r.random() < 0.6 else f"line {r.randrange(10**6)} of {i}" for _ in range(r.randrange(12)))) for i in range(60)] + [(100, None), (101, ""), (102, "\n\n"), (103, "a line of text\n" * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, lines.dedup_lines(docs).collect()), key=str) == plain_lines(rows)
    three = lines.LineRules(least_chars=5, least_documents=3)
    assert sorted(map(tuple, lines.dedup_lines(docs, three).collect()), key=str) == plain_lines(rows, 3, 5)


def test_lines_odd(spark, odd):  # noqa: F811
    long = spark.createDataFrame([(90, "\n".join(f"line number {i % 50_000}" for i in range(100_000)), "en", "s", 1), (91, "line number 7", "en", "s", 1), (89, "line number 8", "en", "s", 1)], SCHEMA)
    docs = odd.unionByName(long, allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, lines.dedup_lines(docs).collect()), key=str) == plain_lines(rows)
    assert lines.dedup_lines(odd.limit(0)).count() == 0


def test_lines_are_native(spark):
    plan = lines.dedup_lines(documents(spark, ["some line of text\nother"] * 3))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# 13 -----------------------------------------------------------------------------------------------------------


def plain_runs(w, least=12):
    """All runs by trying every period."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p - i), p)
            i = j
    return sorted((s, n, p) for (s, n), p in found.items())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def samples():
    r = random.Random(13)
    out = [fibonacci(400), list("a" * 300), list("ab" * 90 + "a" * 80 + "ab" * 50), (list("a" * 30) + ["b"]) * 12, list("aabaab" * 20 + "c" + "aab" * 30), [], ["x"] * 11, ["x"] * 12]
    thue = [0]
    while len(thue) < 256:
        thue += [1 - x for x in thue]
    out.append([str(x) for x in thue])
    for _ in range(150):
        n, k = r.randrange(1, 140), r.choice([1, 2, 2, 3, 5])
        w = [r.choice("abcde"[:k]) for _ in range(n)]
        for _ in range(r.randrange(4)):
            s, p, m = r.randrange(n), r.randrange(1, 20), r.randrange(60)
            w[s : s + m] = (w[s : s + p] * m)[:m]
        out.append(w)
    return out


@pytest.mark.parametrize("least", [12, 2, 5, 16, 31])
def test_runs(least):
    texts = samples()
    ids = {w: i for i, w in enumerate(sorted({x for t in texts for x in t}))}
    padded, starts = [-1], []
    for k, t in enumerate(texts):
        starts.append(len(padded))
        padded += [ids[x] * len(texts) + k for x in t] + [-2 - k]
    s, n, p = periodic.runs(np.array(padded), periodic.RunRules(least_words=least))
    got = collections.defaultdict(list)
    for a, b, c in zip(s, n, p, strict=True):
        k = np.searchsorted(starts, a, "right") - 1
        while a - starts[k] >= len(texts[k]):
            k -= 1
        got[k].append((a - starts[k], b, c))
    for k, t in enumerate(texts):
        assert got[k] == plain_runs(t, least), (k, t)


def collapsed(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + p <= i < s + n for s, n, p in runs))


def test_periodic_runs(spark):
    texts = [" ".join(w) for w in samples()] + [None, "", " \n\t"]
    for r in periodic.periodic_runs(documents(spark, texts)).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        want = plain_runs(w)
        assert [tuple(x) for x in r.runs] == want
        assert (r.n_words, r.text) == (len(w), collapsed(w, want))


def test_periodic_odd(spark, odd):  # noqa: F811
    more = spark.createDataFrame([(90, "one two three " * 200_000 + prose(2000, 5), "en", "s", 1)], SCHEMA)
    rows = periodic.periodic_runs(odd.unionByName(more, allowMissingColumns=True)).collect()
    assert len(rows) == odd.count() + 1
    assert next([tuple(x) for x in r.runs] for r in rows if r.doc_id == 90) == [(0, 600_000, 3)]
    assert periodic.periodic_runs(odd.limit(0)).count() == 0


def test_query_of_planted_runs(spark, tmp_path):
    texts = [prose(3 + 17 * i % 400, i) for i in range(120)] + [None, "", "one word\n\tor three "]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in q.op13_basic_factors(spark, str(tmp_path)).collect()}
    planted = 0
    for i, text in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if j < a else w[a + (j - a) % p] for j, x in enumerate(w)]
        want = plain_runs(w)
        planted += bool(want)
        best = min(want, key=lambda x: (-x[1], x[0], x[2])) if want else (None,) * 3
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected = (i, len(want), *best, 1000 * best[1] // best[2] if want else None, digest("".join("%d,%d,%d\n" % x for x in want)), digest(collapsed(w, want)))
        assert tuple(rows[i]) == expected
    assert planted > 5
