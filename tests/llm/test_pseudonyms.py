"""The pseudonyms of every given document against a plain finder and a plain permutation, written from the formats' definitions."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from terradelta.llm import pseudonyms

DATA = "/root/testdata/sf0.01/documents.parquet"
KEY = b"a key of the test"
DIGIT = set("0123456789")
LETTER = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
WORD = DIGIT | LETTER


# formats: each part gives the ends that it can have from a place on, the longest first


def one(chars):
    return lambda t, i: [i + 1] if i < len(t) and t[i] in chars else []


def times(chars, least, most):
    def ends(t, i):
        n = 0
        while n < most and i + n < len(t) and t[i + n] in chars:
            n += 1
        return [i + k for k in range(n, least - 1, -1)]

    return ends


def maybe(chars):
    return times(chars, 0, 1)


def row(*parts):
    def ends(t, i):
        out = [i]
        for p in parts:
            out = [e for j in out for e in p(t, j)]
        return out

    return ends


def same_mark(marks, *sizes):
    """Groups of digits between equal marks."""

    def ends(t, i):
        return [e for m in marks for e in row(*[p for k, n in enumerate(sizes) for p in ([one({m})] if k else []) + [times(DIGIT, n, n)]])(t, i)]

    return ends


GAP = set(" .-")
three, four = times(DIGIT, 3, 3), times(DIGIT, 4, 4)
FORMATS = [
    ("phone", row(one({"+"}), times(DIGIT, 1, 3), maybe(GAP), maybe({"("}), three, maybe({")"}), maybe(GAP), three, maybe(GAP), four)),
    ("phone", row(one({"("}), three, one({")"}), maybe({" "}), three, one(GAP), four)),
    ("phone", same_mark(GAP, 3, 3, 4)),
    ("ip", row(times(DIGIT, 1, 3), *(p for _ in range(3) for p in (one({"."}), times(DIGIT, 1, 3))))),
    ("date", same_mark("-/.", 4, 2, 2)),
    ("date", same_mark("-/.", 2, 2, 4)),
    ("ssn", row(three, one({"-"}), times(DIGIT, 2, 2), one({"-"}), four)),
    ("card", row(one(DIGIT), *(p for _ in range(12) for p in (maybe(set(" -")), one(DIGIT))), *(lambda t, i: [e for e in row(maybe(set(" -")), one(DIGIT))(t, i)] + [i] for _ in range(6)))),
]


def numbers(text):
    """Kind, start and end of each value, from the left."""
    i = 0
    while i < len(text):
        free = (i == 0 or text[i - 1] not in WORD) and not (i > 1 and text[i - 1] in ".-" and text[i - 2] in DIGIT)
        hit = None
        if free and text[i] in DIGIT | {"+", "("}:
            for kind, ends in FORMATS:
                good = [e for e in ends(text, i) if not (e < len(text) and text[e] in WORD) and not (e + 1 < len(text) and text[e] in ".-" and text[e + 1] in DIGIT)]
                if good:
                    hit = (kind, i, good[0])
                    break
        if hit:
            yield hit
            i = hit[2]
        else:
            i += 1


def mails(text):
    """Start and end (with the @) of the name of each mail address."""
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in WORD | set("._%+-"):
            start -= 1
        labels, i = 0, at + 1
        while i < len(text) and text[i] in WORD | {"-"}:
            while i < len(text) and text[i] in WORD | {"-"}:
                i += 1
            labels += 1
            if not (i < len(text) and text[i] == "."):
                break
            i += 1
        if start < at and labels > 1:
            yield start, at + 1
            last = at + 1
        at = text.find("@", at + 1)


# the permutation


def feistel(left, right, a, b, tweak):
    for i in range(8):
        seen = right if i % 2 == 0 else left
        h = hashlib.blake2b(key=KEY, digest_size=16)
        h.update(f"{tweak}:{a}:{b}:{i}:{seen}".encode())
        move = int(h.hexdigest(), 16)
        left, right = ((left + move) % a, right) if i % 2 == 0 else (left, (right + move) % b)
    return left * b + right


def walked(value, n, tweak, same=lambda v: True):
    a = 1
    while a * a < n:
        a += max(1, (int(n**0.5) - a) // 2)
    while (a - 1) * (a - 1) >= n:
        a -= 1
    a = max(a, 2)
    b = max(2, (n + a - 1) // a)
    while True:
        value = feistel(value // b, value % b, a, b, tweak)
        if value < n and same(value):
            return value


def put(text, digits):
    digits = list(digits)
    return "".join(digits.pop(0) if c in DIGIT else c for c in text)


def leap(y):
    return y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)


DAYS = [(y, m, d) for y in range(1900, 2100) for m in range(1, 13) for d in range(1, [31, 29 if leap(y) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m - 1] + 1)]
NUMBER_OF = {d: i for i, d in enumerate(DAYS)}


def check_digit(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += sum(int(x) for x in str(int(c) * 2)) if i % 2 == 0 else int(c)
    return str((10 - total % 10) % 10)


def card(t):
    d = "".join(c for c in t if c in DIGIT)
    if len(set(d)) == 1 or check_digit(d[:-1]) != d[-1]:
        return None
    n = len(d) - 2
    new = d[0] + str(walked(int(d[1:-1]), 10**n, f"card:{n}")).zfill(n)
    return put(t, new + check_digit(new))


def phone(t):
    d = "".join(c for c in t if c in DIGIT)
    code, number = d[:-10], int(d[-10:])
    least = 2_000_000_000 if code in ("", "1") else 0
    equal = {int(str(k) * 10) for k in range(10)}
    if number < least or number in equal:
        return None
    new = least + walked(number - least, 10**10 - least, f"phone:{least}", lambda v: v + least not in equal)
    return put(t, code + str(new).zfill(10))


def ssn(t):
    areas = [k for k in range(1, 900) if k != 666]
    a, g, s = (int(x) for x in t.split("-"))
    if a not in areas or g == 0 or s == 0:
        return None
    v = feistel(areas.index(a) * 99 + g - 1, s - 1, 898 * 99, 9999, "ssn")
    return f"{areas[v // 9999 // 99]:03d}-{v // 9999 % 99 + 1:02d}-{v % 9999 + 1:04d}"


def ip(t):
    parts = t.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    of_size = {1: range(10), 2: range(10, 100), 3: range(100, 256)}
    values = [of_size[len(p)] for p in parts]
    n = [len(v) for v in values]
    at = [v.index(int(p)) for v, p in zip(values, parts, strict=True)]
    v = feistel(at[0] * n[1] + at[1], at[2] * n[3] + at[3], n[0] * n[1], n[2] * n[3], f"ip:{n}")
    left, right = divmod(v, n[2] * n[3])
    return ".".join(str(values[k][j]) for k, j in enumerate((left // n[1], left % n[1], right // n[3], right % n[3])))


def date(t):
    mark = next(c for c in t if c not in DIGIT)
    f = [int(x) for x in t.split(mark)]
    order = "ymd" if t[4] == mark else "mdy" if mark == "/" and f[1] > 12 else "dmy"
    day = tuple(f[order.index(k)] for k in "ymd")
    if day not in NUMBER_OF:
        return None
    new = DAYS[walked(NUMBER_OF[day], len(DAYS), "date", lambda v: (DAYS[v][2] > 12) == (day[2] > 12))]
    return mark.join(str(new["ymd".index(k)]).zfill(4 if k == "y" else 2) for k in order)


def mail(t):
    letters, digits = [c.lower() for c in t if c in LETTER], [c for c in t if c in DIGIT]
    shape = "".join("a" if c in LETTER else "0" if c in DIGIT else c for c in t)
    was = "".join(letters)
    if digits:
        n = len(digits)
        digits = list(str(walked(int("".join(digits)), 10**n, f"mail:{shape}:{was}:{n}")).zfill(n))
    if letters:
        v = 0
        for c in letters:
            v = 26 * v + ord(c) - ord("a")
        v, out = walked(v, 26 ** len(letters), f"mail:{shape}:{len(letters)}"), []
        for _ in letters:
            out.insert(0, chr(ord("a") + v % 26))
            v //= 26
        letters = out
    return "".join((letters.pop(0).upper() if c.isupper() else letters.pop(0)) if c in LETTER else digits.pop(0) if c in DIGIT else c for c in t)


RULES = {"card": card, "phone": phone, "ssn": ssn, "ip": ip, "date": date}


def plain(text):
    out, counts, last = [], dict.fromkeys(pseudonyms.KINDS, 0), 0
    for a, b in [*mails(text), (len(text), len(text))]:
        part, at = text[last:a], 0
        for kind, x, y in numbers(part):
            new = RULES[kind](part[x:y])
            out += [part[at:x], part[x:y] if new is None else new]
            counts[kind] += new is not None
            at = y
        out.append(part[at:])
        if a < b:
            out.append(mail(text[a:b]))
            counts["email"] += 1
        last = b
    return "".join(out), counts


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")
def test_against_a_plain_version(spark):
    docs = spark.read.parquet(DATA).select("doc_id", "text", *(F.lit("x").alias(k) for k in ("n_card", "kind")))
    texts = {r.doc_id: r.text for r in docs.collect()}
    total = dict.fromkeys(pseudonyms.KINDS, 0)
    for r in pseudonyms.pseudonymise(docs, KEY, counts=True).collect():
        text, counts = plain(texts[r.doc_id] or "")
        assert (r.text or "", {k: r[f"n_{k}"] for k in pseudonyms.KINDS}) == (text, counts), texts[r.doc_id]
        total = {k: v + counts[k] for k, v in total.items()}
    assert sum(total.values()) > 50 and len([v for v in total.values() if v]) >= 3, total


def test_made_up_values():
    cases = ["call +1 (415) 555-2671 or 415-555-2671, 415.555.2671; (415) 555-2671.", "4111 1111 1111 1111, 4111111111111112 and 5500-0000-0000-0004", "on 29/02/2024, 2023-02-29, 12/25/2023, 1999.12.31 and 31.12.2150", "123-45-6789 666-12-1234 900-12-1234", "10.0.0.1 256.1.1.1 192.168.001.1 8.8.8.8.8", "Ann.B+x9@mail.example.com a@b c@d.e ..@x.y", "2024-12-31-5 1-2024-12-31 v1.2.3.4 0000000000 +49 222 222 2222"]
    found = dict.fromkeys(pseudonyms.KINDS, 0)
    for text in cases:
        assert pseudonyms.pseudonymise_text(text, KEY) == plain(text)
        found = {k: v + plain(text)[1][k] for k, v in found.items()}
    assert all(found.values()), found
