"""Format-preserving pseudonyms of personal data (operator 6).

Card numbers (Luhn), telephone and social security numbers, IPv4 addresses, dates and the names in mail addresses are found, validated, and
replaced by a keyed Feistel permutation of the values of the same format. Equal values get equal pseudonyms in every
document, a day the same one however it is written, different values different ones; texts keep their length, and the key's holder can invert it.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, utf8

KINDS = ("card", "phone", "ssn", "ip", "date", "email")
ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")
_NUMBER = re.compile(
    r"(?<![A-Za-z0-9])(?<!\d[.-])(?:"
    r"(?P<phone>\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}([ .-])\d{3}\2\d{4})"
    r"|(?P<ip>\d{1,3}(?:\.\d{1,3}){3})"
    r"|(?P<date>\d{4}([-/.])\d{2}\5\d{2}|\d{2}([-/.])\d{2}\6\d{4})"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})"
    r"|(?P<card>\d(?:[ -]?\d){12,18})"
    r")(?![A-Za-z0-9])(?![.-]\d)",
    re.ASCII,
)


def permute(value: int, a: int, b: int, key: bytes, tweak: str, inverse: bool = False) -> int:
    """A keyed permutation of 0 .. a*b-1: Feistel rounds on the two digits of value in base (a, b)."""
    left, right = divmod(value, b)

    def f(i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}:{a}:{b}:{i}:{x}".encode(), key=key, digest_size=16).digest(), "big")

    for i in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
        if i % 2:
            right = (right - f(i, left)) % b if inverse else (right + f(i, left)) % b
        else:
            left = (left - f(i, right)) % a if inverse else (left + f(i, right)) % a
    return left * b + right


def permute_below(value: int, n: int, key: bytes, tweak: str, inverse: bool = False, same=lambda _: True) -> int:
    """The same of 0 .. n-1, or of those for which same() holds, value among them: cycle walking in a domain of two nearly equal digits, neither under 2 values."""
    a = max(2, math.isqrt(n - 1) + 1)
    b = max(2, -(-n // a))
    while True:
        value = permute(value, a, b, key, tweak, inverse)
        if value < n and same(value):
            return value


def _digits(text: str, key: bytes, tweak: str, inverse: bool, radix: int = 10, zero: int = 48) -> str:
    """The same for a string of digits (or of letters, with radix 26)."""
    n = len(text)
    value = 0
    for c in text:
        value = value * radix + ord(c) - zero
    value = permute_below(value, radix**n, key, f"{tweak}:{n}", inverse)
    out = []
    for _ in range(n):
        value, c = divmod(value, radix)
        out.append(chr(c + zero))
    return "".join(reversed(out))


def luhn_digit(payload: str) -> str:
    """The check digit that makes payload + digit valid."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(payload)))
    return str(-total % 10)


def _refill(text: str, digits: str) -> str:
    """Put new digits where text has digits."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in text)


def _card(text: str, key: bytes, inverse: bool) -> str | None:
    plain = re.sub(r"\D", "", text)
    if luhn_digit(plain[:-1]) != plain[-1] or len(set(plain)) == 1:
        return None
    payload = plain[0] + _digits(plain[1:-1], key, "card", inverse)
    return _refill(text, payload + luhn_digit(payload))


def _phone(text: str, key: bytes, inverse: bool) -> str | None:
    """Ten digits behind a country code. North American ones (code 1 or none) have an area code from 2 to 9; ten equal digits are no number."""
    plain = re.sub(r"\D", "", text)
    code, number = plain[:-10], plain[-10:]
    least = 2 * 10**9 if code in ("", "1") else 0
    value, n = int(number) - least, 10**10 - least
    equal = lambda v: len(set(f"{v + least:010d}")) == 1
    if value < 0 or equal(value):
        return None
    value = permute_below(value, n, key, f"phone:{least}", inverse, lambda v: not equal(v))
    return _refill(text, f"{code}{value + least:010d}")


def _ssn(text: str, key: bytes, inverse: bool) -> str | None:
    if text[:3] in ("000", "666") or text[0] == "9" or text[4:6] == "00" or text[7:] == "0000":
        return None
    area, group, serial = int(text[:3]) - 1, int(text[4:6]) - 1, int(text[7:]) - 1
    area -= area >= 666  # 1 to 899 but 666
    value = permute((area * 99 + group) * 9999 + serial, 898 * 99, 9999, key, "ssn", inverse)
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    area += 1
    area += area >= 666
    return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(text: str, key: bytes, inverse: bool) -> str | None:
    parts = text.split(".")
    if any(str(int(p)) != p or int(p) > 255 for p in parts):
        return None
    low = [(0, 10, 100)[len(p) - 1] for p in parts]
    many = [(10, 90, 156)[len(p) - 1] for p in parts]  # values with so many digits
    n = [int(p) - x for p, x in zip(parts, low, strict=True)]
    value = ((n[0] * many[1] + n[1]) * many[2] + n[2]) * many[3] + n[3]
    value = permute(value, many[0] * many[1], many[2] * many[3], key, f"ip:{many}", inverse)
    out = []
    for x, size in zip(reversed(low), reversed(many), strict=True):
        value, d = divmod(value, size)
        out.append(str(d + x))
    return ".".join(reversed(out))


def _date(text: str, key: bytes, inverse: bool) -> str | None:
    mark = text[4] if text[4] in "-/." else text[2]
    fields = text.split(mark)
    year_first = len(fields[0]) == 4
    year, month, day = (int(x) for x in (fields if year_first else reversed(fields)))
    american = not year_first and mark == "/" and month > 12  # month/day/year where day/month/year can't be
    if american:
        month, day = day, month
    try:
        value = datetime.date(year, month, day).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= value <= LAST_DAY:
        return None
    # one permutation for all formats; days after the 12th stay so, so that month/day/year can still be told
    late = lambda v: datetime.date.fromordinal(FIRST_DAY + v).day > 12
    was_late = day > 12
    value = permute_below(value - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date", inverse, lambda v: late(v) == was_late)
    d = datetime.date.fromordinal(FIRST_DAY + value)
    out = (f"{d.year:04d}", f"{d.month:02d}", f"{d.day:02d}")
    return mark.join(out if year_first else (out[1], out[2], out[0]) if american else (out[2], out[1], out[0]))


def _email(text: str, key: bytes, inverse: bool) -> str:
    """Letters stay letters of their case, digits digits; text ends with the @."""
    letters = "".join(c for c in text.lower() if c.isalpha())
    digits = "".join(c for c in text if c.isdigit())
    shape = re.sub(r"[A-Za-z]", "a", re.sub(r"\d", "0", text))
    # the digits are permuted under the original letters, which the inverse has first
    if inverse:
        plain = _digits(letters, key, f"mail:{shape}", True, 26, 97) if letters else ""
        numbers = _digits(digits, key, f"mail:{shape}:{plain}", True) if digits else ""
        letters = plain
    else:
        numbers = _digits(digits, key, f"mail:{shape}:{letters}", False) if digits else ""
        letters = _digits(letters, key, f"mail:{shape}", False, 26, 97) if letters else ""
    a, d = iter(letters), iter(numbers)
    return "".join((next(a).upper() if c.isupper() else next(a)) if c.isalpha() else next(d) if c.isdigit() else c for c in text)


_RULES = {"card": _card, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date}


def pseudonymise_text(text: str, key: bytes, inverse: bool = False) -> tuple[str, dict[str, int]]:
    """The text with its validated values replaced, and how many of each kind."""
    found = dict.fromkeys(KINDS, 0)

    def number(m: re.Match) -> str:
        kind = m.lastgroup or next(k for k in _RULES if m.group(k))
        new = _RULES[kind](m.group(), key, inverse)
        if new is None:
            return m.group()
        found[kind] += 1
        return new

    def mail(m: re.Match) -> str:
        found["email"] += 1
        return _email(m.group(), key, inverse)

    # numbers first, but not those inside a mail address, whose name is permuted as a whole
    out, at = [], 0
    if "@" in text:
        for m in _MAIL.finditer(text):
            out += [_NUMBER.sub(number, text[at : m.start()]), mail(m)]
            at = m.end()
    out.append(_NUMBER.sub(number, text[at:]))
    return "".join(out), found


def pseudonymise(docs: DataFrame, key: bytes, inverse: bool = False, counts: bool = False) -> DataFrame:
    """docs with the text replaced, all other columns as they were; with counts, only doc_id, text and n_<kind> columns.

    One pass without a shuffle. Null texts stay null, empty ones empty. Values that fail their check (Luhn, calendar, octets) stay.
    Repeated rows are treated alike, and so are equal values anywhere. A mail address is one value, whatever numbers it holds; else the first from the
    left counts where values overlap. A very long text is a batch of its own. A null doc_id is passed on. An empty table gives an empty result.
    """
    if counts:
        docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"n_{k} long" for k in KINDS)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index("text")
        column = batch.column(at)
        buf, offsets = utf8(column)
        telling = ((buf >= 48) & (buf < 58)) | (buf == 64)  # no digit and no @: nothing to do
        rows = np.unique(np.searchsorted(offsets, np.flatnonzero(telling), "right") - 1)
        texts = column.to_pylist()
        totals = np.zeros((len(KINDS), batch.num_rows), np.int64)
        for i in rows.tolist():
            texts[i], found = pseudonymise_text(texts[i], key, inverse)
            totals[:, i] = [found[k] for k in KINDS]
        out = batch.set_column(at, batch.schema.field(at), pa.array(texts, column.type))
        if counts:
            for k, total in zip(KINDS, totals, strict=True):
                out = out.append_column(f"n_{k}", pa.array(total))
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs, work, f"doc_id {kind}, text string, {schema}" if counts else docs.schema)
