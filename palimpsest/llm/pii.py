"""PII: format-preserving pseudonyms by a keyed Feistel permutation.

What is found is validated - check digits, octets, calendar - and mapped by a permutation of all values of its format, so a
pseudonym is valid in the same format, different values stay different, and equal values stay linked across documents,
however they are written.
"""

from __future__ import annotations

import datetime
import hmac
import math
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.shared import map_tables

#: The key of the registered query. Pass your own, and keep it.
QUERY_KEY = b"palimpsest query key"
ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def permute(value: int, size: int, key: bytes, tweak: bytes = b"") -> int:
    """A keyed permutation of 0..size-1: a Feistel network over two halves of mixed radix, walked until it lands inside."""
    if not 0 <= value < size:
        raise ValueError("the value is outside its domain")
    if size < 2:
        return value
    low = math.isqrt(size - 1) + 1
    high = -(-size // low)
    room = (size.bit_length() + 7) // 8 + 8
    while True:
        a, b = divmod(value, low)
        for i in range(ROUNDS):
            mac = hmac.digest(key, b"%d:%d:%d:" % (i, size, b if i % 2 == 0 else a) + tweak, "sha512")
            mask = int.from_bytes(mac[: min(room, 64)], "big")
            if i % 2 == 0:
                a = (a + mask) % high
            else:
                b = (b + mask) % low
        value = a * low + b
        if value < size:
            return value


def _digits(digits: str, key: bytes, tweak: bytes) -> str:
    return str(permute(int(digits), 10 ** len(digits), key, tweak)).zfill(len(digits))


def _refill(shape: str, digits: str) -> str:
    """The digits, written as in ``shape``."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in shape)


def luhn(digits: str) -> int:
    """The check digit that completes the digits."""
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return -total % 10


def card(found: re.Match, key: bytes) -> str | None:
    digits = re.sub("[ -]", "", found[0])
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]):
        return None
    body = _digits(digits[:-1], key, b"card")
    return _refill(found[0], f"{body}{luhn(body)}")


def iban(found: re.Match, key: bytes) -> str | None:
    text = found[0].replace(" ", "")
    if not 15 <= len(text) <= 34 or _mod97(text[4:] + text[:4]) != 1:
        return None
    body = shaped(text[4:], key, b"iban")
    whole = f"{text[:2]}{98 - _mod97(f'{body}{text[:2]}00'):02d}{body}"
    left = iter(whole)
    return "".join(c if c == " " else next(left) for c in found[0])


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def address(found: re.Match, key: bytes) -> str | None:
    parts = [int(x) for x in found[0].split(".")]
    if max(parts) > 255 or any(str(p) != x for p, x in zip(parts, found[0].split("."), strict=True)):
        return None
    return ".".join(map(str, permute(int.from_bytes(bytes(parts), "big"), 2**32, key, b"ip").to_bytes(4, "big")))


def phone(found: re.Match, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", found["number"])
    if not 7 <= len(digits) <= 12:
        return None
    return found["lead"] + _refill(found["number"], _digits(digits, key, b"phone"))


def social(found: re.Match, key: bytes) -> str | None:
    area, group, serial = (int(x) for x in found[0].split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = [x for x in range(1, 900) if x != 666]
    at = permute((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, key, b"ssn")
    at, serial = divmod(at, 9999)
    return f"{areas[at // 99]:03d}-{at % 99 + 1:02d}-{serial + 1:04d}"


def date(found: re.Match, key: bytes) -> str | None:
    """Dates with the year first, or last with the day first, or, if that is no date, the month."""
    sep = re.sub(r"\d", "", found[0])[0]
    a, b, c = found[0].split(sep)
    orders = [("Y", "M", "D")] if len(a) == 4 else [("D", "M", "Y"), ("M", "D", "Y")]
    for order in orders:
        part = dict(zip(order, map(int, (a, b, c)), strict=True))
        try:
            day = datetime.date(part["Y"], part["M"], part["D"]).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        new = datetime.date.fromordinal(FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, b"date"))
        out = {"Y": f"{new.year:04d}", "M": f"{new.month:02d}", "D": f"{new.day:02d}"}
        return sep.join(out[x] for x in order)
    return None


def shaped(text: str, key: bytes, tweak: bytes) -> str:
    """Text with its digits and ASCII letters permuted among all texts of its shape."""
    value, size, sizes = 0, 1, []
    for c in text:
        base, n = ("0", 10) if "0" <= c <= "9" else ("a", 26) if "a" <= c <= "z" else ("A", 26) if "A" <= c <= "Z" else ("", 1)
        sizes.append((c, base, n))
        value, size = value * n + (ord(c) - ord(base) if base else 0), size * n
    value = permute(value, size, key, tweak)
    out = []
    for c, base, n in reversed(sizes):
        value, digit = divmod(value, n)
        out.append(chr(ord(base) + digit) if base else c)
    return "".join(reversed(out))


def email(found: re.Match, key: bytes) -> str | None:
    return f"{shaped(found['user'], key, b'email:' + found['site'].lower().encode())}@{found['site']}"


#: What is looked for, in the order in which it is tried at a place.
KINDS: dict[str, tuple[str, Callable[[re.Match, bytes], str | None]]] = {
    "email": (r"(?P<user>[A-Za-z0-9][A-Za-z0-9._%+-]{0,63})@(?P<site>[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24})", email),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    "card": (r"(?<![\dA-Za-z.])\d(?:[ -]?\d){12,18}(?![\dA-Za-z])", card),
    "ssn": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", social),
    "date": (r"(?<![\d./-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?![\d/-])", date),
    "ip": (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", address),
    "phone": (r"(?<![\dA-Za-z])(?P<lead>\+\d{1,3}[ .-]?)(?P<number>\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4})(?!\d)", phone),
    "phone_local": (r"(?<![\d+A-Za-z])(?P<lead>)(?P<number>\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?![\d-])", phone),
}
_RULES = [(kind, re.compile(pattern, re.A), change) for kind, (pattern, change) in KINDS.items()]
_MAYBE = re.compile(r"[0-9@]")


def pseudonymise(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind. Earlier kinds win where finds overlap."""
    counts: dict[str, int] = {}
    if not _MAYBE.search(text):
        return text, counts
    taken: list[tuple[int, int, str]] = []
    for kind, rule, change in _RULES:
        for found in rule.finditer(text):
            if any(found.start() < stop and start < found.end() for start, stop, _ in taken):
                continue
            new = _cached(kind, key, found[0]) if kind != "email" else change(found, key)
            if new is not None:
                taken.append((found.start(), found.end(), new))
                counts[kind] = counts.get(kind, 0) + 1
    out, at = [], 0
    for start, stop, new in sorted(taken):
        out += [text[at:start], new]
        at = stop
    return "".join([*out, text[at:]]), counts


@lru_cache(maxsize=50_000)
def _cached(kind: str, key: bytes, found: str) -> str | None:
    """A rule looks at the found text alone, but for what stands around it, which has been looked at."""
    rule, change = next((r, c) for k, r, c in _RULES if k == kind)
    match = rule.fullmatch(found)
    return None if match is None else change(match, key)


def replace(docs: DataFrame, key: bytes) -> DataFrame:
    """``doc_id, text, n_email, n_iban, n_card, n_ssn, n_date, n_ip, n_phone``: texts with pseudonyms.

    Numbers that fail their check and dates that aren't in the calendar stay. A null text stays null; null ids and
    repeated rows stay; texts of any length are read whole; other columns are ignored; an empty table gives no rows.
    """
    kinds = ["email", "iban", "card", "ssn", "date", "ip", "phone"]

    def run(rows: pa.Table) -> pa.Table:
        texts, found = [], []
        for text in rows["text"].to_pylist():
            new, counts = (None, {}) if text is None else pseudonymise(text, key)
            texts.append(new)
            found.append(counts | {"phone": counts.get("phone", 0) + counts.get("phone_local", 0)})
        columns = {"doc_id": rows["doc_id"], "text": pa.array(texts, pa.string())}
        return pa.table(columns | {f"n_{k}": pa.array([c.get(k, 0) for c in found], pa.int64()) for k in kinds})

    schema = "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in kinds)
    return map_tables(docs.selectExpr("CAST(doc_id AS long) AS doc_id", "CAST(text AS string) AS text"), run, schema)


def op6(spark, sf_dir: str) -> DataFrame:
    return replace(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), QUERY_KEY)
