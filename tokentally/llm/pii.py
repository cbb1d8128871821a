"""Operator 9: format-preserving pseudonyms for personal data.

Kinds: secrets after a key word, mail addresses, access keys, IBANs, phone numbers (with a
country code, or ten digits in groups), dates, IPv4 and IPv6 addresses, social security numbers and cards.

A value that its kind's validation accepts is read as a number in the set of
all valid values of its own format, permuted in that set by a keyed Feistel
network with cycle walking, and written back in the same format (separators, digit
counts and letter cases stay).  So equal values get equal pseudonyms in all
documents, different values stay different, a check digit or calendar date stays
valid, and whoever has the key can undo it.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import ipaddress
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentally.llm.shared import prepare

ROUNDS = 10
# Calling codes of one and two digits; all others have three.
_CODES_1 = frozenset("1 7".split())
_CODES_2 = frozenset("20 27 28 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 83 84 86 89 90 91 92 93 94 95 98".split())
_DIGITS, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


class Feistel:
    """Keyed permutations of range(n) for any n; ``tweak`` tells formats apart."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, i: int, x: int, n: int, tweak: str) -> int:
        text = f"{tweak}|{n}|{i}|{x}".encode()
        return int.from_bytes(hashlib.blake2b(text, key=self.key, digest_size=24 + n.bit_length() // 8).digest(), "little")

    def _once(self, x: int, n: int, a: int, b: int, tweak: str, back: bool) -> int:
        left, right = x % a, x // a
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2 == 0:
                left = (left + sign * self._round(i, right, n, tweak)) % a
            else:
                right = (right + sign * self._round(i, left, n, tweak)) % b
        return left + right * a

    def permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        """The image of x < n (or what has the image x, going back); values outside range(n) are walked through."""
        if n <= 1:
            return x
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        x = self._once(x, n, a, b, tweak, back)
        while x >= n:
            x = self._once(x, n, a, b, tweak, back)
        return x


def luhn_digit(body: str) -> str:
    """The check digit that makes ``body`` and it valid."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_check(country: str, bban: str) -> str:
    number = int("".join(str(int(c, 36)) for c in bban + country + "00"))
    return f"{98 - number % 97:02d}"


def _mixed(values: list[int], sizes: list[int], f: Feistel, tweak: str, back: bool) -> list[int]:
    """Permute a tuple of digits with these radices."""
    x = 0
    for v, s in zip(values, sizes, strict=True):
        x = x * s + v
    x = f.permute(x, math.prod(sizes), tweak, back)
    out = []
    for s in reversed(sizes):
        x, v = divmod(x, s)
        out.append(v)
    return out[::-1]


def _alphabets(value: str, extra: dict[str, str] | None = None) -> list[str]:
    return [next((a for a in (_DIGITS, _LOWER, _UPPER) if c in a), c) if not extra else extra.get(c, c) for c in value]


def _by_alphabet(value: str, alphabets: list[str], f: Feistel, kind: str, back: bool) -> str:
    """Permute the characters within their alphabets; one of a single character stays."""
    at = [i for i, a in enumerate(alphabets) if len(a) > 1]
    new = _mixed([alphabets[i].index(value[i]) for i in at], [len(alphabets[i]) for i in at], f, kind + "".join("c" if len(a) == 1 else str(len(a)) for a in alphabets), back)
    out = list(value)
    for i, v in zip(at, new, strict=True):
        out[i] = alphabets[i][v]
    return "".join(out)


def _put(form: str, plain: str) -> str:
    """``plain``'s characters in the places that ``form`` has letters and digits in."""
    it = iter(plain)
    return "".join(next(it) if c.isalnum() else c for c in form)


def card(text: str, f: Feistel, back: bool) -> str | None:
    """13 to 19 digits with a valid Luhn digit; the last digit is computed anew."""
    d = re.sub(r"\D", "", text)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1]:
        return None
    body = _by_alphabet(d[:-1], [_DIGITS] * (len(d) - 1), f, "card", back)
    return _put(text, body + luhn_digit(body))


def iban(text: str, f: Feistel, back: bool) -> str | None:
    """A valid mod-97 check; the country stays, the check digits are computed anew."""
    d = text.replace(" ", "")
    if not 15 <= len(d) <= 34 or iban_check(d[:2], d[4:]) != d[2:4]:
        return None
    body = _by_alphabet(d[4:], _alphabets(d[4:]), f, "iban" + d[:2], back)
    return _put(text, d[:2] + iban_check(d[:2], body) + body)


def calling_code(digits: str) -> str:
    """The country's code, which the digits after the + begin with, however they are grouped."""
    return digits[:1] if digits[:1] in _CODES_1 else digits[:2] if digits[:2] in _CODES_2 else digits[:3]


def phone(text: str, f: Feistel, back: bool) -> str | None:
    """The country code stays; of the 7 to 12 further digits all are permuted as one number, so separators and grouping don't matter.

    For +1 they are ten, and the first digit of area and exchange stays in its set,
    0 and 1 or 2 to 9.
    """
    digits = re.sub(r"\D", "", text)
    code = calling_code(digits)
    d = digits[len(code) :]
    if code == "1":
        new = _ten_digits(d, f, back)
    else:
        new = _by_alphabet(d, [_DIGITS] * len(d), f, "phone" + code, back) if 7 <= len(d) <= 12 else None
    return None if new is None else _put(text, code + new)


def _ten_digits(d: str, f: Feistel, back: bool) -> str | None:
    sets = [_DIGITS if i not in (0, 3) else "01" if c < "2" else "23456789" for i, c in enumerate(d)]
    return _by_alphabet(d, sets, f, "phone1", back) if len(d) == 10 else None


def national_phone(text: str, f: Feistel, back: bool) -> str | None:
    """Ten digits without a code, as (988) 555-2485 or 988-555-2485: linked with the same number after +1."""
    return _put(text, _ten_digits(re.sub(r"\D", "", text), f, back))


def ip(text: str, f: Feistel, back: bool) -> str | None:
    """Four octets, each of which keeps its number of digits."""
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    low = [(0, 10, 100)[len(p) - 1] for p in parts]
    sizes = [(10, 90, 156)[len(p) - 1] for p in parts]
    new = _mixed([int(p) - a for p, a in zip(parts, low, strict=True)], sizes, f, "ip" + "".join(str(len(p)) for p in parts), back)
    return ".".join(str(v + a) for v, a in zip(new, low, strict=True))


def ip6(text: str, f: Feistel, back: bool) -> str | None:
    """Eight groups; zero ones stay, each other one keeps its number of digits, so all ways to write an address are linked.

    Addresses of decimal digits alone are permuted among themselves, so that the
    letters' case can be told from the pseudonym.
    """
    try:
        packed = ipaddress.IPv6Address(text).packed
    except ValueError:
        return None
    groups = [f"{int.from_bytes(packed[i : i + 2], 'big'):x}" for i in range(0, 16, 2)]
    if len([g for g in text.split(":") if g]) < 2 or not re.search("[0-9]", text):
        return None
    some = [g for g in groups if g != "0"]
    base = 10 if "".join(groups).isdecimal() else 16
    low = [base ** (len(g) - 1) for g in some]
    values, tweak = [int(g, base) - a for g, a in zip(some, low, strict=True)], f"ip6 {base} " + "".join(str(len(g)) if g != "0" else "0" for g in groups)
    while True:
        values = _mixed(values, [(base - 1) * a for a in low], f, tweak, back)
        new = [f"{v + a:{'x' if base == 16 else 'd'}}" for v, a in zip(values, low, strict=True)]
        if base == 10 or not "".join(new).isdecimal():
            break
    left, upper = iter(new), any(c.isupper() for c in text)
    out = ":".join(next(left).rjust(len(g), "0") if g.strip("0") else g for g in text.split(":"))
    return out.upper() if upper else out


def ssn(text: str, f: Feistel, back: bool) -> str | None:
    area, group, serial = (int(x) for x in text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    a, g, s = _mixed([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], f, "ssn", back)
    return f"{a + 1 + (a + 1 >= 666):03d}-{g + 1:02d}-{s + 1:04d}"


@functools.lru_cache(maxsize=32)
def _century(start: int) -> dict[tuple[bool, int], list[datetime.date]]:
    """The dates of 100 years by class: whether the month has one digit, and whether the day has one, is up to 12, or beyond."""
    out: dict[tuple[bool, int], list[datetime.date]] = {}
    day, last = datetime.date(max(1, start), 1, 1).toordinal(), datetime.date(start + 99, 12, 31).toordinal()
    for n in range(day, last + 1):
        d = datetime.date.fromordinal(n)
        out.setdefault(_class(d), []).append(d)
    return out


def _class(d: datetime.date) -> tuple[bool, int]:
    return d.month < 10, 0 if d.day < 10 else 1 if d.day <= 12 else 2


def date(text: str, f: Feistel, back: bool) -> str | None:
    """A calendar date (y-m-d, d.m.y, m/d/y or m-d-y, else d/m/y or d-m-y) moves within its century and class; one date has one pseudonym in all orders, padded or not.

    Its class (see _century()) keeps every way to write it as long as it is, and
    what can be read only as d/m/y stays so.  The year has four digits; with a
    month or day of one digit it must be of 1900 to 2099, since numbers with dots
    look alike.
    """
    parts, sep = re.split(r"[-./]", text), re.findall(r"[-./]", text)
    a, b, c = (int(x) for x in parts)
    orders = ["ymd"] if len(parts[0]) == 4 else ["dmy"] if sep[0] == "." else ["mdy", "dmy"]
    for order in orders:
        v = dict(zip(order, (a, b, c), strict=True))
        try:
            day = datetime.date(v["y"], v["m"], v["d"])
        except ValueError:
            continue
        break
    else:
        return None
    if min(map(len, parts)) < 2 and not 1900 <= day.year < 2100:
        return None
    start = day.year // 100 * 100
    kind = _class(day)
    own = _century(start)[kind]
    new = own[f.permute(_place(own, day), len(own), f"date{start}{kind}", back)]
    fields = {"y": new.year, "m": new.month, "d": new.day}
    out = [str(fields[o]).rjust(len(p), "0") for o, p in zip(order, parts, strict=True)]
    return out[0] + sep[0] + out[1] + sep[1] + out[2]


def _place(own: list[datetime.date], day: datetime.date) -> int:
    import bisect

    return bisect.bisect_left(own, day)


def email(text: str, f: Feistel, back: bool) -> str | None:
    """The name's letters and digits; the domain stays."""
    name, domain = text.rsplit("@", 1)
    return _by_alphabet(name, _alphabets(name), f, "email" + domain.lower(), back) + "@" + domain


def access_key(text: str, f: Feistel, back: bool) -> str | None:
    return "AKIA" + _by_alphabet(text[4:], [_UPPER + _DIGITS] * 16, f, "access key", back)


def secret(text: str, f: Feistel, back: bool) -> str | None:
    """The value after password=, token = and their like; hexadecimal ones stay so, in their case.

    What falls into another set of values is walked on, so that it can be undone.
    """
    head, value, tail = re.fullmatch(r"(.*?[=:]\s*[\"']?)([^\s\"']+)([\"']?)", text, re.S).groups()
    hexa = _hexadecimal(value)
    sets = [hexa] * len(value) if hexa else _alphabets(value)
    while True:
        value = _by_alphabet(value, sets, f, "secret", back)
        if _hexadecimal(value) == hexa:
            return head + value + tail


def _hexadecimal(value: str) -> str:
    """The alphabet of a hexadecimal value, digits alone counting as lower-case; else empty."""
    return _HEX if re.fullmatch("[0-9a-f]+", value) else _HEX.upper() if re.fullmatch("[0-9A-F]+", value) else ""


KINDS: dict[str, tuple[str, Callable[[str, Feistel, bool], str | None]]] = {
    "secret": (r"(?<![A-Za-z0-9])(?i:password|passwd|token|secret|api[-_]?key)[-_]*[\"']?\s*[=:]\s*(?:\"[^\s\"']{6,}\"|'[^\s\"']{6,}'|[^\s\"',;]{6,})", secret),
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", email),
    "access_key": (r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])", access_key),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", iban),
    "phone": (r"(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}(?![.-]?[0-9])", phone),
    "national": (r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])(?![.-][0-9])", national_phone),
    "date": (r"(?<![0-9./-])(?:[0-9]{4}([-./])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./])[0-9]{1,2}\2[0-9]{4})(?![0-9])(?![./-][0-9])", date),
    "ip6": (r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])(?!\.[0-9])", ip6),
    "ip": (r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])", ip),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", ssn),
    "card": (r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])", card),
}


def _pattern() -> re.Pattern:
    """All kinds as one pattern of named groups; the date's own group numbers become names."""
    parts = []
    for name, (p, _) in KINDS.items():
        if name == "date":
            p = p.replace("([-./])", "(?P<s1>[-./])", 1).replace("\\1", "(?P=s1)").replace("([-./])", "(?P<s2>[-./])").replace("\\2", "(?P=s2)")
        parts.append(f"(?P<{name}>{p})")
    return re.compile("|".join(parts))


_ANY = _pattern()
_SOME = re.compile("[0-9@=:]")


def pseudonymise_text(text: str, f: Feistel, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with every valid value replaced, and how many of each kind there were.

    What a kind's validation refuses stays, and is searched on from its second character.
    """
    counts: dict[str, int] = {}
    if not text or not _SOME.search(text):
        return text, counts
    out, at, since = [], 0, 0
    while m := _ANY.search(text, at):
        kind = m.lastgroup if m.lastgroup in KINDS else "date"
        value = m.group()
        new = KINDS[kind][1](value, f, back)
        while new is None and kind in ("iban", "phone") and " " in value:  # a following word or number may have been taken along
            value = value.rpartition(" ")[0]
            new = KINDS[kind][1](value, f, back)
        if new is None:
            at = m.start() + 1
            continue
        out += [text[since : m.start()], new]
        at = since = m.start() + len(value)
        counts[kind] = counts.get(kind, 0) + 1
    return "".join([*out, text[since:]]), counts


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False, counted: str | None = None) -> DataFrame:
    """``docs``, all columns, with pseudonyms in ``text``; ``counted`` names a column for the number of replaced values.

    Null texts stay null (and count 0), empty ones empty; rows are independent of
    each other, so repeated rows give repeated results.
    """
    prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for batch in batches:
            done = [(None, {}) if t is None else pseudonymise_text(t, f, back) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in done], batch.schema.types[at])
            if counted:
                columns.append(pa.array([sum(c.values()) for _, c in done], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *([counted] if counted else [])])

    fields = [*docs.schema.fields, *([T.StructField(counted, T.LongType())] if counted else [])]
    return docs.mapInArrow(run, T.StructType([T.StructField(x.name, x.dataType, True) for x in fields]))


def pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text, n_replaced.

    A null text stays null, with nothing replaced, an empty one empty; null ids and repeated rows are rows like
    others, and equal values have equal pseudonyms in all of them; texts are read whole; other columns, whatever their names, are
    left out; an empty table gives an empty result.
    """
    return pseudonymise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key, counted="n_replaced")
