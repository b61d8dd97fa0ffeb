"""Format-preserving pseudonyms for personal data (operator 7).

Card numbers, phone numbers, national ids, bank account numbers, IP addresses,
dates, mail names and access tokens are recognised by pattern *and* validated
(check digits, calendar, ranges); the value is then permuted within its own
format by a keyed Feistel network with cycle walking, so equal values get equal
pseudonyms in all documents, and a pseudonym is again a valid value.

Cases: a null text stays null with 0 found; an empty text is unchanged; numbers
that fail validation are left alone; where two patterns begin at one place the one
listed first wins; repeated rows give equal results; texts are scanned whole,
however long; extra columns are carried along, one named like an added column
is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
import warnings
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import plain, table

#: The session setting that holds the secret key, and the public one of tests.
KEY_SETTING = "spark.mnemoweave.pii.key"
KEY = b"mnemoweave pseudonyms, replace in production"
ROUNDS = 8
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


# ---- keyed permutations -------------------------------------------------------

def permute(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(n): Feistel on two base-s digits, s = ceil(sqrt n),
    walked until the value is back in range."""
    if n < 2:
        return x
    s = math.isqrt(n - 1) + 1
    while True:
        left, right = divmod(x, s)
        for i in range(ROUNDS):
            h = hashlib.blake2b(b"%d:%d:%d" % (i, n, right) + tweak.encode(), key=key[:64], digest_size=16)
            left, right = right, (left + int.from_bytes(h.digest(), "big")) % s
        x = left * s + right
        if x < n:
            return x


def _number(digits: str, key: bytes, tweak: str) -> str:
    return str(permute(int(digits), 10 ** len(digits), key, f"{tweak}{len(digits)}")).zfill(len(digits)) if digits else digits


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), shape)


# ---- validated kinds: value -> pseudonym, or None if it does not validate ------

def luhn_digit(body: str) -> str:
    total = 0
    for i, ch in enumerate(reversed(body)):
        x = int(ch) * (2 if i % 2 == 0 else 1)
        total += x - 9 * (x > 9)
    return str(-total % 10)


def card(value: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", value)
    if not 13 <= len(digits) <= 19 or len(set(digits)) == 1 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = _number(digits[:-1], key, "card")
    return _refill(value, body + luhn_digit(body))


def phone(value: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", value)
    if not 8 <= len(digits) <= 15:
        return None
    keep = len(re.match(r"\+?(\d{0,3})", value)[1]) if value.startswith("+") else 0
    return _refill(value, digits[:keep] + _number(digits[keep:], key, "phone" + digits[:keep]))


def national_id(value: str, key: bytes) -> str | None:
    ok = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    digits = value.replace("-", "")
    if not ok(digits):
        return None
    while True:
        digits = _number(digits, key, "national")
        if ok(digits):
            return _refill(value, digits)


def ipv4(value: str, key: bytes) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    n = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, n.to_bytes(4, "big")))


def iban(value: str, key: bytes) -> str | None:
    flat = value.replace(" ", "")
    check = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97
    if not 15 <= len(flat) <= 34 or check(flat) != 1:
        return None
    digits = re.sub(r"\D", "", flat[4:])
    body = _refill(flat[4:], _number(digits, key, "iban" + flat[:2]))
    new = f"{flat[:2]}{98 - check(f'{flat[:2]}00{body}'):02d}{body}"
    it = iter(new)
    return re.sub(r"[A-Z0-9]", lambda _: next(it), value)


def _date(year: str, month: str, day: str) -> int | None:
    try:
        n = dt.date(int(year), int(month), int(day)).toordinal()
    except ValueError:
        return None
    return n if FIRST_DAY <= n <= LAST_DAY else None


def date(value: str, key: bytes) -> str | None:
    """yyyy-mm-dd (or /), else dd.mm.yyyy, dd/mm/yyyy, or mm/dd/yyyy if only that is valid."""
    sep = re.search(r"\D", value)[0]
    a, b, c = value.split(sep)
    orders = ["ymd"] if len(a) == 4 else ["dmy", "mdy"]
    for order in orders:
        p = dict(zip(order, (a, b, c), strict=True))
        n = _date(p["y"], p["m"], p["d"])
        if n is not None:
            new = dt.date.fromordinal(FIRST_DAY + permute(n - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date"))
            out = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
            return sep.join(out[k] for k in order)
    return None


_CLASSES = (("abcdefghijklmnopqrstuvwxyz", "a"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"), ("0123456789", "0"))
_CLASS = {ch: (alphabet.index(ch), alphabet) for alphabet, _ in _CLASSES for ch in alphabet}


def _by_class(value: str, key: bytes, tweak: str) -> str:
    """Letters become letters of their case and digits digits, as one number."""
    x, n, shape = 0, 1, []
    for ch in value:
        if ch in _CLASS:
            i, alphabet = _CLASS[ch]
            x, n = x * len(alphabet) + i, n * len(alphabet)
        shape.append(_CLASS[ch][1][0] if ch in _CLASS else ch)
    y, out = permute(x, n, key, tweak + "".join(shape)), []
    for ch in reversed(value):
        if ch in _CLASS:
            alphabet = _CLASS[ch][1]
            y, i = divmod(y, len(alphabet))
            ch = alphabet[i]
        out.append(ch)
    return "".join(reversed(out))


def mail(value: str, key: bytes) -> str | None:
    """The name is permuted; the domain stays."""
    name, _, domain = value.rpartition("@")
    return _by_class(name, key, "@" + domain.lower()) + "@" + domain


def access_key(value: str, key: bytes) -> str | None:
    return value[:4] + _by_class(value[4:], key, "access")


def secret(value: str, key: bytes) -> str | None:
    """What is assigned to a password or secret."""
    name, sep, rest = re.fullmatch(r"(\w+)(\W+)(\w+)", value).groups()
    return name + sep + _by_class(rest, key, "secret")


def token(value: str, key: bytes) -> str | None:
    """Hexadecimal access tokens, case kept."""
    new = f"{permute(int(value, 16), 16 ** len(value), key, f'token{len(value)}'):0{len(value)}x}"
    return new.upper() if value.upper() == value and value.lower() != value else new


KINDS = {
    "mail": (r"(?<![\w.%+-])[^\W_][\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", mail),
    "token": (r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])", token),
    "access_key": (r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])", access_key),
    "secret": (r"(?<!\w)(?i:password|passwd|secret|api_key)[ ]?[=:][ ]?[\"']?(?=\w*\d)\w{6,}", secret),
    "iban": (r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", iban),
    "ip": (r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)", ipv4),
    "date": (r"(?<![\w./-])(?:\d{4}([-/])\d\d\1\d\d|\d\d([./-])\d\d\2\d{4})(?![\w/-]|\.\d)", date),
    "national": (r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-])", national_id),
    "card": (r"(?<![0-9A-Za-z])\d(?:[ -]?\d){12,18}(?![0-9A-Za-z])", card),
    "phone": (r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)", phone),
    "phone_local": (r"(?<![\w(+])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])", phone),
}


def _union() -> re.Pattern:
    parts, groups = [], 0
    for name, (pattern, _) in KINDS.items():
        groups += 1
        inner = re.compile(pattern).groups
        # numbered references count from this kind's own group
        pattern = re.sub(r"\\([12])", lambda m: f"\\{int(m[1]) + groups}", pattern)
        parts.append(f"(?P<{name}>{pattern})")
        groups += inner
    return re.compile("|".join(parts))


_FIND = _union()
_HINT = re.compile(r"[\d@]")


def pseudonymise(text: str | None, replace=None) -> tuple[str | None, Counter]:
    """(the text with pseudonyms, number found by kind)."""
    found: Counter = Counter()
    if not text or not _HINT.search(text):
        return text, found
    replace = replace or _replacer(KEY)

    def one(m: re.Match) -> str:
        new = replace(m.lastgroup, m[0])
        if new is None:
            return m[0]
        found[m.lastgroup] += 1
        return new

    return _FIND.sub(one, text), found


@lru_cache(4)
def _replacer(key: bytes):
    return lru_cache(200_000)(lambda kind, value: KINDS[kind][1](value, key))


def pseudonyms(docs: DataFrame, text: str = "text", key: bytes = KEY) -> DataFrame:
    """``docs`` with the text replaced, ``n_pii`` and ``pii_kinds`` added."""
    added = [T.StructField("n_pii", T.LongType()), T.StructField("pii_kinds", T.StringType())]
    src = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text or c not in ("n_pii", "pii_kinds")])
    schema, at = T.StructType([*src.schema.fields, *added]), src.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replace = _replacer(key)
        for b in batches:
            got = [pseudonymise(x, replace) for x in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array([g[0] for g in got], b.schema.field(at).type)
            kinds = [",".join(f"{k}={g[1][k]}" for k in sorted(g[1])) for g in got]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([sum(g[1].values()) for g in got], pa.int64()), pa.array(kinds, pa.string())],
                names=[f.name for f in schema.fields],
            )

    return src.mapInArrow(run, schema)


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names in ``KEY_SETTING``.

    Without it pseudonyms are made under a key that anyone can read, which is
    good for tests alone: a warning says so.
    """
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made under a public key", stacklevel=2)
        return KEY
    return hashlib.blake2b(key.encode(), digest_size=64).digest()


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms(docs, key=session_key(spark)).select("doc_id", "text", "n_pii", "pii_kinds")


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with pseudonyms in its text and, if it has ``n_chars``, its length renewed.

    Cases: a null text stays null and keeps its ``n_chars``; extra columns of any
    name are carried along; repeated rows and ties stay; an empty table gives no rows.
    """
    rows, at = plain(docs)
    out = pseudonyms(rows, at["text"], session_key(spark))
    if "n_chars" in at:
        n = at["n_chars"]
        out = out.withColumn(n, F.coalesce(F.length(at["text"]).cast(out.schema[n].dataType), F.col(n)))
    return out.select(*at.values()).toDF(*at)
