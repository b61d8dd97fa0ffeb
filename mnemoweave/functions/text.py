"""Text and key functions as columns; an Arrow UDF only where Spark has no form."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def chunk_text(text: str, size: int) -> list[str]:
    """The chunks of one text, in time linear in it: from each chunk's start its
    end is looked up among the running lengths."""
    parts = text.split()
    if not parts:
        return []
    upto = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    out, at, before = [], 0, 0
    while at < len(parts):
        end = int(np.searchsorted(upto, before + size)) + 1
        out.append(" ".join(parts[at:end]))
        at, before = end, int(upto[min(end, len(parts)) - 1])
    return out


def chunks(text, size: int):
    """Greedy chunks: a word is added, and the chunk closed once its words with a
    blank each reach ``size``; the rest is the last chunk.  Null and blank texts have none."""

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [] if x is None else chunk_text(x, size))

    return cut(text)


@F.pandas_udf(StringType())
def normalize_unicode(s: pd.Series) -> pd.Series:
    """NFKC, controls to blanks, white space collapsed, case folded."""
    def one(x):
        if x is None:
            return None
        x = unicodedata.normalize("NFKC", x)
        x = "".join(" " if ord(c) < 32 or ord(c) == 127 else c for c in x)
        return " ".join(x.split()).casefold()

    return s.map(one)


def normalize_text(text):
    """The native path for ASCII texts; others go through the Arrow UDF."""
    plain = F.lower(F.trim(F.regexp_replace(text, r"[\x00-\x20\x7f]+", " ")))
    return F.when(text.rlike(r"^[\x00-\x7f]*$"), plain).otherwise(normalize_unicode(text))


def normalize_ascii(text):
    return F.lower(F.trim(F.regexp_replace(text, r"[\x00-\x20\x7f]+", " ")))


def canonical_scope(scope, normalize=normalize_ascii):
    out = F.replace(normalize(F.coalesce(scope, F.lit(""))), F.lit(":"), F.lit("_"))
    return F.when(out == "", "global").otherwise(out)


def build_key(scope, key):
    return F.concat(canonical_scope(scope), F.lit(":"), key)


def split_key(key):
    """(scope, rest): cut at the first colon; without one the scope is global."""
    at = F.locate(":", key)
    return (
        F.when(at > 0, F.substring(key, F.lit(1), at - 1)).otherwise(F.lit("global")),
        F.when(at > 0, F.substring(key, at + 1, F.length(key))).otherwise(key),
    )


def key_prefix(key):
    """What stands before the first dot, then slash, then underscore."""
    out = F.split_part(key, F.lit("."), F.lit(1))
    out = F.split_part(out, F.lit("/"), F.lit(1))
    return F.split_part(out, F.lit("_"), F.lit(1))


def is_phrase(text):
    return F.length(text).between(2, 64) & text.rlike(r"\p{L}")


def supports_substring(term):
    return F.length(term) >= 4


def clamp01(x):
    return F.when(F.isnan(x) | x.isNull(), F.lit(None)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def trust(x):
    return F.greatest(F.lit(0.05), clamp01(x))


def strength(x):
    return F.greatest(F.lit(0.01), clamp01(x))


def sigmoid(x):
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def query_text(x):
    return F.concat(F.lit("query: "), x)


def passage_text(x):
    return F.concat(F.lit("passage: "), x)


def dedup_entities(entities):
    """Entities (array<struct<text,label,...>>) trimmed, of two letters or more,
    the first of each (lower-cased text, label)."""
    trimmed = F.transform(entities, lambda e: e.withField("text", F.trim(e["text"])))
    kept = F.filter(trimmed, lambda e: F.length(e["text"]) >= 2)
    keys = F.transform(kept, lambda e: F.concat(F.lower(e["text"]), F.lit("\x00"), e["label"]))
    return F.filter(kept, lambda e, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1)


def as_int(x):
    """An integer, or null for what is none."""
    return x.try_cast("bigint")
