"""Language identification by compression (operator 9).

A text is encoded with one zstandard raw-content dictionary per language; the
language whose dictionary gives the fewest bytes wins.  Narrow margins are
rejected.

Cases: a null text, an empty text and a text without a letter give ``und``,
score 0 and are rejected; with no labelled rows every text is ``und``; ties go
to the language that sorts first; repeated rows are judged alike; long texts
are read whole, chunk by chunk; extra input columns are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import plain, table

UND = "und"
#: Bounds of the training sample: documents for a language, characters of a
#: document, bytes of a dictionary.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 400, 1200, 112_640
CHUNK_BYTES = 4096
LEVEL = 5
#: A text is rejected when its best language saves less than this share of the
#: runner-up's bytes.
MIN_MARGIN = 0.02

_LETTER = re.compile(r"[^\W\d_]")


def training_sample(
    docs: DataFrame, text: str = "text", lang: str = "lang",
    max_docs: int = SAMPLE_DOCS, max_chars: int = SAMPLE_CHARS,
) -> dict[str, bytes]:
    """Raw dictionary content for each language, from a bounded sample.

    At most ``max_docs`` documents a language, chosen by a hash of the text (so
    neither order nor partitioning matters), each cut to ``max_chars``
    characters.  Only this sample reaches the driver; the broadcast counts are
    one row a language.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"),
        F.lower(F.substring(F.col(text), 1, max_chars)).alias("piece"),
        F.xxhash64(F.col(text)).alias("h"),
    )
    # a share of the hash range that holds about four times the sample, by language, keeps
    # what the window reads bounded however many partitions there are
    n = rows.select("lang", "h").distinct().groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("rows"))
    share = F.greatest(F.lit(1.0) - F.lit(4.0 * max_docs) / F.col("rows"), F.lit(0.0))
    place = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = rows.join(F.broadcast(n), F.col("lang") == F.col("l")).where(place >= share)
    # copies are one text here and in the counts, however many there are
    rows = rows.groupBy("lang", "h").agg(F.min("piece").alias("piece"))
    w = Window.partitionBy("lang").orderBy("h", "piece")
    kept = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max_docs)
    found: dict[str, list[tuple[int, str]]] = {}
    for r in kept.collect():
        found.setdefault(r["lang"], []).append((r["n"], r["piece"]))
    out = {}
    for name in sorted(found):
        seen = dict.fromkeys(p for _, p in sorted(found[name]))
        out[name] = "\n".join(seen).encode()[-DICT_BYTES:]
    return out


def _compressors(dicts: dict[str, bytes], level: int):
    import zstandard as zs

    out = []
    for name, data in dicts.items():
        d = zs.ZstdCompressionDict(data, dict_type=zs.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append((name, zs.ZstdCompressor(
            dict_data=d, level=level, write_checksum=False, write_content_size=False, write_dict_id=False
        )))
    return out


def classify(text: str | None, compressors, chunk_bytes: int = CHUNK_BYTES) -> tuple[str, float, float]:
    """(language, score, margin) of one text."""
    if text is None or not compressors or not _LETTER.search(text):
        return UND, 0.0, 0.0
    data = text.lower().encode("utf-8", "replace")
    view = memoryview(data)
    chunks = [view[i : i + chunk_bytes] for i in range(0, len(data), chunk_bytes)]
    sizes = sorted((sum(len(c.compress(x)) for x in chunks), i) for i, (_, c) in enumerate(compressors))
    best, i = sizes[0]
    if len(sizes) == 1:
        return compressors[i][0], 1.0, 1.0
    margin = (sizes[1][0] - best) / sizes[1][0]
    return compressors[i][0], min(1.0, 0.5 + 2.0 * margin), margin


def identify(
    docs: DataFrame, dicts: dict[str, bytes], text: str = "text",
    min_margin: float = MIN_MARGIN, level: int = LEVEL,
) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``margin`` and ``rejected``.

    An input column of one of these names is replaced.
    """
    added = {"lang_pred": "string", "score": "double", "margin": "double", "rejected": "boolean"}
    kept = [c for c in docs.columns if c not in added or c == text]
    src = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*src.schema.fields, *[T.StructField(k, T._parse_datatype_string(v)) for k, v in added.items()]])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(dicts, level)
        for b in batches:
            got = [classify(x, compressors) for x in b.column(at).to_pylist()]
            langs, scores, margins = [g[0] for g in got], [g[1] for g in got], [g[2] for g in got]
            bad = [g[0] == UND or g[2] < min_margin for g in got]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(margins, pa.float64()), pa.array(bad, pa.bool_())],
                names=[*b.schema.names, *added],
            )

    return src.mapInArrow(run, schema)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dicts = training_sample(docs.where(~held_out()))
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return identify(rows, dicts).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def stage_langid(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told with a sufficient margin.

    The dictionaries are learned from the documents that the op9 contract
    allows (those that aren't held out).

    Cases: a null or empty text, and one without a letter, is rejected; a null id
    or label is judged like others; ties are narrow margins and rejected; extra
    columns of any name are carried along; repeated rows are judged alike; an
    empty table gives no rows.
    """
    rows, at = plain(docs)
    dicts = training_sample(rows.where(~held_out(at["doc_id"])), at["text"], at["lang"])
    return identify(rows, dicts, at["text"]).where("NOT rejected").select(*at.values()).toDF(*at)
