"""Media columns (operator 2): Netpbm and BMP images in a binary column.

Images are decoded to numpy arrays, area-resized by integral images and kept as
NPY tiles with difference hashes.  The query stores each text losslessly as the
samples of a P6 image, 64 pixels (192 bytes) a row, in a media table in the
shared folder, rereads the table and derives everything from the stored bytes.

Cases: a null text counts as empty and is stored as one row of spaces; equal
texts give equal values, in repeated rows too; a text of any length is one image,
resized in blocks of rows; a null or undecodable image gives null columns and its
``error``; extra columns are carried along, one named like an added column is
replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import Scratch, table

ROW_BYTES = 192
TILE = (8, 9)  # rows, columns of the tile that the difference hash reads
_BLOCK_ROWS = 8192

_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


# ---- codecs -----------------------------------------------------------------

def encode_ppm(payload: bytes, row_bytes: int = ROW_BYTES) -> bytes:
    """A P6 image whose samples are ``payload`` (a multiple of ``row_bytes``)."""
    return b"P6\n%d %d\n255\n" % (row_bytes // 3, len(payload) // row_bytes) + payload


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1-P6 to an array (h, w) or (h, w, 3); 16-bit samples stay 16-bit."""
    kind = data[:2]
    need = 2 if kind in (b"P1", b"P4") else 3
    at, nums = 2, []
    for _ in range(need):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("short Netpbm header")
        nums.append(int(m[1]))
        at = m.end()
    w, h = nums[:2]
    top = nums[2] if need == 3 else 1
    if w <= 0 or h <= 0 or not 0 < top < 65536:
        raise ValueError("bad Netpbm header")
    planes = 3 if kind in (b"P3", b"P6") else 1
    shape = (h, w, 3) if planes == 3 else (h, w)
    if kind == b"P1":
        bits = re.sub(rb"#[^\n]*|\s+", b"", data[at:])
        a = 1 - (np.frombuffer(bits, np.uint8, h * w) - 48)
        return (a * 255).astype(np.uint8).reshape(shape)
    if kind in (b"P2", b"P3"):
        a = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[: h * w * planes], dtype=np.int64)
        return a.astype(np.uint8 if top < 256 else np.uint16).reshape(shape)
    at += 1  # the single white space after the header
    if kind == b"P4":
        line = (w + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, line * h, at).reshape(h, line), axis=1)[:, :w]
        return ((1 - bits) * 255).astype(np.uint8)
    if kind in (b"P5", b"P6"):
        a = np.frombuffer(data, np.uint8 if top < 256 else ">u2", h * w * planes, at)
        return a.reshape(shape)
    raise ValueError("unknown Netpbm kind")


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit palette, 24-bit and 32-bit BMP to (h, w, 3)."""
    u = lambda at, n: int.from_bytes(data[at : at + n], "little", signed=n == 4)
    start, size, w, h, bits, method = u(10, 4), u(14, 4), u(18, 4), u(22, 4), u(28, 2), u(30, 4)
    if bits not in (8, 24, 32) or method not in (0, 3) or w <= 0 or h == 0:
        raise ValueError("unsupported BMP")
    line = (w * bits // 8 + 3) & ~3
    rows = np.frombuffer(data, np.uint8, line * abs(h), start).reshape(abs(h), line)[:, : w * bits // 8]
    rows = rows if h < 0 else rows[::-1]
    if bits == 8:
        n = u(46, 4) or 256
        palette = np.frombuffer(data, np.uint8, 4 * n, 14 + size).reshape(n, 4)[:, 2::-1]
        return palette[rows]
    return rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean over exact, fractional areas, by integral images (blocks of rows)."""
    h, w = image.shape[:2]
    xs, ys = np.linspace(0, w, cols + 1), np.linspace(0, h, rows + 1)
    xi = np.minimum(xs.astype(int), w - 1)
    strip = np.empty((h, cols))
    for at in range(0, h, _BLOCK_ROWS):
        part = image[at : at + _BLOCK_ROWS].astype(np.float64)
        if part.ndim == 3:
            part = part.mean(axis=2)
        integral = np.zeros((part.shape[0], w + 1))
        np.cumsum(part, axis=1, out=integral[:, 1:])
        strip[at : at + _BLOCK_ROWS] = np.diff(integral[:, xi] + (xs - xi) * part[:, xi], axis=1)
    integral = np.zeros((h + 1, cols))
    np.cumsum(strip, axis=0, out=integral[1:])
    yi = np.minimum(ys.astype(int), h - 1)
    return np.diff(integral[yi] + (ys - yi)[:, None] * strip[yi], axis=0) / ((w / cols) * (h / rows))


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0))
    return out.getvalue()


def difference_hash(tile: np.ndarray) -> str:
    """Bits ``left < right`` of a tile of r rows and c + 1 columns, as hex."""
    bits = np.packbits((tile[:, :-1] < tile[:, 1:]).ravel())
    return bits.tobytes().hex()


# ---- operators --------------------------------------------------------------

def _replacing(df: DataFrame, added: dict[str, str], needed: str) -> tuple[DataFrame, T.StructType, int]:
    src = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in added or c == needed])
    fields = [T.StructField(k, T._parse_datatype_string(v)) for k, v in added.items() if k != needed]
    return src, T.StructType([*src.schema.fields, *fields]), src.columns.index(needed)


def media_column(df: DataFrame, text: str = "text", media: str = "media", row_bytes: int = ROW_BYTES) -> DataFrame:
    """Adds a P6 image of the padded UTF-8 bytes and ``n_bytes``; drops ``text``."""
    rest = [c for c in df.columns if c not in (text, media, "n_bytes")]
    src = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("binary").alias("_raw"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [x or b"" for x in b.column(len(rest)).to_pylist()]
            images = [encode_ppm(x.ljust(max(row_bytes, -(-len(x) // row_bytes) * row_bytes)), row_bytes) for x in raws]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(map(len, raws), pa.int64()), pa.array(images, pa.binary())],
                names=[f.name for f in schema.fields],
            )

    return src.mapInArrow(run, schema)


def media_tiles(df: DataFrame, media: str = "media", tile: tuple[int, int] = TILE) -> DataFrame:
    """Decodes a media column: adds height, width, the samples' SHA-256, length
    and tail CRC, the NPY tile and its difference hash; drops the column."""
    added = {
        "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long",
        "media_sha256": "string", "height": "int", "width": "int", "tile": "binary", "dhash": "string", "error": "string",
    }
    src, schema, at = _replacing(df, added, media)
    schema = T.StructType([f for f in schema.fields if f.name != media])

    def features(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 9 + ("null",)
        try:
            image = decode(data)
        except (ValueError, IndexError) as e:
            return (None,) * 3 + (len(data), hashlib.sha256(data).hexdigest()) + (None,) * 4 + (str(e),)
        payload = image.tobytes()
        stored = npy(np.rint(area_resize(image, *tile)).astype(np.uint8))
        return (
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data),
            hashlib.sha256(data).hexdigest(), *image.shape[:2], stored,
            difference_hash(np.load(io.BytesIO(stored))), None,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = [f for f in pa_schema if f.name in added]
        for b in batches:
            cols = list(zip(*[features(x) for x in b.column(at).to_pylist()], strict=True)) or [()] * len(added)
            arrays = [b.column(i) for i in range(b.num_columns) if i != at]
            arrays += [pa.array(c, f.type) for c, f in zip(cols, new, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    pa_schema = to_arrow_schema(schema)
    return src.mapInArrow(run, schema)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = Scratch(spark, "op2").write(media_column(docs), "media")
    return media_tiles(stored).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat(F.lit("dhash:"), "dhash").alias("feature"), "height", "width",
    )
