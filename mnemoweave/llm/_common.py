"""What the training-data operators share: table access, scratch tables, words.

Scratch tables live in the folder that the session names in
``spark.checkpoint.dir`` (shared by the driver and all executors).  A folder of
our own is used only when the setting is absent, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed
#: and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that go to a Python worker at once, or a single row.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can see; made here only in local mode, if none is configured."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if sc.getCheckpointDir() is None and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="mnemoweave-"))
        base = sc.getCheckpointDir()
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Written tables that cut lineage: they survive lost executors.

    ``write`` stores a frame as Parquet in the shared folder and returns the
    reread frame; ``drop`` deletes one whose readers have been written in turn.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/mnemoweave-{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        # the table replaces the shuffle files behind it
        conf, new = self.spark.conf, {_CLEANUP: "true", _BATCH: str(BATCH_BYTES)}
        before = {k: conf.get(k, None) for k in new}
        try:
            for k, v in new.items():
                conf.set(k, v)
            df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def in_parts(batch: pa.RecordBatch, *columns: int, most_bytes: int = 1 << 20, more: np.ndarray | int = 0) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts (``columns``) and ``more`` bytes a row hold at most ``most_bytes``, or of a single row.

    What a kernel needs at once follows from the bytes of its slice, however long single texts are.
    """
    sizes = more + sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    ends = np.cumsum(sizes + 1)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ..., so that none can clash with ours, and {name: new name}."""
    names = docs.columns
    new = [f"c{i}" for i in range(len(names))]
    return docs.toDF(*new), dict(zip(names, new, strict=True))


def n_words(text):
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")

