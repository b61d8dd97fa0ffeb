"""Cutting lineage at frames that several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A frame read from a Parquet table, which outlives executors.

    Later steps read only the columns that they need, and join by the table's
    true size.  It lies in the folder that ``spark.checkpoint.dir`` names, which
    the driver and all executors share; a folder of our own is made in local
    mode alone.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    base = sc.getCheckpointDir()
    if base is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if sc.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="mnemoweave-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir()
    path = f"{base.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
