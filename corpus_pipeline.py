"""The corpus pipeline: five stages, each on all that the one before it kept.

``run(spark, sf_dir)`` applies them to the documents of a folder.  Each stage's
result is a written table in the shared folder, so a later stage starts from it
and a lost executor costs only tasks of the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemoweave.llm._common import Scratch, table
from mnemoweave.llm.op03_pack import stage_pack
from mnemoweave.llm.op04_minhash import stage_minhash
from mnemoweave.llm.op06_mix import stage_mix
from mnemoweave.llm.op07_pii import stage_pii
from mnemoweave.llm.op09_langid import stage_langid

STAGES = [
    ("language_id", stage_langid),
    ("near_dedup", stage_minhash),
    ("pii", stage_pii),
    ("mix", stage_mix),
    ("pack", stage_pack),
]

#: Compression, minwise hashing, keyed permutations and tokenizers have no SQL
#: form; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
