"""Connected components of an undirected edge table, by DataFrame steps alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch


def _is_stars(now: DataFrame) -> bool:
    """True if every node of ``now(a, b)`` is either one edge's ``a`` or only a ``b``."""
    roles = now.select(F.inline(F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("root")),
    )))
    both = roles.groupBy("node").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
    return both.where("child > 1 OR (child = 1 AND root = 1)").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", before: DataFrame | None = None) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)`` that is not the smallest
    of its component, which names it.

    ``before`` holds components known so far, in the same form; they are stars
    already, so only what the new edges join is worked on.

    Alternating large-star and small-star steps: each replaces a node's edges by
    edges to the smallest node it sees, so hubs are pre-aggregated minima and a
    long chain takes a logarithmic number of rounds.  Each round is a written
    table; the driver learns no more than whether all components are stars.  Both
    sides of a round's joins grow alike, so they are merged, never broadcast.
    """
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    clean = clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if before is not None:
        clean = clean.unionByName(before.select(F.col("node").alias("a"), F.col("component").alias("b")))
    now = scratch.write(clean.distinct(), f"{name}0")
    k = 0
    while not _is_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").select(F.inline(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b"))
        ))).where("a <> b").distinct()
        k += 1
        now = scratch.write(small, f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
