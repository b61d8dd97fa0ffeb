"""Personalised PageRank: a kernel for bounded subgraphs, joins for whole graphs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def solve(src, dst, weight, reset: np.ndarray, damping: float, iterations: int) -> np.ndarray:
    """Power iteration on rows normalised to 1; what
    vertices without a way out hold leaks to a sink that is not reported."""
    n = len(reset)
    out = np.bincount(src, weight, n)
    share = weight / out[src]
    x = reset.astype(float)
    for _ in range(iterations):
        y = (1 - damping) * reset + damping * np.bincount(dst, x[src] * share, n)
        if np.abs(y - x).sum() < 1e-12:
            return y
        x = y
    return x


def ppr(edges: DataFrame, resets: DataFrame, dampings: DataFrame, iterations: int = 100) -> DataFrame:
    """(query_id, id, score) from edges(query_id, source, target, weight),
    resets(query_id, id, p) and dampings(query_id, damping).

    A subgraph is bounded by the node budget and its edges by the type budgets,
    so each query is one group.
    """
    rows = edges.select("query_id", "source", "target", "weight").unionByName(
        resets.select("query_id", F.col("id").alias("source"), F.lit(None).cast("long").alias("target"), F.col("p").alias("weight"))
    ).join(F.broadcast(dampings), "query_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seeds, e = pdf[pdf.target.isna()], pdf[pdf.target.notna()]
        e = e.sort_values(["source", "target"])
        ids = np.unique(np.concatenate([pdf.source.to_numpy(np.int64), e.target.to_numpy(np.int64)]))
        reset = np.zeros(len(ids))
        np.add.at(reset, np.searchsorted(ids, seeds.source.to_numpy(np.int64)), seeds.weight.to_numpy())
        reset = reset / reset.sum() if reset.sum() > 0 else np.full(len(ids), 1 / len(ids))
        s, t = (np.searchsorted(ids, e[c].to_numpy(np.int64)) for c in ("source", "target"))
        x = solve(s, t, e.weight.to_numpy(), reset, float(pdf.damping.iloc[0]), iterations)
        return pd.DataFrame({"query_id": pdf.query_id.iloc[0], "id": ids, "score": x})

    return rows.groupBy("query_id").applyInPandas(run, "query_id long, id long, score double")


def top_passages(scores: DataFrame, nodes: DataFrame, k: int = 10) -> DataFrame:
    """The best passages of each query, ranked; ties (to ten decimals) by id."""
    passages = nodes.where("type = 'passage'").select("id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 10)), "id"))
    return scores.join(passages, "id", "left_semi").withColumn("ppr_rank", rank).where(F.col("ppr_rank") <= k)


def whole_graph_step(rank: DataFrame, shares: DataFrame, reset: DataFrame, damping: float) -> DataFrame:
    """One iteration on a graph too large for a group: a join and a sum."""
    moved = rank.join(shares, F.col("id") == F.col("source")).groupBy(F.col("target").alias("id")).agg(
        F.sum(F.col("score") * F.col("share")).alias("in")
    )
    return reset.join(moved, "id", "full").select(
        "id", ((1 - damping) * F.coalesce("p", F.lit(0.0)) + damping * F.coalesce("in", F.lit(0.0))).alias("score")
    )
