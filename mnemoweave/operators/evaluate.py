"""Retrieval metrics."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import cosine


def raw_hit(result, wanted):
    """A text that lacks the first characters of the other is not searched for the rest."""
    return F.when((prefix_hit(result, wanted) & F.contains(result, wanted)) | F.contains(wanted, result), 1.0).otherwise(0.0)


def adaptive(recall, result):
    """Recall discounted by the tokens used, about a fifth of the words' number."""
    used = F.size(F.filter(F.split(result, r"\s+"), lambda x: x != "")) / 5.0
    return recall * F.exp(-0.5 * used / 1500.0)


def drift_control(context, topics):
    """1 minus the largest cosine to an irrelevant topic, at least 0 of it."""
    sims = F.transform(topics, lambda t: cosine(context, t))
    return F.lit(1.0) - F.greatest(F.lit(0.0), F.coalesce(F.array_max(sims), F.lit(0.0)))


def compression(prompt, raw):
    return F.lit(1.0) - F.try_divide(F.length(prompt) / 4.0, F.length(raw) / 4.0)


def prefix_hit(result, wanted, n: int = 30):
    return F.contains(result, F.substring(wanted, 1, n))


def means(rows: DataFrame, *metrics: str) -> DataFrame:
    """One row: the mean of each metric, 0 where there is none."""
    return rows.agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in metrics])


def hit_at_1(found: DataFrame, wanted: DataFrame, baseline: DataFrame) -> DataFrame:
    """(query_id, hit, baseline_hit) of the first answers (query_id, id) of two methods against ``wanted(query_id, target)``."""
    rows = wanted.join(found.select("query_id", F.col("id").alias("f")), "query_id", "left")
    rows = rows.join(baseline.select("query_id", F.col("id").alias("b")), "query_id", "left")
    same = lambda c: F.coalesce(F.col(c) == F.col("target"), F.lit(False))
    return rows.select("query_id", same("f").alias("hit"), same("b").alias("baseline_hit"))


def timed(run, *args) -> tuple[object, float]:
    """(result, seconds) of a driver-side step."""
    began = time.perf_counter()
    out = run(*args)
    return out, time.perf_counter() - began
