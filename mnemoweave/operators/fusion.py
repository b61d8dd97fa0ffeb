"""Rank fusion of graph scores and reranker logits, per query."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows of candidates in a task, about: the windows by query sort them several times, and hold what they sort.
TASK_ROWS = 100_000


def dealt(rows: DataFrame, key: str = "query_id", task_rows: int = TASK_ROWS) -> DataFrame:
    """``rows`` dealt to tasks by ``key``, to more of them the more rows there are; all windows by ``key`` that follow keep these tasks."""
    return rows.repartition(max(1, -(-rows.count() // task_rows)), key)


def dedup(candidates: DataFrame) -> DataFrame:
    """The first candidate, by ppr_rank, of each passage of a query."""
    w = Window.partitionBy("query_id", "passage_id").orderBy("ppr_rank")
    return candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def top_n(asked: int, top_k: int, count: int) -> int:
    return 0 if asked <= 0 else min(max(asked, top_k), count)


def finite(x):
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def postprocess(scored: DataFrame, zscore: bool = False, clip: float | None = None, squash: bool = False) -> DataFrame:
    """Logit post-processing; ``rerank_valid`` tells whether the score counts."""
    x, w = F.col("logit"), Window.partitionBy("query_id")
    ok = finite(F.col("logit"))
    if zscore:
        some = F.when(ok, F.col("logit"))
        sd = F.stddev_pop(some).over(w)
        x = F.when(ok & (sd > 1e-6), (x - F.avg(some).over(w)) / sd).otherwise(x)
    if clip is not None:
        x = F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(-float(clip)), F.least(F.lit(float(clip)), x)))
    valid = finite(x)
    if squash:
        x = F.when(ok, 1 / (1 + F.exp(-x))).otherwise(x)
    return scored.withColumns({"rerank_score": x, "rerank_valid": valid})


def weighted_sum(cands: DataFrame, w_ppr: float = 0.7, w_rerank: float = 0.3) -> DataFrame:
    """fused = w1 * place score + w2 * min-max of the valid scores; ranked."""
    total = w_ppr + w_rerank
    q = Window.partitionBy("query_id")
    n, i = F.count("*").over(q), F.row_number().over(q.orderBy("ppr_rank", "passage_id")) - 1
    place = F.when(n <= 1, 1.0).otherwise(1.0 - i / (n - 1))
    valid = F.when(F.col("rerank_valid"), F.col("rerank_score"))
    low, high = F.min(valid).over(q), F.max(valid).over(q)
    scaled = F.when(high - low < 1e-9, 1.0).otherwise((F.col("rerank_score") - low) / (high - low))
    fused = F.when(F.col("rerank_valid"), w_ppr / total * place + w_rerank / total * scaled).otherwise(F.lit(float("-inf")))
    out = cands.withColumn("fused", fused)
    order = q.orderBy(F.desc("rerank_valid"), F.desc("fused"), "ppr_rank", "passage_id")
    return out.withColumn("final_rank", F.row_number().over(order))


def reciprocal_ranks(cands: DataFrame, k: int = 60, w_ppr: float = 0.7, w_rerank: float = 0.3) -> DataFrame:
    total = w_ppr + w_rerank
    q = Window.partitionBy("query_id")
    rr = F.row_number().over(q.orderBy(F.desc("rerank_valid"), F.desc("rerank_score"), "ppr_rank", "passage_id"))
    out = cands.withColumn("rerank_rank", rr)
    fused = w_ppr / total / (k + F.col("ppr_rank")) + w_rerank / total / (k + F.col("rerank_rank"))
    out = out.withColumn("fused", F.when(F.col("rerank_valid"), fused).otherwise(F.lit(float("-inf"))))
    order = q.orderBy(F.desc("rerank_valid"), F.desc("fused"), "ppr_rank", "rerank_rank", "passage_id")
    return out.withColumn("final_rank", F.row_number().over(order))


def weights(w_ppr: float, w_rerank: float) -> tuple[float, float] | None:
    """The weights divided by their sum, or None if that is not positive."""
    total = w_ppr + w_rerank
    return (w_ppr / total, w_rerank / total) if total > 0 else None


def rerank_and_fuse(
    candidates: DataFrame, scores: DataFrame | None, top_k: int, asked: int = 20, method: str = "weighted_sum",
    w_ppr: float = 0.7, w_rerank: float = 0.3, rrf_k: int = 60, enabled: bool = True,
) -> DataFrame:
    """(query_id, passage_id, ppr_rank, final_score, final_rank) of ``candidates(query_id,
    passage_id, ppr_score, ppr_rank)`` and the model's ``scores(query_id, passage_id, logit)``.

    The first ``asked`` (at least ``top_k``) of each query are fused, the others
    follow as they are.  A query keeps its own order if reranking is off, no
    number or weights are given, the method is unknown or a score is missing.
    """
    q = Window.partitionBy("query_id")
    rows = dedup(candidates).withColumn("place", F.row_number().over(q.orderBy("ppr_rank", "passage_id")))
    plain = rows.withColumns({"final_score": F.col("ppr_score"), "final_rank": F.col("place")})
    columns = ["query_id", "passage_id", "ppr_rank", "final_score", "final_rank"]
    share = weights(w_ppr, w_rerank)
    if not enabled or asked <= 0 or share is None or scores is None or method not in ("weighted_sum", "rrf"):
        return plain.where(F.col("final_rank") <= top_k).select(columns)
    n = max(asked, top_k)
    found = scores.select("query_id", "passage_id", "logit", F.lit(1).alias("scored")).dropDuplicates(["query_id", "passage_id"])
    rows = rows.join(found, ["query_id", "passage_id"], "left")
    whole = F.min(F.when(F.col("place") <= n, F.coalesce("scored", F.lit(0)))).over(q) == 1
    rows = rows.withColumn("whole", whole)
    top = rows.where((F.col("place") <= n) & F.col("whole"))
    fuse = weighted_sum if method == "weighted_sum" else reciprocal_ranks
    extra = {} if method == "weighted_sum" else {"k": rrf_k}
    fused = fuse(postprocess(top), w_ppr=share[0], w_rerank=share[1], **extra).withColumn("final_score", F.col("fused"))
    rest = rows.where((F.col("place") > n) | ~F.col("whole")).withColumns({"final_score": F.col("ppr_score"), "final_rank": F.col("place")})
    return fused.select(columns).unionByName(rest.select(columns)).where(F.col("final_rank") <= top_k)


def reduce_output(output):
    """A model's output row as one logit: its only value, or the second less the first; null for other shapes."""
    return F.when(F.size(output) == 1, output[0]).when(F.size(output) == 2, output[1] - output[0])


def score_pairs(pairs: DataFrame, load) -> DataFrame:
    """(query_id, passage_id, logit) of ``pairs(query_id, passage_id, query, text)``.

    ``load()`` makes, once in each worker, a function of lists of queries and of
    texts that returns a number for each; one that fails leaves its batch unscored.
    """

    def run(batches):
        model = load()
        for pdf in batches:
            try:
                logits = np.asarray(model(pdf["query"].tolist(), pdf["text"].tolist()), dtype=float)
            except Exception:  # noqa: BLE001 - whatever a model raises, its queries keep their own order
                continue
            if logits.shape == (len(pdf),):
                yield pd.DataFrame({"query_id": pdf["query_id"], "passage_id": pdf["passage_id"], "logit": logits})

    return pairs.select("query_id", "passage_id", "query", "text").mapInPandas(run, "query_id long, passage_id long, logit double")


def word_overlap():
    """A scorer without a model: the share of a query's words that the text has."""
    def score(queries: list[str], texts: list[str]) -> list[float]:
        sets = [(set((q or "").lower().split()), set((t or "").lower().split())) for q, t in zip(queries, texts, strict=True)]
        return [len(a & b) / len(a) if a else 0.0 for a, b in sets]

    return score


def special_ids(vocabulary: dict[str, int]) -> dict[str, int]:
    """Ids of the tokens that frame a pair, under either of their usual names; 0 for a missing pad."""
    first = lambda *names: next((vocabulary[n] for n in names if n in vocabulary), None)
    return {"cls": first("[CLS]", "<s>"), "sep": first("[SEP]", "</s>"), "pad": first("[PAD]", "<pad>") or 0}


def pack_pair(query, passage, model_max: int = 512, query_max: int = 64, passage_max: int = 448, cls=101, sep=102, pad=0):
    """(input_ids, mask, segments) arrays of [CLS] query [SEP] passage [SEP], padded; only the passage is cut for room."""
    if model_max < 3:
        raise ValueError(f"model_max must be 3 at least, not {model_max}")
    q = F.slice(query, 1, min(query_max, model_max - 3))
    room = F.greatest(F.lit(0), F.lit(model_max - 3) - F.size(q))
    p = F.slice(passage, F.lit(1), F.least(F.lit(passage_max), room))
    one = lambda x: F.array(F.lit(x))
    ids = F.concat(one(cls), q, one(sep), p, one(sep))
    rest = F.lit(model_max) - F.size(ids)
    mask = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), rest))
    seg = F.concat(F.array_repeat(F.lit(0), F.size(q) + 2), F.array_repeat(F.lit(1), F.size(p) + 1), F.array_repeat(F.lit(0), rest))
    return F.concat(ids, F.array_repeat(F.lit(pad), rest)), mask, seg
