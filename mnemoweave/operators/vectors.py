"""Exact vector search: kNN by L2, synonym links, cosine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
#: Queries whose rough distances, and pairs whose differences, are held at once.
QUERY_ROWS, PAIR_ROWS = 512, 1 << 15
#: Norms from this to its inverse have squares that neither underflow nor overflow.
TINY = 1e-140


def nearest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, id, distance) of the k rows of ``y`` nearest to each of ``x``, ties by id.

    Every vector that may be among them by its rough distance and a bound of the
    rounding is measured by differences, however many are equal.
    """
    yy = (y * y).sum(1)
    norm, take, found = np.sqrt(np.nanmax(yy)), min(len(y), k), []
    for i in range(0, len(x), QUERY_ROWS):
        part = x[i : i + QUERY_ROWS]
        rough = yy[None, :] - 2 * part @ y.T
        slack = 8 * (y.shape[1] + 8) * np.finfo(float).eps * (norm + np.sqrt((part * part).sum(1))) ** 2
        limit = np.partition(rough, take - 1, axis=1)[:, take - 1] + slack
        row, col = np.nonzero(~(rough > limit[:, None]))
        cuts = range(0, len(row), PAIR_ROWS)
        exact = np.concatenate([np.sqrt(((part[row[c : c + PAIR_ROWS]] - y[col[c : c + PAIR_ROWS]]) ** 2).sum(-1)) for c in cuts])
        order = np.lexsort((ids[col], exact, row))
        best = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
        found.append((i + row[best], ids[col[best]], exact[best]))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def in_blocks(queries: DataFrame, vectors: DataFrame, block_rows: int) -> DataFrame:
    """(key, embedding, side, a, b): both sides dealt to blocks, for each pair (a, b) of a block of queries (side 0) and one of vectors."""
    n_q = queries.agg(F.count("*").alias("n")).select(F.ceil(F.col("n") / block_rows).cast("int").alias("qb"))
    n_v = vectors.agg(F.count("*").alias("n")).select(F.ceil(F.col("n") / block_rows).cast("int").alias("vb"))
    size = n_q.crossJoin(n_v)
    q = queries.select(F.col("query_id").alias("key"), "embedding", F.lit(0).alias("side")).crossJoin(F.broadcast(size))
    v = vectors.select(F.col("id").alias("key"), "embedding", F.lit(1).alias("side")).crossJoin(F.broadcast(size))
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.where("vb > 0").withColumn("a", own("qb")).withColumn("b", every("vb"))
    v = v.where("qb > 0").withColumn("b", own("vb")).withColumn("a", every("qb"))
    return q.unionByName(v)


def knn(queries: DataFrame, vectors: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest of ``vectors(id, embedding)``.

    Both sides are dealt to blocks; each pair of blocks keeps its k nearest, and
    a window keeps the best of these.  Distances are recomputed by differences.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "id": [], "distance": []}).astype({"query_id": "int64", "id": "int64", "distance": float})
        x, y = (np.stack(s.embedding.to_numpy()).astype(np.float64) for s in (left, right))
        at, ids, distances = nearest(x, y, right.key.to_numpy(), k)
        return pd.DataFrame({"query_id": left.key.to_numpy()[at], "id": ids, "distance": distances})

    found = in_blocks(queries, vectors, block_rows).groupBy("a", "b").applyInPandas(run, "query_id long, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def synonym_links(phrases: DataFrame, vectors: DataFrame, k: int = 5, max_distance: float = 0.55) -> DataFrame:
    """Both directed edges, weight 1, of each of a phrase's k nearest (itself
    included) that is another node nearer than ``max_distance``."""
    near = knn(phrases.select(F.col("id").alias("query_id"), "embedding"), vectors, k)
    hits = near.where((F.col("query_id") != F.col("id")) & (F.col("distance") < max_distance))
    both = F.explode(F.array(
        F.struct(F.col("query_id").alias("source"), F.col("id").alias("target")),
        F.struct(F.col("id").alias("source"), F.col("query_id").alias("target")),
    ))
    return hits.select(both.alias("e")).select("e.*", F.lit(1.0).alias("weight")).distinct()


def most_alike(x: np.ndarray, y: np.ndarray, x_ids: np.ndarray, y_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, id, cosine) of the row of ``y`` with another id of largest cosine to each of ``x``, ties by id; none for no such row.

    Products of unit vectors find which rows may be the one, but for a bound of
    the rounding; their cosines are summed anew, component by component.  All
    of a row that such products do not order (as with infinite components) may be.
    """
    with np.errstate(all="ignore"):
        xn, yn = (np.sqrt((z * z).sum(1))[:, None] for z in (x, y))
        xu, yu = (np.where(n > 0, z / n, 0.0) for z, n in ((x, xn), (y, yn)))
    slack, found = 16 * (y.shape[1] + 8) * np.finfo(float).eps, []
    plain = ((yn == 0) | (yn > TINY) & (yn < 1 / TINY))[:, 0]
    for i in range(0, len(x), QUERY_ROWS):
        part, ids = slice(i, i + QUERY_ROWS), x_ids[i : i + QUERY_ROWS]
        with np.errstate(all="ignore"):
            rough = xu[part] @ yu.T
        lo, hi = (np.searchsorted(y_ids, ids, s) for s in ("left", "right"))
        for r in np.flatnonzero(hi > lo):
            rough[r, lo[r] : hi[r]] = -np.inf
        usual = ((xn[part] == 0) | (xn[part] > TINY) & (xn[part] < 1 / TINY))[:, 0]
        rough[:, ~plain] = np.where(rough[:, ~plain] == -np.inf, -np.inf, np.nan)
        most = np.max(np.where(np.isnan(rough), -np.inf, rough), axis=1) if np.isnan(rough).any() else rough.max(axis=1)
        may = ~(rough < most[:, None] - slack)
        may[~usual] = True
        may &= rough != -np.inf
        row, col = np.nonzero(may)
        if len(row) == 0:
            continue
        cuts = range(0, len(row), PAIR_ROWS)
        exact = np.concatenate([cosines(x[part][row[c : c + PAIR_ROWS]], y[col[c : c + PAIR_ROWS]]) for c in cuts])
        # as in Spark, NaN is the largest
        order = np.lexsort((y_ids[col], -exact, ~np.isnan(exact), row))
        best = order[np.searchsorted(row, np.unique(row))]
        found.append((i + row[best], y_ids[col[best]], exact[best]))
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return tuple(np.concatenate(z) for z in zip(none, *found, strict=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``cosine`` of each row of ``x`` and that of ``y``, summed in the same order."""
    xy, xx, yy = (np.zeros(len(x)) for _ in range(3))
    with np.errstate(all="ignore"):
        for j in range(x.shape[1]):
            a, b = x[:, j], y[:, j]
            xy, xx, yy = xy + a * b, xx + a * a, yy + b * b
        n = np.sqrt(xx) * np.sqrt(yy)
        return np.where(n == 0, 0.0, xy / n)


def cosine_top1(queries: DataFrame, vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, id, cosine): of the vectors with another id the one of largest cosine, ties by id.

    A null vector, and one with a null component or of another length than the
    query's, has cosine 0.  Each pair of blocks keeps the best of its vectors.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        out = []
        # vectors of one length are compared as a matrix; with all others the cosine is 0
        for n, some in left.groupby(left["size"]):
            same, other = right[right["size"] == n], right[right["size"] != n]
            if n >= 0 and len(same):
                x, y = (np.stack(s.embedding.to_numpy()).astype(np.float64).reshape(len(s), -1) for s in (some, same))
                at, ids, s = most_alike(x, y, some.key.to_numpy(), same.key.to_numpy())
                out.append(pd.DataFrame({"query_id": some.key.to_numpy()[at], "id": ids, "cosine": s}))
            # the lowest id, or the next if that is the query itself
            first = (other if n >= 0 else right).key.unique()[:2]
            for at in first:
                asked = some.key[(some.key != at) & ((at == first[0]) | (some.key == first[0]))]
                out.append(pd.DataFrame({"query_id": asked, "id": at, "cosine": 0.0}))
        none = pd.DataFrame({"query_id": [], "id": [], "cosine": []}).astype({"query_id": "int64", "id": "int64", "cosine": float})
        return pd.concat(out) if out else none

    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    rows = in_blocks(queries, vectors, block_rows).withColumn("size", F.when(whole, F.size("embedding")).otherwise(-1))
    rows = rows.withColumn("embedding", F.when(whole, F.col("embedding")))
    found = rows.groupBy("a", "b").applyInPandas(run, "query_id long, id long, cosine double")
    # NaN comes back from a worker as null
    found = found.withColumn("cosine", F.coalesce("cosine", F.lit(float("nan"))))
    best = F.max_by("id", F.struct("cosine", -F.col("id")))
    return found.groupBy("query_id").agg(best.alias("id"), F.max("cosine").alias("cosine"))


def cosine(a, b):
    """Cosine of two array columns in double precision; 0 where a norm is zero."""
    zipped = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(total(F.transform(x, lambda v: v.cast("double") * v.cast("double"))))
    return F.coalesce(F.try_divide(total(zipped), norm(a) * norm(b)), F.lit(0.0))


def similarity(distance):
    return 1.0 / (1.0 + distance)


def mean_pool(tokens, mask):
    """The mean of the token vectors whose mask is 1, of length 1 (zero stays zero)."""
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])
    n = F.greatest(F.size(kept), F.lit(1))
    start = F.transform(tokens[0], lambda _: F.lit(0.0))
    mean = F.aggregate(kept, start, lambda s, v: F.zip_with(s, v, lambda a, b: a + b), lambda s: F.transform(s, lambda x: x / n))
    norm = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(mean, lambda x: x / F.greatest(norm, F.lit(1e-12)))


def word_vectors(tokens, word_ids):
    """The vector of each word: that of its first sub-word; tokens without a word have a null id."""
    first = F.filter(F.sequence(F.lit(0), F.size(word_ids) - 1), lambda i: word_ids[i].isNotNull() & (F.array_position(word_ids, word_ids[i]) == i + 1))
    return F.transform(first, lambda i: tokens[i])


def spans(n, max_width: int = 12):
    """All (start, end) of at most ``max_width`` of n words, both inclusive, in order."""
    start = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(start, lambda i: F.transform(
        F.sequence(i, F.least(i + max_width - 1, n - 1)), lambda j: F.struct(i.alias("start"), j.alias("end"))
    )))
