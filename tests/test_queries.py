"""Registered queries over whole tables, against brute force on small ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoweave import queries
from mnemoweave.operators import ppr, vectors


@pytest.fixture()
def save(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_raw_recall_judges_every_pair(spark, save):
    items = {0: "the quick brown fox jumps over the lazy dog", 1: "another passage that is long enough to have a rest"}
    texts = {3: f"x {items[0]} y", 7: f"{items[1]}", 8: items[0][:35], 41: f"{items[1][:30]} no more", 50: None, 51: "nothing"}
    save("benchmark", list(items.items()), "item_id long, text string")
    d = save("documents", list(texts.items()), "doc_id long, text string")
    got = {(r["item_id"], r["doc_id"]): (r["recall"], r["prefix_hit"]) for r in queries.raw_recall(spark, d).collect()}
    assert got == {
        (i, k): (float(bool(t) and (w in t or t in w)), None if t is None else w[:30] in t) for i, w in items.items() for k, t in texts.items()
    }


LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"


@pytest.fixture()
def lines():
    rng = random.Random(5)
    return [(o, rng.randrange(40), 1, n, 1.0) for o in range(1500) for n in range(1, rng.randint(2, 5))]


def converged(n, src, dst, weight, reset, damping):
    move = np.zeros((n, n))
    np.add.at(move, (src, dst), weight)
    total = move.sum(axis=1, keepdims=True)
    move = np.divide(move, total, out=np.zeros_like(move), where=total > 0)
    return np.linalg.solve(np.eye(n) - damping * move.T, (1 - damping) * reset)


def test_solve_converges():
    rng = np.random.default_rng(1)
    src, dst, weight = rng.integers(0, 29, 80), rng.integers(0, 30, 80), rng.random(80)
    reset = rng.random(30) / 15
    assert ppr.solve(src, dst, weight, reset, 0.85, 100) == pytest.approx(converged(30, src, dst, weight, reset, 0.85), abs=1e-6)


def test_ppr_scores_are_converged_and_whole(spark, save, lines):
    d = save("lineitem", lines, LINES)
    save("part", [(i,) for i in range(40)], "p_partkey long")
    got = {(r["query_id"], r["id"]): r["score"] for r in queries.ppr_scores(spark, d).collect()}
    plan, _ = queries._plan(spark, d)
    moves, resets, want = plan["moves"].toPandas(), plan["reset"].toPandas(), {}
    damping = {r["query_id"]: r["damping"] for r in plan["damping"].collect()}
    for q, r in resets.groupby("query_id"):
        e = moves[moves.query_id == q]
        ids = np.unique(np.r_[e.source, e.target, r.id])
        at = lambda x: np.searchsorted(ids, x.to_numpy())  # noqa: E731, B023
        reset = np.zeros(len(ids))
        np.add.at(reset, at(r.id), r.p.to_numpy())
        x = converged(len(ids), at(e.source), at(e.target), e.weight.to_numpy(), reset, damping[q])
        want |= {(q, i): y for i, y in zip(ids.tolist(), x.tolist(), strict=True) if i % 2 == 0 and y > 0}
    assert len(want) > 600 and set(resets.query_id) == {1, 2, 3, 4} and got == pytest.approx(want, abs=2e-6)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture()
def copies():
    """500 vectors, 30 of them equal."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(500, 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[rng.choice(500, 30, replace=False)] = v[7]
    return v


def by_distance(v, k):
    x = v.astype(np.float64)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    return d, [sorted(range(len(v)), key=lambda j: (d[i, j], j))[:k] for i in range(len(v))]  # noqa: B023


def test_knn_keeps_the_lowest_ids_of_copies(spark, save, copies):
    d = save("embeddings", [(i, x.tolist(), 0) for i, x in enumerate(copies)], VECTORS)
    dist, near = by_distance(copies, 5)
    got = {(r["query_id"], r["rank"]): r["id"] for r in queries.knn_l2(spark, d).collect()}
    assert got == {(i, r + 1): j for i, js in enumerate(near) for r, j in enumerate(js)}
    links = {(r["source"], r["target"]) for r in queries.synonym_links(spark, d).collect()}
    hits = {(i, j) for i, js in enumerate(near) for j in js if i != j and dist[i, j] < 1.15}
    assert links == hits | {(j, i) for i, j in hits}


def test_knn_across_blocks(spark, copies):
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(copies)], "id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in vectors.knn(v.withColumnRenamed("id", "query_id"), v, 5, 100).collect()}
    assert got == {(i, r + 1): j for i, js in enumerate(by_distance(copies, 5)[1]) for r, j in enumerate(js)}


def test_cosine_queries_grow_with_the_table(spark, save, copies):
    d = save("embeddings", [(i, x.tolist(), 0) for i, x in enumerate(copies)], VECTORS)
    x = copies.astype(np.float64)
    s = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    np.fill_diagonal(s, -2)
    got = {r["query_id"]: (r["id"], r["cosine"]) for r in queries.cosine_top1(spark, d).collect()}
    assert sorted(got) == list(range(0, 500, 50))
    for q, (i, c) in got.items():
        assert c == pytest.approx(s[q].max(), abs=2e-6) and s[q, i] == pytest.approx(s[q].max(), abs=1e-9)
        assert not (copies[:i] == copies[i]).all(axis=1)[np.arange(i) != q].any()


def test_pairs_and_terms_come_from_whole_tables(spark, save):
    d = save("lineitem", [(1, 700, 1, 2, 1.0), (1, 701, 1, 2, 1.0), (1, 1, 1, 1, 1.0), (2, 700, 1, 3, 1.0)], LINES)
    save("part", [(i, f"name {i}") for i in range(900)], "p_partkey long, p_name string")
    save("customer", [(i,) for i in range(800)], "c_custkey long")
    pairs = {(r["pair_id"], r["a"], r["b"]): r["connected"] for r in queries.connectivity_pairs(spark, d).collect()}
    assert pairs == {(12, 1401, 4): True, (12, 1403, 4): False, (11, 3, 4): False, (23, 1401, 6): False}
    drift = {r["session_id"]: r["drift"] for r in queries.drift_flags(spark, d).collect()}
    at = lambda r: {i for i in range(900) if i % 800 == r % 800}
    together = [{700, 701, 1}, {700}]
    joined = lambda x, y: any(a in t and b in t for t in together for a in x for b in y)
    assert drift == {c: not joined(at(c), at(7 * c)) for c in range(800)}
    assert {r["node_id"] for r in queries.entity_links(spark, d).collect()} == set(range(800))
    exact = {r["phrase_id"] for r in queries.entity_links(spark, d).where("node_id % 3 = 0").collect()}
    assert exact == {i for i in range(900) if i % 800 % 3 == 0}


def test_cosine_in_blocks_of_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = {i: rng.normal(size=5).tolist() for i in range(60)}
    rows |= {i: list(rows[3]) for i in (11, 12, 40)} | {i: [0.0] * 5 for i in (20, 45)}
    rows |= {5: [1e-30] * 5, 6: None, 7: [1.0, None, 1.0, 1.0, 1.0], 8: [1.0, 2.0], 25: [3.0, 6.0], 9: [float("inf"), 0.0, 0.0, 0.0, 0.0], 10: []}
    v = spark.createDataFrame([(i, x) for i, x in rows.items()], "id long, embedding array<float>")
    q = v.withColumnRenamed("id", "query_id")
    pairs = q.withColumnRenamed("embedding", "q").crossJoin(v).where("id <> query_id").withColumn("s", vectors.cosine(F.col("q"), F.col("embedding")))
    best = pairs.groupBy("query_id").agg(F.max_by("id", F.struct("s", -F.col("id"))).alias("id"), F.max("s").alias("s"))
    want = {r["query_id"]: (r["id"], str(r["s"])) for r in best.collect()}
    found = vectors.cosine_top1(q, v, 16)
    assert len(want) == 60 and {r["query_id"]: (r["id"], str(r["cosine"])) for r in found.collect()} == want
    # pairs are compared as blocks in workers, not as rows of a cross join
    assert "FlatMapGroupsInPandas" in found._jdf.queryExecution().executedPlan().toString()
