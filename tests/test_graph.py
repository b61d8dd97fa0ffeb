"""Graph, transition and PageRank operators against closed-form values."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoweave.config import node_budget
from mnemoweave.lineage import cut
from mnemoweave.operators import fusion, graph, ppr, transition, vectors
from mnemoweave.sources import tables

EDGE = "source long, target long, weight double, src_type string, dst_type string"


def test_hub_flags_top_degree(spark):
    rows = [(100 + i, 1, 1.0, "passage", "phrase") for i in range(10)] + [(100, 2, 1.0, "passage", "phrase")]
    got = {r["id"]: r["is_hub"] for r in graph.hubs(spark.createDataFrame(rows, EDGE)).collect()}
    assert got == {1: True, 2: False}


def test_hub_is_not_expanded(spark):
    rows = [(1, 2, 1.0, "passage", "phrase"), (2, 1, 1.0, "phrase", "passage")]
    rows += [(2, 100 + i, 1.0, "phrase", "phrase") for i in range(5)]
    edges = spark.createDataFrame(rows, EDGE)
    hub = spark.createDataFrame([(2, True)], "id long, is_hub boolean")
    seeds = spark.createDataFrame([(1, 1)], "query_id long, id long")
    assert {r["id"] for r in graph.ego(seeds, edges, hub).collect()} == {1, 2}


def test_keep_first_and_max(spark):
    df = spark.createDataFrame([(1, 2, 1.0, 0), (1, 2, 2.0, 1)], "source long, target long, weight double, seq int")
    assert graph.keep_first(df, "seq").first()["weight"] == 1.0
    assert graph.keep_max(df).first()["weight"] == 2.0


def test_seed_distribution_values(spark):
    s = spark.createDataFrame([(1, 5, 0.9), (1, 1, 0.2), (1, 9, 0.5)], "query_id long, id long, score double")
    p = {r["id"]: r["p"] for r in transition.seed_distribution(s).collect()}
    assert p[5] == pytest.approx(0.665511, abs=1e-5) and p[1] == pytest.approx(0.110748, abs=1e-5)


def test_damping_values(spark):
    row = spark.range(1).select(
        transition.damping(0.8, F.lit(1.0), F.lit(1), F.lit(50)).alias("a"), transition.damping(0.8, F.lit(0.0), F.lit(8), F.lit(5000)).alias("b")
    ).first()
    assert row["a"] == pytest.approx(0.69) and row["b"] == pytest.approx(0.85)


def test_two_node_rank():
    x = ppr.solve(np.array([0, 1]), np.array([1, 0]), np.ones(2), np.array([1.0, 0.0]), 0.82, 500)
    assert x == pytest.approx([0.549451, 0.450549], abs=1e-5)


def test_node_budget():
    assert node_budget(1000, 0.1, 5000) == 5000 and node_budget(1000, 0.1, 100_000) == 51_200


def test_synonym_pair(spark):
    a, b = [1.0] + [0.0] * 7, [0.99, 0.1] + [0.0] * 6
    v = spark.createDataFrame([(1, a), (2, b)], "id long, embedding array<float>")
    assert vectors.synonym_links(v, v).count() == 2


def test_fusion_values(spark):
    c = spark.createDataFrame([(1, 11, 1, 0.1), (1, 22, 2, 0.2)], "query_id long, passage_id long, ppr_rank int, logit double")
    got = {r["passage_id"]: r["fused"] for r in fusion.weighted_sum(fusion.postprocess(c)).collect()}
    assert got == pytest.approx({11: 0.7, 22: 0.3})
    got = {r["passage_id"]: r["fused"] for r in fusion.reciprocal_ranks(fusion.postprocess(c)).collect()}
    assert got == pytest.approx({11: 0.016314, 22: 0.016208}, abs=1e-6)
    c = spark.createDataFrame([(1, 11, 1, float("nan")), (1, 22, 2, 1.0)], "query_id long, passage_id long, ppr_rank int, logit double")
    ranked = fusion.weighted_sum(fusion.postprocess(c)).orderBy("final_rank").collect()
    assert [r["passage_id"] for r in ranked] == [22, 11]


@pytest.mark.parametrize("percentile", [0.99, 0.9, 0.5, 0.0])
def test_hub_flags_split_equal_degrees(spark, percentile):
    rng = random.Random(3)
    rows = [(100_000 + i, t * 7919 % 1000, 1.0, "passage", "phrase") for t in range(300) for i in range(rng.choice((1, 1, 1, 2, 5)))]
    degree = Counter(r[1] for r in rows)
    order = sorted(degree, key=lambda i: (-degree[i], i))
    want = set(order[: max(1, int(len(order) * (1 - percentile)))])
    got = graph.hubs(spark.createDataFrame(rows, EDGE), percentile).collect()
    assert {r["id"]: r["degree"] for r in got} == degree and {r["id"] for r in got if r["is_hub"]} == want


def test_hub_flags_without_phrases(spark):
    assert graph.hubs(spark.createDataFrame([(1, 2, 1.0, "phrase", "passage")], EDGE)).collect() == []


def test_nth_takes_equal_values(spark):
    values = [5] * 700 + list(range(300))
    rows = spark.createDataFrame([(v,) for v in values], "id long")
    assert [graph.nth(rows, "id", n) for n in (1, 6, 500, 1000)] == [sorted(values)[n - 1] for n in (1, 6, 500, 1000)]


def test_budgets_are_those_of_one_ranking(spark):
    rng = random.Random(4)
    rows = [(q, i, rng.randrange(9) / 2.0) for q, n in ((1, 900), (2, 3), (3, 200)) for i in range(n)]
    df = spark.createDataFrame(rows, "query_id long, id long, score double")
    got = {(r["query_id"], r["r"]): r["id"] for r in graph.within(df, ["query_id"], [F.desc("score"), F.col("id")], 40).collect()}
    want = {}
    for q in (1, 2, 3):
        best = sorted((-s, i) for p, i, s in rows if p == q)[:40]
        want |= {(q, k + 1): i for k, (_, i) in enumerate(best)}
    assert got == want


def test_connectivity_by_brute_force(spark):
    rng = random.Random(6)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(90)} | {(0, i) for i in range(40)}
    pairs = [(k, rng.choice((0, rng.randrange(45))), rng.randrange(45)) for k in range(300)]
    out = {a: {t for s, t in edges if s == a} for a in range(45)}
    got = graph.connectivity(spark.createDataFrame(pairs, "pair_id long, a long, b long"), spark.createDataFrame(list(edges), "source long, target long"))
    assert {r["pair_id"]: r["connected"] for r in got.collect()} == {k: b in out[a] or bool(out[a] & out[b]) for k, a, b in pairs}


def test_steps_on_whole_graphs_reach_the_kernel(spark):
    rng = np.random.default_rng(8)
    src, dst = rng.integers(0, 12, 40), rng.integers(0, 12, 40)
    weight, reset = np.ones(40), np.full(12, 1 / 12)
    share = weight / np.bincount(src, weight, 12)[src]
    shares = spark.createDataFrame(list(zip(src.tolist(), dst.tolist(), share.tolist(), strict=True)), "source long, target long, share double")
    base = spark.createDataFrame([(i, 1 / 12) for i in range(12)], "id long, p double")
    rank = base.withColumnRenamed("p", "score")
    for _ in range(3):
        rank = ppr.whole_graph_step(rank, shares, base, 0.85)
    want = ppr.solve(src, dst, weight, reset, 0.85, 3)
    assert {r["id"]: r["score"] for r in rank.collect()} == pytest.approx(dict(enumerate(want.tolist())))


def test_connectivity_by_kinds_of_neighbours(spark):
    rng = random.Random(9)
    kind = {i: "passage" if i % 3 else "phrase" for i in range(40)} | {5: None}
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(120)} | {(0, i) for i in range(40)}
    rows = [(s, t, 1.0, kind[s], kind[t]) for s, t in edges]
    # one pair_id for several pairs, as rows may share a line number
    pairs = sorted({(k // 2, rng.choice((0, rng.randrange(45))), rng.randrange(45)) for k in range(300)})
    out = {a: {t for s, t in edges if s == a} for a in range(45)}
    got = graph.connectivity(spark.createDataFrame(pairs, "pair_id long, a long, b long"), spark.createDataFrame(rows, EDGE))
    assert {(r["pair_id"], r["a"], r["b"]): r["connected"] for r in got.collect()} == {p: p[2] in out[p[1]] or bool(out[p[1]] & out[p[2]]) for p in pairs}


def test_statistics_of_some_nodes_read_no_more(spark, tmp_path):
    pairs = [(2 * (i % 90), 2 * (i * i % 31) + 1) for i in range(400)]
    lines = [(p // 2, h // 2) for p, h in pairs]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    plain, (nodes, edges) = tables.order_graph(spark, str(tmp_path)), tables.order_graph(spark, str(tmp_path), cut)
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, plain[1].collect()))
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, plain[0].collect()))
    ids = cut(spark.createDataFrame([(1, 3), (1, 8), (2, 3), (2, 999)], "query_id long, id long"))
    some = graph.node_stats(nodes, edges, ids)
    want = {r["id"]: tuple(r) for r in graph.node_stats(*plain).collect() if r["id"] in (3, 8)}
    assert want and {r["id"]: tuple(r) for r in some.collect()} == want
    # edges meet the ids before they are dealt by node, and a written frame is read by columns
    below = [line for line in some._jdf.queryExecution().optimizedPlan().toString().splitlines() if "LeftSemi" in line]
    assert len(below) >= 5 and "parquet" in some._jdf.queryExecution().executedPlan().toString().lower()


def test_candidates_are_dealt_to_more_tasks_as_they_grow(spark):
    of = lambda n: fusion.dealt(spark.range(n).withColumn("query_id", F.col("id") % 50), task_rows=100)
    assert [of(n).rdd.getNumPartitions() for n in (0, 90, 1000, 2001)] == [1, 1, 10, 21]
    assert of(1000).count() == 1000
