"""Retrieval with hub seeds and histories, reranking with fallbacks, ingest, files and the command line."""

import hashlib

import pytest
from pyspark.sql import functions as F

from mnemoweave import cli
from mnemoweave.config import available_mb, profile
from mnemoweave.operators import evaluate, fusion, sessions, transition
from mnemoweave.sources import tables as S

NODES = "query_id long, id long, type string"
DIST = "query_id long, id long, p double"


def as_map(df):
    return {(r["query_id"], r["id"]): pytest.approx(r["p"]) for r in df.collect()}


def test_hub_mass_goes_to_others_or_passages_or_all(spark):
    hub = spark.createDataFrame([(1, True), (2, True), (3, False)], "id long, is_hub boolean")
    nodes = [(q, i, "phrase") for q in range(1, 6) for i in (1, 2, 3)] + [(q, i, "passage") for q in (1, 2, 4) for i in (10, 11)]
    nodes = spark.createDataFrame([*nodes, (6, 1, "phrase")], NODES)
    dist = [(1, 1, 0.5), (1, 3, 0.5), (2, 1, 1.0), (3, 1, 0.5), (3, 2, 0.5), (4, 1, 0.3), (4, 2, 0.7), (5, 3, 1.0), (6, 1, 1.0)]
    got = as_map(transition.suppress_hub(spark.createDataFrame(dist, DIST), hub, nodes))
    assert got == {(1, 3): 1.0, (2, 10): 0.5, (2, 11): 0.5, (3, 1): 0.5, (3, 3): 0.5, (4, 10): 0.5, (4, 11): 0.5, (5, 3): 1.0}


def test_history_decays_only_where_there_is_one(spark):
    current = spark.createDataFrame([(1, 1, 1.0), (2, 1, 1.0)], DIST)
    past = spark.createDataFrame([(1, 5, 1.0), (3, 5, 1.0)], DIST)
    assert as_map(transition.reset_vector(current, past)) == {(1, 1): 0.8, (1, 5): 0.2, (2, 1): 1.0, (3, 5): 1.0}
    visited = spark.createDataFrame([(1, 5), (1, 6)], "query_id long, id long")
    asked = spark.createDataFrame([(1, 5), (1, 6), (1, 7)], "query_id long, id long")
    assert as_map(transition.history_distribution(asked, visited)) == {(1, 5): 0.5, (1, 6): 0.5}


def test_hub_without_kept_edges_keeps_its_loop(spark):
    hub = spark.createDataFrame([(1, True)], "id long, is_hub boolean")
    stats = spark.createDataFrame([(1, 4.0)], "id long, phrase_deg double")
    avg = spark.createDataFrame([(2.0,)], "avg_phrase_deg double")
    none = spark.createDataFrame([], "query_id long, source long, target long, etype int, score double")
    visited = spark.createDataFrame([(1, 1)], "query_id long, id long")
    parts = transition.residual_parts(none, stats, hub, avg, visited)
    row = parts.first()
    assert (row["p"], row["alpha"], row["residual"]) == (pytest.approx(0.8 * 4 / 6), 0.0, pytest.approx(1 - 0.8 * 4 / 6))
    base = spark.createDataFrame([(1, 1, 0.5), (1, 9, 0.5)], DIST)
    moves = {(r["source"], r["target"]): pytest.approx(r["weight"]) for r in transition.transitions(none, parts, base, visited).collect()}
    assert moves == {(1, 1): 0.8 * 4 / 6, (1, 9): 1 - 0.8 * 4 / 6}


def test_rerank_fallbacks(spark):
    c = spark.createDataFrame([(1, 11, 0.9, 1), (1, 22, 0.8, 2), (1, 33, 0.7, 3), (1, 11, 0.1, 4)], "query_id long, passage_id long, ppr_score double, ppr_rank int")
    s = spark.createDataFrame([(1, 11, 0.0), (1, 22, 5.0)], "query_id long, passage_id long, logit double")
    order = lambda **k: [r["passage_id"] for r in fusion.rerank_and_fuse(c, **({"scores": s, "top_k": 2, "asked": 2, "w_ppr": 0.1, "w_rerank": 0.9} | k)).orderBy("final_rank").collect()]
    assert order() == [22, 11]
    plain = [11, 22]
    assert order(enabled=False) == order(asked=0) == order(asked=-1) == order(w_ppr=0, w_rerank=0) == order(method="other") == order(scores=None) == plain
    assert order(top_k=3) == [11, 22, 33]  # a score is missing among the three asked
    with pytest.raises(ValueError):
        fusion.pack_pair(F.col("a"), F.col("b"), model_max=2)
    assert fusion.top_n(0, 5, 9) == 0 and fusion.top_n(2, 5, 9) == 5 and fusion.top_n(20, 5, 9) == 9
    assert fusion.special_ids({"<s>": 1, "</s>": 2}) == {"cls": 1, "sep": 2, "pad": 0}

    def failing():
        raise RuntimeError

    pairs = c.select("query_id", "passage_id", F.lit("q").alias("query"), F.lit("t").alias("text"))
    assert fusion.score_pairs(pairs, lambda: lambda q, t: failing()).count() == 0


def test_contexts_profiles_and_timers(spark):
    e = spark.createDataFrame([("s", 1, "update", ["A"]), ("s", 2, "clear", None), ("t", 1, "clear", None), ("t", 2, "update", ["B"])], "session_id string, turn long, action string, entities array<string>")
    assert [(r["session_id"], r["entities"]) for r in sessions.current_context(e).collect()] == [("t", ["B"])]
    assert profile("auto", 3000) == (0.05, 2000) and profile("auto", 99_999) == (1.0, 1_000_000) and profile("odd") == (0.10, 5000)
    assert profile("low", n_max=7, alpha=0.5) == (0.5, 7) and available_mb(100, 50, True) == 125 and available_mb(100, 50) == 100
    assert evaluate.timed(sum, [1, 2])[0] == 3


def test_files_and_tables(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "f.json").write_text('{"fixture_id":"x","docs":[{"id":"1","text":"t"}],"query":"q","target_doc_id":"1"}')
    assert S.text_documents(spark, f"{tmp_path}/a.txt").first()["text"] == "one\ntwo"
    assert S.file_digests(spark, f"{tmp_path}/a.txt").first()["sha256"] == hashlib.sha256(b"one\ntwo").hexdigest()
    assert S.checked_fixtures(S.fixtures(spark, f"{tmp_path}/f.json")).first()["missing"] == ["target_substring"]
    S.create_tables(spark, f"{tmp_path}/t")
    S.create_tables(spark, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t/memories").count() == 0
    spark.createDataFrame([(3, [1.0])], "rowid int, embedding array<double>").write.parquet(f"{tmp_path}/old")
    assert S.migrate_vectors(spark, f"{tmp_path}/old", f"{tmp_path}/new").first().asDict() == {"id": 3, "embedding": [1.0]}
    S.write_report(spark.range(1), f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").first()["id"] == 0


def test_command_line(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    run = lambda *a: cli.main(["--store", store, *a], spark)
    assert run("search", "Paris") == "No matching entities found." and run("stats") == {}
    assert run("index", "--text", "Paris lies on the Seine river") == 1
    (tmp_path / "b.txt").write_text("Paris and London are linked by Eurostar trains")
    assert run("index", "--file", f"{tmp_path}/b.txt") == 2
    got = run("stats")
    assert got["passage_nodes"] == 2 and got["phrase_nodes"] == 4 and got["total_edges"] == 10
    assert "Seine river" in run("search", "Where is Seine?") and run("search", "nothing here") == "No matching entities found."
    nodes, _ = cli.load(spark, store)
    ids = {r["name"]: r["id"] for r in nodes.where("type = 'phrase'").collect()}
    spark.createDataFrame([(ids["Paris"], [1.0, 0.0]), (ids["London"], [0.99, 0.1]), (ids["Seine"], [0.0, 1.0])], "id long, embedding array<float>").write.parquet(f"{tmp_path}/vec")
    assert run("optimize-graph", "--vectors", f"{tmp_path}/vec") == 3 and run("stats")["total_edges"] == 12
