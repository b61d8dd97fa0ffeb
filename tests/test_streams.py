"""Streams in several micro-batches against the same rows as one batch; chunks against a fold."""

import random

import pytest
from pyspark.sql import functions as F

from mnemoweave import queries
from mnemoweave.functions.text import chunk_text, chunks
from mnemoweave.streaming import state


def test_drain_over_several_batches(spark, tmp_path):
    schema = "session_id string, turn int, entities array<string>"
    rows = [(f"s{i % 7}", i, [f"e{i}"] if i % 3 else []) for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k::4], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    turns = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = state.drain(state.session_contexts(turns), "session_id", f"{tmp_path}/work")
    want = {s: max((t, e) for x, t, e in rows if x == s)[1] for s in {r[0] for r in rows}}
    assert {r["session_id"]: r["entities"] for r in got.collect()} == want
    assert spark.read.parquet(f"{tmp_path}/work/parts").agg(F.count_distinct("batch")).first()[0] == 4


def test_drain_of_an_empty_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    turns = spark.readStream.schema("session_id string, turn int, entities array<string>").parquet(f"{tmp_path}/in")
    assert state.drain(state.session_contexts(turns), "session_id", f"{tmp_path}/work").collect() == []


@pytest.mark.parametrize("files", [0, 3])
def test_sessions_of_a_table_in_one_file_or_a_folder(spark, tmp_path, files):
    rows = [(i % 5, i, "user", f"Name{'abcdefg'[i % 7]} and {'Other' if i % 2 else 'x'}") for i in range(30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.repartition(files or 1).write.parquet(f"{tmp_path}/{'d/conversations.parquet' if files else 'made'}")
    if not files:
        (tmp_path / "d").mkdir()
        next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "d/conversations.parquet")
    df.where("conv_id = 1").write.parquet(f"{tmp_path}/d/conversations_old.parquet")
    got = {(r["session_id"], r["n"]) for r in queries.streaming_sessions(spark, f"{tmp_path}/d").collect()}
    assert got == {(r["session_id"], r["n"]) for r in queries.session_context(spark, f"{tmp_path}/d").collect()} and len(got) == 5


def folded(text, size):
    out, held, n = [], [], 0
    for w in text.split():
        held.append(w)
        n += len(w) + 1
        if n >= size:
            out.append(" ".join(held))
            held, n = [], 0
    return out + [" ".join(held)] * bool(held)


@pytest.mark.parametrize("size", [1, 7, 40, 512])
def test_chunks_by_a_fold(spark, size):
    rng = random.Random(size)
    texts = ["", " \t\n", "one", "x" * 600, "é ü 　z", "w " * 30_000]
    texts += ["".join(rng.choice("ab \n") for _ in range(rng.randrange(300))) for _ in range(60)]
    assert [chunk_text(t, size) for t in texts] == [folded(t, size) for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i long, t string")
    got = {r["i"]: r["c"] for r in df.select("i", chunks(F.col("t"), size).alias("c")).collect()}
    assert got == {i: folded(t or "", size) for i, t in enumerate([*texts, None])}
