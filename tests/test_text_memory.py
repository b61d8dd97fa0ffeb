"""Text functions and the memory fold."""

import pytest
from pyspark.sql import functions as F

from mnemoweave.functions import text as X
from mnemoweave.operators import memory, sessions


def test_chunks(spark):
    row = spark.createDataFrame([("aa bbbb cc dddd e",), ("",)], "t string").select(X.chunks(F.col("t"), 8).alias("c")).collect()
    assert row[0]["c"] == ["aa bbbb", "cc dddd", "e"] and row[1]["c"] == []


def test_normalize(spark):
    df = spark.createDataFrame([("  A\x00Ｂ\tc  ",), ("  MixEd Key  ",)], "t string")
    assert [r[0] for r in df.select(X.normalize_text(F.col("t"))).collect()] == ["a b c", "mixed key"]
    df = spark.createDataFrame([("User:Profile",), ("  ",)], "t string")
    assert [r[0] for r in df.select(X.canonical_scope(F.col("t"))).collect()] == ["user_profile", "global"]


def test_phrase_candidates(spark):
    df = spark.createDataFrame([("a",), ("12",), ("ab",)], "t string")
    assert [r[0] for r in df.select(X.is_phrase(F.col("t"))).collect()] == [False, False, True]


def test_decay(spark):
    df = spark.createDataFrame([("fact",), ("preference",), ("task",), ("other",)], "k string")
    got = [r[0] for r in df.select(memory.effective_strength(F.lit(0.7), F.col("k"), F.lit(0), F.lit(7 * 86400))).collect()]
    assert got == pytest.approx([0.554323, 0.424571, 0.257516, 0.501572], abs=1e-5)


LOG = (
    "mem_key string, seq long, ts long, action string, kind string, kind_given boolean, trust double, init_trust double, "
    "strength double, init_strength double, value string"
)


def test_converge_update_and_delete(spark):
    log = spark.createDataFrame(
        [("g:a", 1, 10, "create", "fact", True, None, 0.1, None, 0.2, "x"), ("g:a", 2, 20, "create", None, True, None, 0.8, None, 0.9, None),
         ("g:b", 3, 30, "create", "task", True, None, 0.0, None, 0.0, None),
         ("g:c", 4, 40, "create", "fact", True, None, 0.5, None, 0.5, "z"), ("g:c", 5, 50, "delete", None, False, None, None, None, None, None),
         ("g:c", 6, 60, "update", "task", True, 0.9, None, None, None, "no"), ("g:c", 7, 70, "create", "other", True, None, 0.3, None, 0.4, "new"),
         ("g:c", 8, 80, "update", None, True, 0.7, 0.1, None, 0.6, "newer"), ("g:c", 9, 90, "update", "task", False, None, None, None, None, None),
         ("g:d", 10, 5, "delete", None, False, None, None, None, None, None), ("g:d", 11, 6, "update", "x", True, 1.0, None, None, None, "v")],
        LOG,
    )
    got = {(r["mem_key"], r["life"]): r for r in memory.fold(log).collect()}
    pick = lambda r: tuple(r[c] for c in ("status", "kind", "value", "trust", "strength", "updated_at", "last_seen"))
    assert {k: pick(r) for k, r in got.items()} == {
        ("g:a", 0): ("active", "fact", "x", 0.8, 0.9, 20, 10), ("g:b", 0): ("active", "task", "b", 0.05, 0.01, 30, 30),
        ("g:c", 0): ("deleted", "fact", "z", 0.5, 0.5, 50, 40), ("g:c", 1): ("active", None, "newer", 0.7, 0.6, 90, 70),
    }
    done = {r["seq"]: (r["status"], r["reason"]) for r in memory.outcomes(log).collect()}
    assert done[1] == ("created", None) and done[2] == ("updated", "create_conflict_converged") and done[5] == ("deleted", None)
    assert done[6] == done[10] == done[11] == ("noop", "target_not_active") and done[7] == ("created", None) and done[8] == ("updated", None)


def test_metadata():
    row = {"mem_key": "g:k", "status": "active", "updated_at": 5, "last_retrieved": 9, "trust": 0.5}
    text = memory.merged_metadata('{"provenance":"\u00e9","mem":{"extra":1,"trust":0.1,"last_retrieved":3}}', row)
    assert memory.load_metadata(text) == {"provenance": "é", "mem": {"extra": 1, "mem_key": "g:k", "status": "active", "updated_at": 5, "trust": 0.5, "last_retrieved": 3}, "created_at": 5}
    assert "\\u00e9" in text and ", " not in text and memory.load_metadata("[1]") == memory.load_metadata("{") == memory.load_metadata(None) == {}
    assert memory.load_metadata(memory.merged_metadata(None, row, retrieved=True))["mem"]["last_retrieved"] == 9


def test_sessions(spark):
    t = spark.createDataFrame([("s", 1, ["A"]), ("s", 2, []), ("s", 3, ["B"])], "session_id string, turn long, entities array<string>")
    assert sessions.latest_context(t).first()["entities"] == ["B"]
    assert [r["history"] for r in sessions.with_history(t).orderBy("turn").collect()] == [[], ["A"], ["A"]]
