"""Session context as a fold over turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_context(turns: DataFrame) -> DataFrame:
    """(session_id, entities, turn): what the last turn wrote, even if empty."""
    return turns.groupBy("session_id").agg(F.max_by("entities", "turn").alias("entities"), F.max("turn").alias("turn"))


def with_history(turns: DataFrame) -> DataFrame:
    """Adds the context a search sees at each turn: the last earlier non-empty entities."""
    w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    some = F.when(F.size("entities") > 0, F.col("entities"))
    return turns.withColumn("history", F.coalesce(F.last(some, ignorenulls=True).over(w), F.array().cast("array<string>")))


def current_context(events: DataFrame) -> DataFrame:
    """(session_id, entities, turn) after a log of (session_id, turn, action, entities).

    ``update`` replaces the entities, ``clear`` ends the session: it has no row until it is updated again.
    """
    last = events.groupBy("session_id").agg(F.max_by(F.struct("action", "entities", "turn"), "turn").alias("m"))
    return last.where("m.action <> 'clear'").select("session_id", "m.entities", "m.turn")
