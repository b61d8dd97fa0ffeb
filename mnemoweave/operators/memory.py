"""Keyed memories: validation, folding a decision log, decay, query, purge, links."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DECAY_DAYS, DECAY_DAYS_OTHER, GRACE_DAYS, GRACE_DAYS_OTHER
from ..functions.text import is_phrase, key_prefix, normalize_text, split_key, strength, supports_substring, trust

DAY = 86_400


def _by_kind(kind, days: dict[str, int], other: int):
    out = F.lit(other)
    for name, n in days.items():
        out = F.when(F.lower(kind) == name, n).otherwise(out)
    return out * DAY


def validate(action, key, kind, value, target, affected, candidate_keys, memory_key, scope, target_scope):
    """The first reason that rejects a decision, or null.

    Columns: action, the memory's key, kind and value, target node id, affected
    keys, the candidates' ids, the target's key, scopes of memory and target.
    """
    change = action.isin("update", "delete")
    return (
        F.when(~F.coalesce(action.isin("create", "update", "delete", "noop"), F.lit(False)), "unsupported_action")
        .when(action == "noop", None)
        .when(F.coalesce(key, F.lit("")) == "", "missing_key")
        .when((action == "create") & (kind.isNull() | value.isNull()), "missing_init_values")
        .when(change & target.isNull(), "candidate_missing_node_id")
        .when(change & ~F.coalesce(F.array_contains(candidate_keys, target), F.lit(False)), "target_not_in_candidates")
        .when(change & (F.coalesce(F.size(affected), F.lit(0)) <= 0), "empty_affected_keys")
        .when((action == "update") & (scope != target_scope), "immutable_scope_violation")
        .when((action == "update") & (key != memory_key), "immutable_key_violation")
    )


def _lives(log: DataFrame) -> DataFrame:
    """The log with ``life`` (deletes of the key before a row) and ``opened``, the first create of that life."""
    key = Window.partitionBy("mem_key")
    gone = F.sum(F.when(F.col("action") == "delete", 1).otherwise(0)).over(key.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = log.withColumn("life", F.coalesce(gone, F.lit(0)))
    first = F.min(F.when(F.col("action") == "create", F.col("seq"))).over(Window.partitionBy("mem_key", "life"))
    return rows.withColumn("opened", first)


def outcomes(log: DataFrame) -> DataFrame:
    """(mem_key, seq, status, reason) of each decision of a log, in the order of ``seq``."""
    on = F.coalesce(F.col("seq") > F.col("opened"), F.lit(False))
    change = F.col("action").isin("update", "delete")
    status = (
        F.when(change & ~on, "noop").when(F.col("action") == "update", "updated").when(F.col("action") == "delete", "deleted")
        .when((F.col("action") == "create") & on, "updated").when(F.col("action") == "create", "created").otherwise("noop")
    )
    reason = F.when(change & ~on, "target_not_active").when((F.col("action") == "create") & on, "create_conflict_converged")
    return _lives(log).select("mem_key", "seq", status.alias("status"), reason.alias("reason"))


def fold(log: DataFrame) -> DataFrame:
    """The memories after a log of (mem_key, seq, ts, action, kind, kind_given, trust,
    init_trust, strength, init_strength, value), applied by key in the order of ``seq``.

    A row for each life of a key: it begins with a create and ends with a delete,
    which changes the status and time alone.  A create of an active key converges
    on it: kind and value only if given, trust and strength replaced.  An update
    takes trust and strength from the memory, else from its initial values, else
    keeps them; it replaces the kind if one is given, be it null.  Updates and
    deletes of a key that is not active change nothing.
    """
    create, update = F.col("action") == "create", F.col("action") == "update"
    rows = _lives(log).where("opened IS NOT NULL AND seq >= opened").where(F.col("action").isin("create", "update", "delete"))
    first = F.col("seq") == F.col("opened")
    at = lambda on: F.when(on, F.col("seq"))
    metric = lambda name: F.when(create, F.col(f"init_{name}")).when(update, F.coalesce(name, f"init_{name}"))
    box = lambda c: F.struct(c.alias("v"))
    name = split_key(F.col("mem_key"))[1]
    value = F.when(first, F.coalesce(F.when(F.col("value") != "", F.col("value")), name)).when(create | update, F.col("value"))
    out = rows.groupBy("mem_key", "life").agg(
        F.when(F.bool_or(F.col("action") == "delete"), "deleted").otherwise("active").alias("status"),
        F.max_by(box(F.col("kind")), at(first | (create & F.col("kind").isNotNull()) | (update & F.col("kind_given")))).alias("k"),
        F.max_by(box(trust(metric("trust"))), at(metric("trust").isNotNull())).alias("t"),
        F.max_by(box(strength(metric("strength"))), at(metric("strength").isNotNull())).alias("s"),
        F.max_by(box(value), at(value.isNotNull())).alias("c"),
        F.max_by("ts", "seq").alias("updated_at"), F.min_by("ts", "seq").alias("last_seen"),
    )
    return out.select(
        "mem_key", "life", "status", F.col("k.v").alias("kind"), F.col("c.v").alias("value"), F.col("t.v").alias("trust"),
        F.col("s.v").alias("strength"), "updated_at", "last_seen", F.lit(None).cast("long").alias("last_retrieved"),
        F.col("last_seen").alias("created_at"), split_key(F.col("mem_key"))[0].alias("scope"),
    )


#: The fields of a memory that its metadata repeats.
SNAPSHOT = ("mem_key", "scope", "kind", "status", "updated_at", "last_seen", "last_retrieved", "trust", "strength")


def load_metadata(text: str | None) -> dict:
    """A JSON object; anything else is empty."""
    try:
        out = json.loads(text) if text else {}
    except ValueError:
        return {}
    return out if isinstance(out, dict) else {}


def merged_metadata(text: str | None, row: dict, retrieved: bool = False) -> str:
    """Metadata with the row's fields under ``mem``, as compact ASCII JSON.

    Other fields of ``mem`` stay; ``last_retrieved`` keeps what it was, unless it is what the write was about.
    """
    meta = load_metadata(text)
    old = meta["mem"] if isinstance(meta.get("mem"), dict) else {}
    mem = {k: v for k, v in old.items() if k not in SNAPSHOT}
    mem |= {k: row[k] for k in SNAPSHOT if k in row and (k != "last_retrieved" or retrieved)}
    if not retrieved and "last_retrieved" in old:
        mem["last_retrieved"] = old["last_retrieved"]
    out = meta | {"mem": mem}
    out.setdefault("created_at", row.get("updated_at"))
    return json.dumps(out, ensure_ascii=True, separators=(",", ":"))


def refresh_metadata(memories: DataFrame, retrieved: bool = False) -> DataFrame:
    """``memories`` with ``metadata`` renewed from their columns."""

    @F.pandas_udf("string")
    def renew(text: pd.Series, row: pd.DataFrame) -> pd.Series:
        plain = row.astype(object).where(row.notna(), None).to_dict("records")
        as_int = {"updated_at", "last_seen", "last_retrieved"}
        tidy = [{k: int(v) if k in as_int and v is not None else v for k, v in r.items()} for r in plain]
        return pd.Series([merged_metadata(t, r, retrieved) for t, r in zip(text, tidy, strict=True)])

    text = F.col("metadata") if "metadata" in memories.columns else F.lit(None).cast("string")
    return memories.withColumn("metadata", renew(text, F.struct(*SNAPSHOT)))


def list_candidates(memories: DataFrame, scope: str | None = None, limit: int = 128) -> DataFrame:
    """The newest memories of whatever status, of one scope if given."""
    some = memories if scope is None else memories.where(F.col("scope") == scope)
    return some.orderBy(F.desc("updated_at"), "mem_key", "life").limit(limit)


def known_keys(candidates: DataFrame, keys: int = 32, prefixes: int = 12) -> DataFrame:
    """One row (known_keys, known_prefixes): the first distinct ones of the candidates, newest first."""
    rows = candidates.withColumn("k", F.trim("mem_key")).where("coalesce(k, '') <> ''")
    listed = rows.agg(F.array_sort(F.collect_list(F.struct((-F.col("updated_at")).alias("o"), F.col("k").alias("m"), "life", "k"))).alias("l"))
    names = F.transform("l", lambda x: key_prefix(split_key(x["k"])[1]))
    return listed.select(
        F.slice(F.array_distinct("l.k"), 1, keys).alias("known_keys"),
        F.slice(F.filter(F.array_distinct(names), lambda x: x != ""), 1, prefixes).alias("known_prefixes"),
    )


def effective_strength(base, kind, since, now):
    """base * exp(-rate * age), at least 0.01."""
    age = F.greatest(F.lit(0), now - since)
    return F.greatest(F.coalesce(base, F.lit(0.0)) * F.exp(-age / _by_kind(kind, DECAY_DAYS, DECAY_DAYS_OTHER)), F.lit(0.01))


def retrieved_at(last_retrieved="last_retrieved", created="last_seen", updated="updated_at"):
    return F.coalesce(last_retrieved, created, updated, F.lit(0))


def query(
    memories: DataFrame, now: int, top_k: int = 10, overfetch: int = 8, min_trust: float = 0.0, min_strength: float = 0.01,
    scope: str | None = None, kind: str | None = None, status: str = "active",
) -> DataFrame:
    """The newest overfetch * top_k rows, filtered, the strongest top_k of them, with effective values.

    ``scope`` is compared as it is given; a row whose scope is not its key's is left out.
    """
    rows = memories.where(F.col("status") == status)
    rows = rows if scope is None else rows.where(F.col("scope") == scope)
    rows = rows if kind is None else rows.where(F.col("kind") == kind)
    fresh = rows.orderBy(F.desc("updated_at"), "mem_key").limit(max(overfetch * top_k, top_k))
    eff = effective_strength(F.col("strength"), F.col("kind"), retrieved_at(), F.lit(now))
    encoded, name = split_key(F.col("mem_key"))
    out = fresh.withColumns({
        "strength_eff": eff, "last_retrieved_effective": retrieved_at(), "canonical_key": name, "trust": F.coalesce("trust", F.lit(0.0)),
        "strength_base": F.coalesce("strength", F.lit(0.0)),
    })
    out = out.where((F.col("trust") >= min_trust) & (F.col("strength_eff") >= min_strength) & (F.coalesce("scope", encoded) == encoded))
    return out.orderBy(F.desc("strength_eff"), F.desc("trust"), F.desc("updated_at"), "mem_key").limit(top_k)


def mark_retrieved(memories: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    hit = memories.join(keys.select("mem_key").distinct().withColumn("_h", F.lit(True)), "mem_key", "left")
    on = F.coalesce("_h", F.lit(False)) & (F.col("status") == "active")
    return hit.withColumns({c: F.when(on, F.lit(now).cast("long")).otherwise(F.col(c)) for c in ("last_retrieved", "updated_at")}).drop("_h")


def mark_used(memories: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    hit = memories.join(keys.select("mem_key").distinct().withColumn("_h", F.lit(True)), "mem_key", "left")
    on = F.coalesce("_h", F.lit(False)) & (F.col("status") == "active")
    eff = effective_strength(F.col("strength"), F.col("kind"), retrieved_at(), F.lit(now))
    new = {"strength": F.when(on, F.least(F.lit(1.0), F.greatest(eff, F.lit(0.01)) + 0.1)).otherwise(F.col("strength"))}
    new |= {c: F.when(on, F.lit(now).cast("long")).otherwise(F.col(c)) for c in ("last_seen", "updated_at")}
    return hit.withColumns(new).drop("_h")


def purge(memories: DataFrame, now: int) -> DataFrame:
    """Active rows unseen for their kind's grace become deleted; adds ``purged``."""
    age = F.lit(now) - F.coalesce("last_seen", "updated_at")
    gone = (F.col("status") == "active") & F.coalesce(age >= _by_kind(F.col("kind"), GRACE_DAYS, GRACE_DAYS_OTHER), F.lit(False))
    return memories.withColumn("purged", gone).withColumns({
        "status": F.when(F.col("purged"), "deleted").otherwise(F.col("status")),
        "updated_at": F.when(F.col("purged"), F.lit(now).cast("long")).otherwise(F.col("updated_at")),
    })


GRAM = 4


def _grams(text):
    """The distinct runs of ``GRAM`` characters of a text."""
    n = F.length(text) - GRAM + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(GRAM)))))


def link_entities(terms: DataFrame, phrases: DataFrame) -> DataFrame:
    """(node_id, term, phrase_id): exact name (lowest id), else a hub whose name
    contains a term of four letters or more (shortest name, lowest id), else null
    for a phrase still to be made.  ``terms(node_id, term)``, ``phrases(id, name, is_hub)``.

    A term meets the hubs that have its first four characters somewhere, by an
    equi-join, and is then looked for in their names.
    """
    t = terms.select("node_id", normalize_text(F.col("term")).alias("term")).where(is_phrase(F.col("term"))).distinct()
    exact = phrases.groupBy(F.lower("name").alias("term")).agg(F.min("id").alias("exact"))
    t = t.join(exact, "term", "left")
    hub = phrases.where("is_hub").select("id", F.lower("name").alias("name"))
    hub = hub.withColumn("gram", F.explode(_grams(F.col("name"))))
    part = t.where(F.col("exact").isNull() & supports_substring(F.col("term"))).select("term").distinct()
    part = part.withColumn("gram", F.substring("term", 1, GRAM))
    part = part.join(hub, "gram").where(F.contains("name", "term")).groupBy("term").agg(
        F.min(F.struct(F.length("name"), F.col("id"))).alias("m")
    ).select("term", F.col("m.id").alias("like"))
    return t.join(part, "term", "left").select("node_id", "term", F.coalesce("exact", "like").alias("phrase_id"))


def link_writes(links: DataFrame, edges: DataFrame, weight: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(new phrases (id, name), edges(source, target, weight)) after linking.

    A term without a phrase gets one, named by itself; both directions are
    written, and an edge that is there already keeps the larger weight.
    """
    made = F.xxhash64(F.lit("phrase"), F.col("term"))
    new = links.where("phrase_id IS NULL").select(made.alias("id"), F.col("term").alias("name")).distinct()
    both = F.inline(F.array(
        F.struct(F.col("node_id").alias("source"), F.col("p").alias("target")), F.struct(F.col("p").alias("source"), F.col("node_id").alias("target"))
    ))
    added = links.withColumn("p", F.coalesce(F.col("phrase_id"), made)).select(both).withColumn("weight", F.lit(weight))
    every = edges.select("source", "target", "weight").unionByName(added)
    return new, every.groupBy("source", "target").agg(F.max("weight").alias("weight"))


def linked_terms(decided: DataFrame) -> DataFrame:
    """(node_id, term) of the decisions (node_id, status, entities) that are linked: those that wrote a memory."""
    some = decided.where(F.col("status").isin("created", "updated") & (F.coalesce(F.size("entities"), F.lit(0)) > 0))
    return some.select("node_id", F.explode("entities").alias("term"))
