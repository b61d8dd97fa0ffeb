"""Typed edge scores, fan-out caps, type budgets, residual transitions, seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import FANOUT, H2P, P2H, P2P, TYPE_BUDGET
from .graph import within


def edge_type(src, dst):
    """0 phrase to passage, 1 passage to phrase, 2 phrase to phrase, else null."""
    return (
        F.when((src == "phrase") & (dst == "passage"), P2H).when((src == "passage") & (dst == "phrase"), H2P)
        .when((src == "phrase") & (dst == "phrase"), P2P)
    )


def typed_scores(edges: DataFrame, stats: DataFrame, avg: DataFrame) -> DataFrame:
    """(query_id, source, target, etype, score) of valid edges of the subgraphs.

    A score reads the target's statistics only: one join.
    """
    t = stats.select(F.col("id").alias("target"), "passage_phrase_deg", F.col("idf").alias("dst_idf"))
    joined = edges.join(t, "target").crossJoin(F.broadcast(avg))
    joined = joined.withColumn("etype", edge_type(F.col("src_type"), F.col("dst_type")))
    over = F.greatest(F.lit(0.0), F.col("passage_phrase_deg") / F.col("avg_passage_phrase_deg") - 1.0)
    score = (
        F.when(F.col("etype") == P2H, 2.0 / (1.0 + 0.75 * over)).when(F.col("etype") == H2P, F.col("dst_idf"))
        .otherwise(F.col("weight"))
    )
    out = joined.withColumn("score", score)
    return out.where("etype IS NOT NULL AND weight > 0 AND score > 0").select("query_id", "source", "target", "etype", "score")


def cap_fanout(scored: DataFrame, hub: DataFrame, fanout: dict | None = None) -> DataFrame:
    """The best edges of each (source, type), fewer for hubs; ties by target.

    The constant bound before the cap of each row lets Spark limit rows before
    the exchange.
    """
    flags = hub.select(F.col("id").alias("source"), "is_hub")
    marked = scored.join(flags, "source", "left")
    is_hub = F.coalesce("is_hub", F.lit(False))
    cap = F.lit(None).cast("int")
    for etype, (normal, of_hub) in (fanout or FANOUT).items():
        cap = F.when(F.col("etype") == etype, F.when(is_hub, of_hub).otherwise(normal)).otherwise(cap)
    rank = F.row_number().over(Window.partitionBy("query_id", "source", "etype").orderBy(F.desc("score"), "target"))
    most = max(max(x) for x in (fanout or FANOUT).values())
    return marked.withColumn("cap", cap).withColumn("r", rank).where((F.col("r") <= most) & (F.col("r") <= F.col("cap"))).select(
        scored.columns
    )


def type_budgets(scored: DataFrame, budget: dict | None = None) -> DataFrame:
    limits = budget or TYPE_BUDGET
    limit = F.lit(None).cast("int")
    for etype, n in limits.items():
        limit = F.when(F.col("etype") == etype, n).otherwise(limit)
    order = [F.desc("score"), F.col("source"), F.col("target")]
    return within(scored, ["query_id", "etype"], order, max(limits.values())).where(F.col("r") <= limit).drop("r")


def seed_distribution(seeds: DataFrame, beta: float = 3.0, uniform: float = 0.1) -> DataFrame:
    """(query_id, id, p): softmax of the scores mixed with the uniform distribution."""
    w = Window.partitionBy("query_id")
    best = seeds.groupBy("query_id", "id").agg(F.greatest(F.max("score"), F.lit(1e-6)).alias("score"))
    e = F.exp(beta * (F.col("score") - F.max("score").over(w)))
    soft = best.withColumn("e", e).withColumn("p", (1 - uniform) * F.col("e") / F.sum("e").over(w) + uniform / F.count("*").over(w))
    return soft.withColumn("p", F.col("p") / F.sum("p").over(w)).select("query_id", "id", "p")


def normalize(dist: DataFrame) -> DataFrame:
    """Positive entries, divided by their sum within the query."""
    w = Window.partitionBy("query_id")
    return dist.where("p > 0").withColumn("p", F.col("p") / F.sum("p").over(w))


def seed_hubs(dist: DataFrame, hub: DataFrame) -> DataFrame:
    """(query_id, id) of the seeds that are hubs."""
    return dist.join(hub.where("is_hub").select("id"), "id", "left_semi").select("query_id", "id")


def uniform(nodes: DataFrame) -> DataFrame:
    """(query_id, id, p): uniform over a subgraph's passages, or over all of ``nodes(query_id, id, type)`` if it has none."""
    w, passage = Window.partitionBy("query_id"), F.col("type") == "passage"
    some = F.count_if(passage).over(w)
    out = nodes.withColumns({"_n": some, "_all": F.count("*").over(w)}).where(passage | (F.col("_n") == 0))
    return out.select("query_id", "id", (1.0 / F.when(F.col("_n") > 0, F.col("_n")).otherwise(F.col("_all"))).alias("p"))


def suppress_hub(dist: DataFrame, hub: DataFrame, nodes: DataFrame) -> DataFrame:
    """Takes the mass of a query's seed hubs away, normalised.

    Its other seeds take it in proportion.  If all seeds are hubs, what the last
    of them had goes to the subgraph's passages, or else to all its other nodes:
    moving the mass hub by hub, in the order of ids, ends in the same map.
    """
    marked = dist.where("p > 0").join(hub.where("is_hub").select("id").withColumn("h", F.lit(True)), "id", "left")
    w = Window.partitionBy("query_id")
    others = F.sum(F.when(F.col("h").isNull(), F.col("p"))).over(w)
    kept = marked.withColumn("others", others).where("h IS NULL").select("query_id", "id", (F.col("p") / F.col("others")).alias("p"))
    alone = marked.groupBy("query_id").agg(F.max("id").alias("last"), F.bool_and(F.coalesce("h", F.lit(False))).alias("only")).where("only")
    rest = nodes.join(alone, "query_id").where(F.col("id") != F.col("last")).select("query_id", "id", "type")
    return kept.unionByName(uniform(rest))


def first_given(*dists: DataFrame) -> DataFrame:
    """(query_id, id, p): of each query the first of the distributions that has any row for it."""
    every = None
    for i, d in enumerate(dists):
        d = d.select("query_id", "id", "p").withColumn("_k", F.lit(i))
        every = d if every is None else every.unionByName(d)
    w = Window.partitionBy("query_id")
    return every.withColumn("_m", F.min("_k").over(w)).where("_k = _m").drop("_k", "_m")


def residual_parts(scored: DataFrame, stats: DataFrame, hub: DataFrame, avg: DataFrame, visited: DataFrame | None = None) -> DataFrame:
    """(query_id, source, p, alpha, structural, residual) of each source node.

    Hubs among ``visited(query_id, id)`` are sources even if none of their edges is kept.
    """
    each = scored.select("query_id", "source", "score", F.lit(1).alias("one"))
    if visited is not None:
        some = visited.join(hub.where("is_hub").select("id"), "id", "left_semi")
        each = each.unionByName(some.select("query_id", F.col("id").alias("source"), F.lit(0.0).alias("score"), F.lit(0).alias("one")))
    kept = each.groupBy("query_id", "source").agg(F.sum("score").alias("total"), F.sum("one").alias("kept"))
    s = stats.select(F.col("id").alias("source"), F.col("phrase_deg").alias("deg"))
    h = hub.where("is_hub").select(F.col("id").alias("source"), F.lit(True).alias("hub"))
    joined = kept.join(s, "source").join(h, "source", "left").crossJoin(F.broadcast(avg))
    on = F.coalesce(F.col("hub"), F.lit(False)) & (F.col("deg") > 0)
    p = F.least(F.lit(0.95), F.greatest(F.lit(0.0), 0.8 * F.try_divide("deg", F.col("deg") + F.col("avg_phrase_deg"))))
    alpha = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide("kept", "deg")))
    out = joined.withColumn("p", F.when(on, p).otherwise(0.0)).withColumn("alpha", F.when(on, alpha).otherwise(1.0))
    return out.select(
        "query_id", "source", "total", "p", "alpha", ((1 - F.col("p")) * F.col("alpha")).alias("structural"),
        ((1 - F.col("p")) * (1 - F.col("alpha"))).alias("residual"),
    )


def transitions(scored: DataFrame, parts: DataFrame, base: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(query_id, source, target, weight): structural, self-loop and teleport parts summed.

    Teleports follow ``base(query_id, id, p)``; a hub among ``own(query_id, id)``,
    the query's seed hubs, does not jump to itself.
    """
    keys = ["query_id", "source"]
    structural = scored.join(parts, keys).select(*keys, "target", (F.col("score") / F.col("total") * F.col("structural")).alias("weight"))
    loops = parts.where("p > 0").select(*keys, F.col("source").alias("target"), F.col("p").alias("weight"))
    jump = parts.where("residual > 0").join(base.select("query_id", F.col("id").alias("target"), F.col("p").alias("sp")), "query_id")
    if own is not None:
        seed = own.select("query_id", F.col("id").alias("source"), F.lit(True).alias("seed"))
        jump = jump.join(seed, keys, "left").where("seed IS NULL OR source <> target")
    jump = jump.withColumn("s", F.sum("sp").over(Window.partitionBy(*keys)))
    jump = jump.select(*keys, "target", (F.col("residual") * F.col("sp") / F.col("s")).alias("weight"))
    every = structural.where("weight > 0").unionByName(loops).unionByName(jump)
    return every.groupBy(*keys, "target").agg(F.sum("weight").alias("weight"))


def damping(base: float, seed_hub_ratio, seeds, nodes):
    """The damping factor's schedule by seed hubs, seeds and subgraph size."""
    d = F.lit(base) - F.when(seed_hub_ratio >= 0.5, 0.08).otherwise(0.0) + F.when(seeds >= 4, 0.03).otherwise(0.0)
    d = d + F.when(nodes <= 200, -0.03).when(nodes >= 2000, 0.02).otherwise(0.0)
    return F.least(F.lit(0.92), F.greatest(F.lit(0.55), d))


def reset_vector(current: DataFrame, history: DataFrame, decay: float = 0.2) -> DataFrame:
    """(query_id, id, p): (1 - decay) current + decay history, normalised; a query without a history has no decay."""
    w = Window.partitionBy("query_id")
    tagged = current.select("query_id", "id", "p", F.lit(False).alias("old")).unionByName(history.select("query_id", "id", "p", F.lit(True).alias("old")))
    share = F.when(F.bool_or("old").over(w), F.when(F.col("old"), decay).otherwise(1 - decay)).otherwise(1.0)
    return normalize(tagged.withColumn("p", F.col("p") * share).groupBy("query_id", "id").agg(F.sum("p").alias("p")))


def history_distribution(history: DataFrame, visited: DataFrame) -> DataFrame:
    """(query_id, id, p): uniform over the history's nodes that the subgraph holds."""
    some = history.select("query_id", "id").distinct().join(visited, ["query_id", "id"], "left_semi")
    return some.withColumn("p", 1.0 / F.count("*").over(Window.partitionBy("query_id")))


def default_stats(nodes: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Statistics for every node: 1 (and idf 1 for phrases, else 0) where ``stats`` has none."""
    phrase = F.col("type") == "phrase"
    usual = {"phrase_deg": F.lit(1.0), "passage_phrase_deg": F.lit(1.0), "idf": F.when(phrase, 1.0).otherwise(0.0)}
    if stats is None:
        return nodes.select("id", "type").withColumns(usual)
    out = nodes.select("id", "type").join(stats.drop("type"), "id", "left")
    return out.withColumns({c: F.coalesce(F.col(c), x) for c, x in usual.items()})
