"""Retrieval for many queries at once, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..lineage import cut
from ..operators import graph, ppr, transition
from ..operators.vectors import similarity

NOTHING_FOUND = "No matching entities found."


def seeds_by_name(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, id, score 1): the phrases of exactly a name of ``names(query_id, name)``, lowest id first."""
    phrases = nodes.where("type = 'phrase'").groupBy("name").agg(F.min("id").alias("id"))
    return names.select("query_id", "name").distinct().join(phrases, "name").select("query_id", "id", F.lit(1.0).alias("score"))


def seeds_by_distance(near: DataFrame) -> DataFrame:
    """(query_id, id, score) of the neighbours ``near(query_id, id, distance)`` of the queries' vectors."""
    return near.select("query_id", "id", similarity(F.col("distance")).alias("score"))


def merge_seeds(*seeds: DataFrame) -> DataFrame:
    """One row a seed, with its best score."""
    every = seeds[0]
    for s in seeds[1:]:
        every = every.unionByName(s)
    return every.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def contents(ranked: DataFrame, nodes: DataFrame) -> DataFrame:
    """``ranked(query_id, id, ...)`` with the nodes' content as ``text``, empty if they have none."""
    text = nodes.select("id", F.coalesce("content", F.lit("")).alias("text"))
    return ranked.join(text, "id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def plan(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, config: Config = Config(), history: DataFrame | None = None) -> dict[str, DataFrame]:
    """The steps of retrieval by name: hub, visited, current, moves, reset, damping, scores.

    ``history(query_id, id)`` holds the phrases of a session's context, for
    queries without drift.
    """
    # what several later steps read is written once
    hub = cut(graph.hubs(edges, config.hub_percentile))
    start = seeds.select("query_id", "id")
    start = start if history is None else start.unionByName(history.select("query_id", "id"))
    visited = cut(graph.ego(start, edges, hub, config.ego_depth, config.node_budget))
    # statistics and types of the subgraphs' nodes alone, means of the whole graph
    stats, avg = cut(graph.node_stats(nodes, edges, visited)), cut(graph.averages(edges))
    typed = visited.join(graph.among(nodes.select("id", "type"), visited), "id").select("query_id", "id", "type")
    scored = transition.typed_scores(graph.induced(visited, edges), stats, avg)
    scored = cut(transition.type_budgets(transition.cap_fanout(scored, hub)))
    dist = cut(transition.seed_distribution(seeds.join(visited, ["query_id", "id"], "left_semi"), config.seed_beta, config.seed_uniform))
    # teleports, reset and damping all follow the map from which seed hubs are taken
    own, current = transition.seed_hubs(dist, hub), cut(transition.suppress_hub(dist, hub, typed))
    past = transition.history_distribution(history, visited) if history is not None else current.limit(0)
    base = transition.first_given(current, past, transition.uniform(typed))
    parts = transition.residual_parts(scored, stats, hub, avg, visited)
    n = visited.groupBy("query_id").agg(F.count("*").alias("nodes"))
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    sizes = n.join(count(own, "hubs"), "query_id", "left").join(count(current, "seeds"), "query_id", "left")
    seeds_ = F.greatest(F.coalesce("seeds", F.lit(0)), F.lit(1))
    damping = transition.damping(config.ppr_damping, F.coalesce("hubs", F.lit(0)) / seeds_, seeds_, F.col("nodes"))
    return {
        "hub": hub, "visited": visited, "current": current, "moves": transition.transitions(scored, parts, base, own),
        "reset": transition.first_given(transition.reset_vector(current, past, config.history_decay), transition.uniform(typed)),
        "damping": sizes.select("query_id", damping.alias("damping")),
    }


def search(
    seeds: DataFrame, nodes: DataFrame, edges: DataFrame, config: Config = Config(), k: int = 10, history: DataFrame | None = None,
) -> DataFrame:
    """(query_id, id, score, ppr_rank) from seeds(query_id, id, score).

    Ego subgraph, typed scores, caps and budgets, residual transitions, reset,
    damping, PageRank, ranking; each query is a key, no step loops over queries.
    """
    p = plan(seeds, nodes, edges, config, history)
    return ppr.top_passages(ppr.ppr(p["moves"], p["reset"], p["damping"], config.ppr_iterations), nodes, k)


def format_results(found: DataFrame, header=None) -> DataFrame:
    """(query_id, result): ``header`` (a column, if given) and a block for each non-empty passage, best first."""
    block = F.format_string("--- [Score: %.4f] ---\n%s", "score", "text")
    rows = found.where("coalesce(text, '') <> ''").select("query_id", F.struct("ppr_rank", block.alias("t")).alias("b"))
    out = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    text = F.array_join(F.col("b.t"), "\n")
    return out.select("query_id", (text if header is None else F.concat(header, F.lit("\n\nRelevant Passages:\n\n"), text)).alias("result"))


def header(names: int, seeds, history, decay, damping):
    """The first line of a result."""
    more = F.when(seeds > names, F.format_string(" (expanded to %d)", seeds)).otherwise("")
    return F.concat(
        F.format_string("Found %d seed entities", F.lit(names)), more,
        F.format_string(". History context: %d entities (Decay=%s). Damping=%.3f.", history, decay.cast("string"), damping),
    )


def first_passage(result):
    """The first block's text of a formatted result."""
    return F.regexp_extract(result, r"(?s)--- \[Score: [^\]]*\] ---\n(.*?)(?:\n--- \[Score: |$)", 1)
