"""Graph tables: edges, hubs, statistics, bounded traversal, connectivity.

Every operator is keyed joins and aggregates; ``src_type`` and ``dst_type`` are
carried by the edges, so none joins the nodes for a type.  Ties end in the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut


def keep_first(edges: DataFrame, order) -> DataFrame:
    """Repeated edges keep the weight that came first by ``order``."""
    return edges.groupBy("source", "target").agg(F.min_by("weight", order).alias("weight"))


def keep_max(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source", "target").agg(F.max("weight").alias("weight"))


def hubs(edges: DataFrame, percentile: float = 0.99) -> DataFrame:
    """(id, degree, is_hub): the phrases of the top in-degrees.

    The flags compare each row with the last hub's (degree, id).  Its degree comes
    from counts by degree; its id, if phrases of that degree are on both sides,
    from ranges of their ids and the rows of one range.
    """
    degree = cut(edges.where("dst_type = 'phrase'").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("degree")))
    by = degree.groupBy("degree").agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    most = F.greatest(F.lit(1), (F.col("total") * (F.lit(1.0) - F.lit(percentile))).cast("long"))
    upto = F.sum("n").over(Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, 0))
    # one row: the degree of the last hub, and how many of its phrases are hubs
    last = by.withColumn("upto", upto).crossJoin(F.broadcast(total)).where(F.col("upto") >= most).orderBy("upto").select(
        "degree", (most - F.col("upto") + F.col("n")).alias("room"), "n"
    ).first()
    if last is None:
        return degree.withColumn("is_hub", F.lit(False))
    flag = F.col("degree") >= last["degree"]
    if last["room"] < last["n"]:
        end = nth(degree.where(F.col("degree") == last["degree"]), "id", last["room"])
        flag = (F.col("degree") > last["degree"]) | ((F.col("degree") == last["degree"]) & (F.col("id") <= end))
    return degree.withColumn("is_hub", flag)


def nth(rows: DataFrame, key: str, n: int):
    """The ``n``-th smallest of a column without nulls: ranges of it are counted, and the rows of one are ranked."""
    dealt = cut(rows.select(key).repartitionByRange(key).withColumn("part", F.spark_partition_id()))
    upto = F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    part = dealt.groupBy("part").agg(F.count("*").alias("m")).withColumn("upto", upto).where(F.col("upto") >= n).orderBy("part").first()
    rank = F.row_number().over(Window.partitionBy("part").orderBy(key))
    one = dealt.where(F.col("part") == part["part"]).withColumn("r", rank)
    return one.where(F.col("r") == n - part["upto"] + part["m"]).first()[key]


#: Into how many parts a group is dealt that is cut to a budget.
PARTS = 64


def within(rows: DataFrame, by: list[str], order: list, budget: int) -> DataFrame:
    """``rows`` with their rank ``r`` by ``order`` (which ends in an id) in the group ``by``, those up to ``budget``.

    Parts of a group are cut first, so the task that ranks it holds ``PARTS`` budgets at most.
    """
    first = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    keys = [F.col(c) for c in rows.columns if c not in by]
    some = rows.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(PARTS))).withColumn("r", first).where(F.col("r") <= budget)
    return some.drop("_part").withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r") <= budget)


def integrity(nodes: DataFrame, edges: DataFrame, hub: DataFrame) -> DataFrame:
    """(metric, value): totals and counts by node type."""
    n = nodes.groupBy("type").agg(F.count("*").alias("value"))
    one = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    return (
        one(nodes, "total_nodes").unionByName(one(edges, "total_edges")).unionByName(one(hub.where("is_hub"), "total_hubs"))
        .unionByName(n.select(F.concat("type", F.lit("_nodes")).alias("metric"), "value"))
    )


def linkage_density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    links = edges.agg(F.count_if((F.col("src_type") == "phrase") & (F.col("dst_type") == "phrase")).alias("links"))
    phrases = nodes.agg(F.count_if(F.col("type") == "phrase").alias("phrases"))
    return links.crossJoin(phrases).withColumn(
        "density", F.coalesce(F.try_divide(F.col("links").cast("double"), F.col("phrases")), F.lit(0.0))
    )


def averages(edges: DataFrame) -> DataFrame:
    """One row: mean out-degree of phrases, mean phrase degree of passages, passages."""
    out = edges.where("src_type = 'phrase'").groupBy("source").agg(F.count("*").alias("d"))
    pp = edges.where("src_type = 'passage' AND dst_type = 'phrase'").groupBy("source").agg(F.count("*").alias("d"))
    mean = lambda df, name: df.agg(F.greatest(F.coalesce(F.avg("d"), F.lit(1.0)), F.lit(1.0)).alias(name))
    return mean(out, "avg_phrase_deg").crossJoin(mean(pp, "avg_passage_phrase_deg"))


def among(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Those of ``rows`` whose ``key`` is an id of ``ids(id)``; Spark moves the join below unions and aggregates by the key."""
    return rows.join(ids.select(F.col("id").alias(key)), key, "left_semi")


def node_stats(nodes: DataFrame, edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, type, phrase_deg, passage_phrase_deg, idf) of all nodes, or of those of ``ids(id)``."""
    # the number of passages is that of the whole graph
    passages = nodes.where("type = 'passage'").agg(F.greatest(F.count("*"), F.lit(1)).alias("passages"))
    into = edges
    if ids is not None:
        nodes, edges, into = among(nodes, ids), among(edges, ids, "source"), among(edges, ids, "target")
    out = edges.groupBy(F.col("source").alias("id")).agg(
        F.count("*").alias("deg"), F.count_if((F.col("src_type") == "passage") & (F.col("dst_type") == "phrase")).alias("pp")
    )
    df = into.where("src_type = 'passage' AND dst_type = 'phrase'").groupBy(F.col("target").alias("id")).agg(
        F.count("*").alias("df")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    idf = F.least(F.lit(8.0), F.greatest(F.lit(0.1), F.log((F.col("passages") + 1.0) / (zero("df") + 1.0)) + 1.0))
    phrase = F.col("type") == "phrase"
    return (
        nodes.select("id", "type").join(out, "id", "left").join(df, "id", "left").crossJoin(F.broadcast(passages))
        .select(
            "id", "type", F.when(phrase, zero("deg")).otherwise(0).cast("double").alias("phrase_deg"),
            F.when(F.col("type") == "passage", zero("pp")).otherwise(0).cast("double").alias("passage_phrase_deg"),
            F.when(phrase, idf).otherwise(0.0).alias("idf"),
        )
    )


def ego(seeds: DataFrame, edges: DataFrame, hub: DataFrame, depth: int = 2, budget: int = 10_000) -> DataFrame:
    """(query_id, id): nodes within ``depth`` of the seeds, not expanded through
    hubs, with all passages next to any of them; the lowest ids up to the budget.

    The rank by id runs within a query; depth is a constant, so the steps are
    unrolled joins, each from the frontier that the one before wrote.
    """
    hub_ids = hub.where("is_hub").select("id")
    out = edges.select(F.col("source").alias("id"), "target")
    visited = seeds.select("query_id", "id").distinct()
    frontier = visited
    for _ in range(depth):
        reached = frontier.join(hub_ids, "id", "left_anti").join(out, "id").select("query_id", F.col("target").alias("id"))
        frontier = cut(reached.distinct().join(visited, ["query_id", "id"], "left_anti"))
        visited = visited.unionByName(frontier)
    to_passage = edges.where("dst_type = 'passage'").select(F.col("source").alias("id"), "target")
    more = visited.join(to_passage, "id").select("query_id", F.col("target").alias("id"))
    every = visited.unionByName(more).distinct()
    return within(every, ["query_id"], [F.col("id")], budget).drop("r")


def induced(visited: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, source, target, weight, types): edges with both ends visited."""
    left = visited.select("query_id", F.col("id").alias("source"))
    right = visited.select("query_id", F.col("id").alias("target"))
    return edges.join(left, "source").join(right, ["query_id", "target"], "left_semi")


def connectivity(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``connected`` to ``pairs(pair_id, a, b)``: a -> b, or a common out-neighbour.

    Of each pair, for neighbours that are passages and for others, the end with
    fewer such edges is expanded (a, if equal; none if one end has none); whether
    the other one has an edge to a neighbour is a join by both ends of an edge,
    which also answers for a -> b.  Answers return by (a, b).
    """
    kind = F.coalesce(F.col("dst_type") == "passage", F.lit(False)) if "dst_type" in edges.columns else F.lit(False)
    e = edges.select("source", "target", kind.alias("kind"))
    degree = e.groupBy("source").agg(F.count_if("kind").alias("n1"), F.count_if(~F.col("kind")).alias("n0"))
    of = lambda end: degree.select(F.col("source").alias(end), F.col("n1").alias(f"n1_{end}"), F.col("n0").alias(f"n0_{end}"))
    both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")
    by = lambda k, n: F.struct(F.lit(k).alias("kind"), F.col(f"{n}_a").alias("n_a"), F.col(f"{n}_b").alias("n_b"))
    both = both.select("a", "b", F.inline(F.array(by(True, "n1"), by(False, "n0")))).where("n_a > 0 AND n_b > 0")
    small = both.select("a", "b", "kind", (F.col("n_a") <= F.col("n_b")).alias("of_a"))
    small = small.withColumn("source", F.when(F.col("of_a"), F.col("a")).otherwise(F.col("b")))
    asked = small.join(e, ["source", "kind"]).select("a", "b", "target", "of_a")
    asked = asked.unionByName(pairs.select("a", "b", F.col("b").alias("target"), F.lit(False).alias("of_a")))
    other = F.when(F.col("of_a"), F.col("b")).otherwise(F.col("a"))
    known = e.select(F.col("source").alias("_s"), F.col("target").alias("_t"))
    found = asked.join(known, (other == F.col("_s")) & (F.col("target") == F.col("_t")), "left_semi").select("a", "b").distinct()
    joined = pairs.join(found.withColumn("yes", F.lit(True)), ["a", "b"], "left")
    return joined.select(*pairs.columns, F.coalesce("yes", F.lit(False)).alias("connected"))


def drift(sessions: DataFrame, edges: DataFrame) -> DataFrame:
    """(session_id, drift) from (session_id, history, current) arrays of node ids.

    No history or no current names: no drift; a side that resolves to nothing:
    drift; else drift if nothing of the one is connected to the other.
    """
    pairs = sessions.select("session_id", F.explode("history").alias("a"), "current").select(
        "session_id", "a", F.explode("current").alias("b")
    ).where("a IS NOT NULL AND b IS NOT NULL")
    joined = connectivity(pairs, edges).groupBy("session_id").agg(F.bool_or("connected").alias("any"))
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return sessions.join(joined, "session_id", "left").select(
        "session_id", F.when(none("history") | none("current"), False).otherwise(~F.coalesce("any", F.lit(False))).alias("drift")
    )
