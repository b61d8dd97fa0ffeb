"""The engine's operators as queries on the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as X
from .operators import evaluate, fusion, graph, memory, ppr, sessions, transition, vectors
from .lineage import cut
from .plans import retrieve
from .registry import ORACLES, QUERIES, query  # noqa: F401
from .sources import tables as S
from .streaming import state

NOW = 1_706_659_200  # 2024-01-31, after the last event
#: The seeds of the first query are two parts, of the second a part and two orders; the third's are a hub and a
#: part, the fourth's a hub alone.
SEEDS = [(1, 15, 1.0), (1, 23, 0.5), (2, 41, 0.9), (2, 64, 0.2), (2, 7, 0.5)]


def _r(*names):
    return {n: F.round(n, 6) for n in names}


def seeds(spark: SparkSession, hub: DataFrame) -> DataFrame:
    fixed = spark.createDataFrame([*SEEDS, (3, 11, 0.4)], "query_id long, id long, score double")
    ends = hub.where("is_hub").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low IS NOT NULL")
    one = lambda q, c: F.struct(F.lit(q).cast("long").alias("query_id"), F.col(c).alias("id"), F.lit(1.0).alias("score"))
    return fixed.unionByName(ends.select(F.inline(F.array(one(3, "low"), one(4, "high")))))


_EDGES = """
pairs AS (SELECT DISTINCT 2 * l_orderkey AS p, 2 * l_partkey + 1 AS h FROM lineitem),
edges AS (SELECT p AS source, h AS target, 1.0::DOUBLE AS weight, 'passage' AS src_type, 'phrase' AS dst_type FROM pairs
          UNION ALL SELECT h, p, 1.0::DOUBLE, 'phrase', 'passage' FROM pairs
          UNION ALL SELECT unnest([2 * k + 1, 2 * k + 3]), unnest([2 * k + 3, 2 * k + 1]), 0.5::DOUBLE + (k % 5) / 10.0::DOUBLE, 'phrase', 'phrase'
            FROM (SELECT DISTINCT l_partkey AS k FROM lineitem) t WHERE k % 3 = 0 AND k + 1 IN (SELECT l_partkey FROM lineitem)),
nodes AS (SELECT DISTINCT source AS id, src_type AS type FROM edges),
indeg AS (SELECT target AS id, count(*) AS degree FROM edges WHERE dst_type = 'phrase' GROUP BY 1),
hub AS (SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id)
               <= greatest(1, trunc((SELECT count(*) FROM indeg) * (1.0::DOUBLE - 0.99::DOUBLE))) AS is_hub FROM indeg)
"""
_STATS = _EDGES + """,
odeg AS (SELECT source AS id, count(*) AS deg FROM edges GROUP BY 1),
dfreq AS (SELECT target AS id, count(*) AS df FROM edges WHERE src_type = 'passage' GROUP BY 1),
np AS (SELECT count(*) AS n FROM nodes WHERE type = 'passage'),
stats AS (SELECT n.id, n.type,
   CASE WHEN type = 'phrase' THEN coalesce(deg, 0) ELSE 0 END::DOUBLE AS phrase_deg,
   CASE WHEN type = 'passage' THEN coalesce(deg, 0) ELSE 0 END::DOUBLE AS passage_phrase_deg,
   CASE WHEN type = 'phrase' THEN least(8.0, greatest(0.1, ln((np.n + 1.0::DOUBLE) / (coalesce(df, 0) + 1.0::DOUBLE)) + 1)) ELSE 0 END AS idf
   FROM nodes n LEFT JOIN odeg USING (id) LEFT JOIN dfreq USING (id), np),
avgs AS (SELECT (SELECT greatest(coalesce(avg(deg), 1), 1) FROM odeg JOIN nodes USING (id) WHERE type = 'phrase') AS avg_phrase_deg,
   (SELECT greatest(coalesce(avg(deg), 1), 1) FROM odeg JOIN nodes USING (id) WHERE type = 'passage') AS avg_passage_phrase_deg)
"""
_SEEDS = "seeds AS (SELECT * FROM (VALUES " + ", ".join(f"({q}::BIGINT, {i}::BIGINT, {s}::DOUBLE)" for q, i, s in [*SEEDS, (3, 11, 0.4)]) + """) t(query_id, id, score)
  UNION ALL SELECT 3, min(id), 1.0 FROM hub WHERE is_hub UNION ALL SELECT 4, max(id), 1.0 FROM hub WHERE is_hub)"""
_EGO = _STATS + f""", {_SEEDS},
v0 AS (SELECT DISTINCT query_id, id FROM seeds),
v1 AS (SELECT * FROM v0 UNION SELECT query_id, target FROM v0 JOIN edges ON source = v0.id
       WHERE v0.id NOT IN (SELECT id FROM hub WHERE is_hub)),
v2 AS (SELECT * FROM v1 UNION SELECT query_id, target FROM v1 JOIN edges ON source = v1.id
       WHERE v1.id NOT IN (SELECT id FROM hub WHERE is_hub)),
v3 AS (SELECT * FROM v2 UNION SELECT query_id, target FROM v2 JOIN edges ON source = v2.id WHERE dst_type = 'passage'),
ego AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS r FROM v3) t WHERE r <= 10000),
sub AS (SELECT a.query_id, e.* FROM edges e JOIN ego a ON a.id = e.source JOIN ego b ON b.id = e.target AND a.query_id = b.query_id),
scored AS (SELECT s.query_id, source, target, CASE WHEN src_type = 'passage' THEN 1 WHEN dst_type = 'passage' THEN 0 ELSE 2 END AS etype,
   CASE WHEN src_type = 'passage' THEN t.idf WHEN dst_type = 'passage' THEN 2.0::DOUBLE / (1 + 0.75::DOUBLE * greatest(0, t.passage_phrase_deg / avg_passage_phrase_deg - 1))
        ELSE weight END AS score
   FROM sub s JOIN stats t ON t.id = s.target, avgs),
capped AS (SELECT query_id, source, target, etype, score FROM (
   SELECT s.*, row_number() OVER (PARTITION BY query_id, source, etype ORDER BY score DESC, target) AS r,
          CASE WHEN etype = 1 THEN 128 WHEN etype = 2 AND coalesce(is_hub, false) THEN 16 WHEN etype = 2 THEN 32
               WHEN coalesce(is_hub, false) THEN 48 ELSE 64 END AS cap
   FROM scored s LEFT JOIN hub ON hub.id = s.source) t WHERE r <= cap),
kept AS (SELECT query_id, source, target, etype, score FROM (
   SELECT c.*, row_number() OVER (PARTITION BY query_id, etype ORDER BY score DESC, source, target) AS r FROM capped c) t WHERE r <= CASE WHEN etype = 2 THEN 4000 ELSE 12000 END),
best AS (SELECT query_id, id, greatest(max(score), 1e-6) AS score FROM seeds GROUP BY 1, 2),
expd AS (SELECT *, exp(3.0 * (score - max(score) OVER (PARTITION BY query_id))) AS e FROM best),
dist0 AS (SELECT query_id, id, 0.9::DOUBLE * e / sum(e) OVER (PARTITION BY query_id) + 0.1::DOUBLE / count(*) OVER (PARTITION BY query_id) AS p FROM expd),
dist AS (SELECT query_id, id, p / sum(p) OVER (PARTITION BY query_id) AS p FROM dist0),
seedhub AS (SELECT d.query_id, d.id FROM dist d JOIN hub h ON h.id = d.id WHERE is_hub),
nonhub AS (SELECT d.* FROM dist d WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM seedhub)),
cur AS (SELECT query_id, id, p / sum(p) OVER (PARTITION BY query_id) AS p FROM nonhub
   UNION ALL SELECT e.query_id, e.id, 1.0::DOUBLE / count(*) OVER (PARTITION BY e.query_id) FROM ego e JOIN nodes n ON n.id = e.id
   WHERE type = 'passage' AND e.query_id NOT IN (SELECT query_id FROM nonhub)),
tot AS (SELECT query_id, source, sum(total) AS total, sum(n) AS n FROM (
   SELECT query_id, source, score AS total, 1 AS n FROM kept
   UNION ALL SELECT e.query_id, e.id, 0, 0 FROM ego e JOIN hub h ON h.id = e.id WHERE is_hub) t GROUP BY 1, 2),
parts AS (SELECT query_id, source, total, p, alpha, (1 - p) * alpha AS structural, (1 - p) * (1 - alpha) AS residual FROM (
   SELECT t.query_id, t.source, total,
     CASE WHEN is_hub AND phrase_deg > 0 THEN least(0.95, greatest(0, 0.8::DOUBLE * phrase_deg / (phrase_deg + avg_phrase_deg))) ELSE 0 END AS p,
     CASE WHEN is_hub AND phrase_deg > 0 THEN least(1, greatest(0, n / phrase_deg)) ELSE 1 END AS alpha
   FROM tot t JOIN stats s ON s.id = t.source LEFT JOIN hub h ON h.id = t.source, avgs) u),
jump AS (SELECT p.query_id, p.source, d.id AS target, residual * d.p / sum(d.p) OVER (PARTITION BY p.query_id, p.source) AS weight
   FROM parts p JOIN cur d USING (query_id) LEFT JOIN seedhub s ON s.query_id = p.query_id AND s.id = p.source
   WHERE residual > 0 AND (s.id IS NULL OR d.id <> p.source)),
moves AS (SELECT query_id, source, target, sum(weight) AS weight FROM (
   SELECT k.query_id, k.source, k.target, score / total * structural AS weight FROM kept k JOIN parts USING (query_id, source) WHERE score / total * structural > 0
   UNION ALL SELECT query_id, source, source, p FROM parts WHERE p > 0
   UNION ALL SELECT * FROM jump) t GROUP BY 1, 2, 3)
"""


def _graph(spark, d):
    return S.order_graph(spark, d, cut)


def _hubs(spark, d):
    nodes, edges = _graph(spark, d)
    return nodes, edges, cut(graph.hubs(edges))


def _ego(spark, d):
    nodes, edges, hub = _hubs(spark, d)
    return nodes, edges, hub, cut(graph.ego(seeds(spark, hub), edges, hub))


def _scored(spark, d):
    nodes, edges, hub, visited = _ego(spark, d)
    stats, avg = cut(graph.node_stats(nodes, edges, visited)), cut(graph.averages(edges))
    return cut(transition.typed_scores(graph.induced(visited, edges), stats, avg)), stats, avg, hub


def _plan(spark, d):
    nodes, edges, hub = _hubs(spark, d)
    return retrieve.plan(seeds(spark, hub), nodes, edges), nodes


# ---- graph -------------------------------------------------------------------

@query(f"WITH {_EDGES} SELECT * FROM edges")
def graph_edges(spark, d):
    return S.order_graph(spark, d)[1]


@query(f"""WITH {_EDGES} SELECT 'total_nodes' AS metric, count(*) AS value FROM nodes UNION ALL SELECT 'total_edges', count(*) FROM edges
UNION ALL SELECT 'total_hubs', count(*) FROM hub WHERE is_hub UNION ALL SELECT type || '_nodes', count(*) FROM nodes GROUP BY type""")
def graph_stats(spark, d):
    nodes, edges = S.order_graph(spark, d)
    return graph.integrity(nodes, edges, graph.hubs(edges))


@query(f"""WITH {_EDGES}, l AS (SELECT count(*) AS links FROM edges WHERE src_type = 'phrase' AND dst_type = 'phrase'),
p AS (SELECT count(*) AS phrases FROM nodes WHERE type = 'phrase') SELECT links, phrases, links::DOUBLE / phrases AS density FROM l, p""")
def linkage_density(spark, d):
    return graph.linkage_density(*S.order_graph(spark, d))


_EVENTS = "SELECT l_partkey AS source, l_suppkey AS target, l_quantity AS weight, l_orderkey AS o, l_linenumber AS l FROM lineitem"


def _weighted(spark, d):
    return S.read(spark, d, "lineitem").selectExpr("l_partkey source", "l_suppkey target", "l_quantity weight", "struct(l_orderkey, l_linenumber, l_quantity) seq")


@query(f"SELECT source, target, arg_min(weight, (o, l, weight)) AS weight FROM ({_EVENTS}) e GROUP BY 1, 2")
def edge_keep_first(spark, d):
    return graph.keep_first(_weighted(spark, d), "seq")


@query(f"SELECT source, target, max(weight) AS weight FROM ({_EVENTS}) e GROUP BY 1, 2")
def edge_keep_max(spark, d):
    return graph.keep_max(_weighted(spark, d))


@query(f"WITH {_EDGES} SELECT id, degree, is_hub FROM hub")
def hub_flags(spark, d):
    return graph.hubs(S.order_graph(spark, d)[1])


@query(f"WITH {_STATS} SELECT id, type, phrase_deg, passage_phrase_deg, round(idf, 6) AS idf FROM stats")
def transition_stats(spark, d):
    return graph.node_stats(*S.order_graph(spark, d)).withColumns(_r("idf"))


@query(f"WITH {_STATS} SELECT round(avg_phrase_deg, 6) AS avg_phrase_deg, round(avg_passage_phrase_deg, 6) AS avg_passage_phrase_deg FROM avgs")
def avg_degrees(spark, d):
    return graph.averages(S.order_graph(spark, d)[1]).withColumns(_r("avg_phrase_deg", "avg_passage_phrase_deg"))


@query(f"WITH {_EGO} SELECT query_id, id FROM ego")
def ego_subgraph_nodes(spark, d):
    return _ego(spark, d)[3]


@query(f"WITH {_EGO} SELECT query_id, source, target, weight FROM sub")
def ego_subgraph_edges(spark, d):
    _, edges, _, visited = _ego(spark, d)
    return graph.induced(visited, edges).select("query_id", "source", "target", "weight")


@query(f"""WITH {_EDGES}, s AS (SELECT min(id) AS id FROM hub WHERE is_hub),
v AS (SELECT id FROM s UNION SELECT target FROM edges, s WHERE source = s.id AND dst_type = 'passage') SELECT 1::BIGINT AS query_id, id FROM v""")
def ego_hub_stop(spark, d):
    """A hub seed is not expanded; only its passages are added."""
    _, edges, hub = _hubs(spark, d)
    seed = hub.where("is_hub").agg(F.min("id").alias("id")).select(F.lit(1).cast("long").alias("query_id"), "id")
    return graph.ego(seed, edges, hub, budget=1_000_000)


@query(f"""WITH {_EDGES}, pr AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS pair_id, 2 * l_partkey + 1 AS a, 2 * l_orderkey + 2 AS b FROM lineitem),
hit AS (SELECT pair_id, a FROM pr JOIN edges ON source = a AND target = b
   UNION SELECT pair_id, a FROM pr JOIN edges e ON e.source = a JOIN edges f ON f.source = b AND f.target = e.target)
SELECT pair_id, a, b, (pair_id, a) IN (SELECT (pair_id, a) FROM hit) AS connected FROM pr""")
def connectivity_pairs(spark, d):
    """Each row's part and the order after its own: a pair for each order line and part, as rows may share a line number."""
    li = S.read(spark, d, "lineitem")
    pairs = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pair_id"), (F.col("l_partkey") * 2 + 1).alias("a"), (F.col("l_orderkey") * 2 + 2).alias("b")
    ).distinct()
    return graph.connectivity(pairs, _graph(spark, d)[1]).select("pair_id", "a", "b", "connected")


def _shares(spark, d):
    """In how many shares customers and parts are dealt to each other: the fewer of them, so that all have a partner."""
    keys = lambda t, k: S.read(spark, d, t).agg(F.count_distinct(k).alias(t))
    return keys("customer", "c_custkey").crossJoin(keys("part", "p_partkey")).select(F.greatest(F.lit(1), F.least("customer", "part")).alias("m"))


def _dealt(spark, d):
    return S.read(spark, d, "part").crossJoin(F.broadcast(_shares(spark, d))).withColumn("r", F.col("p_partkey") % F.col("m"))


_SHARES = "sh AS (SELECT greatest(1, least((SELECT count(DISTINCT c_custkey) FROM customer), (SELECT count(DISTINCT p_partkey) FROM part))) AS m)"


@query(f"""WITH {_EDGES}, {_SHARES},
t AS (SELECT c_custkey AS session_id, 2 * h.p_partkey + 1 AS a, 2 * c.p_partkey + 1 AS b FROM customer, sh
   JOIN part h ON h.p_partkey % m = c_custkey % m JOIN part c ON c.p_partkey % m = c_custkey * 7 % m),
hit AS (SELECT session_id FROM t JOIN edges ON source = a AND target = b
   UNION SELECT session_id FROM t JOIN edges e ON e.source = a JOIN edges f ON f.source = b AND f.target = e.target)
SELECT c_custkey AS session_id, c_custkey IN (SELECT session_id FROM t) AND c_custkey NOT IN (SELECT session_id FROM hit) AS drift FROM customer""")
def drift_flags(spark, d):
    """Sessions over all parts: each part is in the history of a customer."""
    dealt = _dealt(spark, d).groupBy("r").agg(F.collect_set(F.col("p_partkey") * 2 + 1).alias("ids"))
    c = S.read(spark, d, "customer").select("c_custkey").crossJoin(F.broadcast(_shares(spark, d)))
    history = dealt.select(F.col("r").alias("h"), F.col("ids").alias("history"))
    current = dealt.select(F.col("r").alias("c"), F.col("ids").alias("current"))
    s = c.join(history, F.col("c_custkey") % F.col("m") == F.col("h"), "left").join(current, F.col("c_custkey") * 7 % F.col("m") == F.col("c"), "left")
    return graph.drift(s.select(F.col("c_custkey").alias("session_id"), "history", "current"), _graph(spark, d)[1])


# ---- retrieval numerics --------------------------------------------------------

@query(f"WITH {_EGO} SELECT query_id, source, target, etype, round(score, 6) AS score FROM scored")
def typed_edge_scores(spark, d):
    return _scored(spark, d)[0].withColumns(_r("score"))


#: Caps and budgets that the small subgraphs of the tables exceed: (others, hubs) by edge type.
_TIGHT, _BUDGET = {0: (4, 2), 1: (3, 3), 2: (1, 1)}, {0: 300, 1: 200, 2: 25}
_CAPPED = """tight AS (SELECT query_id, source, target, etype, score FROM (
   SELECT s.*, row_number() OVER (PARTITION BY query_id, source, etype ORDER BY score DESC, target) AS r,
          CASE etype WHEN 0 THEN CASE WHEN coalesce(is_hub, false) THEN 2 ELSE 4 END WHEN 1 THEN 3 ELSE 1 END AS cap
   FROM scored s LEFT JOIN hub ON hub.id = s.source) t WHERE r <= cap)"""


@query(f"WITH {_EGO}, {_CAPPED} SELECT query_id, source, target, etype, round(score, 6) AS score FROM tight")
def fanout_caps(spark, d):
    s, _, _, hub = _scored(spark, d)
    return transition.cap_fanout(s, hub, _TIGHT).withColumns(_r("score"))


@query(f"WITH {_EGO} SELECT query_id, source, target, etype, round(score, 6) AS score FROM kept")
def fanout_caps_usual(spark, d):
    """The usual caps and budgets."""
    s, _, _, hub = _scored(spark, d)
    return transition.type_budgets(transition.cap_fanout(s, hub)).withColumns(_r("score"))


@query(f"""WITH {_EGO} SELECT query_id, source, target, etype, round(score, 6) AS score FROM (
 SELECT c.*, row_number() OVER (PARTITION BY query_id, etype ORDER BY score DESC, source, target) AS r FROM capped c) t
 WHERE r <= CASE etype WHEN 0 THEN 300 WHEN 1 THEN 200 ELSE 25 END""")
def type_budgets(spark, d):
    s, _, _, hub = _scored(spark, d)
    return transition.type_budgets(transition.cap_fanout(s, hub), _BUDGET).withColumns(_r("score"))


@query(f"WITH {_EGO} SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS r FROM v3) t WHERE r <= 500")
def ego_node_budget(spark, d):
    _, edges, hub = _hubs(spark, d)
    return graph.ego(seeds(spark, hub), edges, hub, budget=500)


@query(f"WITH {_EGO} SELECT query_id, id, round(p, 6) AS p FROM dist")
def seed_distribution(spark, d):
    return transition.seed_distribution(seeds(spark, graph.hubs(S.order_graph(spark, d)[1]))).withColumns(_r("p"))


@query(f"WITH {_EGO} SELECT query_id, id, round(p, 9) AS p FROM cur")
def seed_hub_suppression(spark, d):
    """Queries without a seed hub, with one among others, and with a hub alone."""
    return _plan(spark, d)[0]["current"].withColumn("p", F.round("p", 9))


@query(f"WITH {_EGO} SELECT query_id, source, target, round(weight, 9) AS weight FROM moves")
def residual_transition(spark, d):
    return _plan(spark, d)[0]["moves"].withColumn("weight", F.round("weight", 9))


@query("""SELECT c_custkey, round(least(0.92, greatest(0.55, 0.85::DOUBLE - CASE WHEN (c_custkey % 11) / 10.0::DOUBLE >= 0.5 THEN 0.08 ELSE 0 END
 + CASE WHEN c_custkey % 6 >= 4 THEN 0.03 ELSE 0 END + CASE WHEN c_custkey <= 200 THEN -0.03 WHEN c_custkey >= 2000 THEN 0.02 ELSE 0 END)), 6) AS damping FROM customer""")
def damping_schedule(spark, d):
    c = F.col("c_custkey")
    return S.read(spark, d, "customer").select("c_custkey", F.round(transition.damping(0.85, (c % 11) / 10.0, c % 6, c), 6).alias("damping"))


@query(f"""WITH {_EGO}, h AS (SELECT 1::BIGINT AS query_id, 33::BIGINT AS id, 1.0::DOUBLE AS p),
u AS (SELECT query_id, id, CASE WHEN query_id = 1 THEN 0.8::DOUBLE ELSE 1 END * p AS p FROM dist UNION ALL SELECT query_id, id, 0.2::DOUBLE * p FROM h),
g AS (SELECT query_id, id, sum(p) AS p FROM u GROUP BY 1, 2) SELECT query_id, id, round(p / sum(p) OVER (PARTITION BY query_id), 6) AS p FROM g""")
def reset_vector(spark, d):
    history = spark.createDataFrame([(1, 33, 1.0)], "query_id long, id long, p double")
    dist = transition.seed_distribution(seeds(spark, graph.hubs(S.order_graph(spark, d)[1])))
    return transition.reset_vector(dist, history).withColumns(_r("p"))


#: The kernel's x after n steps is the sum of (1 - d) d^k P^k r for k < n, and d^n P^n r.
_SOLVED = """
damp AS (SELECT query_id, least(0.92, greatest(0.55, 0.85::DOUBLE - CASE WHEN hubs / s >= 0.5 THEN 0.08 ELSE 0 END + CASE WHEN s >= 4 THEN 0.03 ELSE 0 END
     + CASE WHEN n <= 200 THEN -0.03 WHEN n >= 2000 THEN 0.02 ELSE 0 END)) AS d FROM (
   SELECT query_id, count(*) AS n, coalesce(any_value(h), 0)::DOUBLE AS hubs, coalesce(any_value(c), 1) AS s FROM ego
   LEFT JOIN (SELECT query_id, count(*) AS h FROM seedhub GROUP BY 1) USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS c FROM cur GROUP BY 1) USING (query_id)
   GROUP BY 1) t),
share AS MATERIALIZED (SELECT query_id, source, target, d * weight / sum(weight) OVER (PARTITION BY query_id, source) AS w FROM moves JOIN damp USING (query_id)),
y AS (SELECT query_id, id, p AS x, 0 AS k FROM cur
   UNION ALL SELECT s.query_id, s.target, sum(x * w), any_value(k) + 1 FROM y JOIN share s ON s.query_id = y.query_id AND s.source = y.id WHERE k < 100 GROUP BY 1, 2),
solved AS (SELECT query_id, id, sum(CASE WHEN k < 100 THEN (1 - d) * x ELSE x END) AS score FROM y JOIN damp USING (query_id) GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_EGO}, {_SOLVED} SELECT query_id, id, round(score, 6) AS score FROM solved JOIN nodes USING (id) WHERE type = 'passage'")
def ppr_scores(spark, d):
    """All passages that the solver reaches, by the operator's own iterations."""
    p, nodes = _plan(spark, d)
    found = ppr.ppr(p["moves"], p["reset"], p["damping"])
    found = cut(found.where("score > 0"))
    return found.join(S.passage_ids(graph.among(nodes, found)), "id", "left_semi").withColumns(_r("score"))


@query(f"""WITH RECURSIVE {_EGO}, {_SOLVED} SELECT query_id, id, round(score, 6) AS score, r::INT AS ppr_rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, id) AS r FROM solved JOIN nodes USING (id) WHERE type = 'passage') t WHERE r <= 10""")
def search_end_to_end(spark, d):
    nodes, edges, hub = _hubs(spark, d)
    return retrieve.search(seeds(spark, hub), nodes, edges).withColumns(_r("score"))


# ---- vectors -------------------------------------------------------------------

_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings)"
_KNN = f"""{_V}, dd AS (SELECT a.id AS query_id, b.id, list_distance(a.e, b.e) AS distance FROM v a, v b),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dd)"""


def _vectors(spark, d):
    return S.read(spark, d, "embeddings").selectExpr("vec_id id", "embedding")


@query(f"WITH {_KNN} SELECT query_id, id, round(distance, 6) AS distance, rank::INT AS rank FROM nn WHERE rank <= 5")
def knn_l2(spark, d):
    v = _vectors(spark, d)
    return vectors.knn(v.withColumnRenamed("id", "query_id"), v).withColumns(_r("distance"))


@query(f"""WITH {_KNN}, h AS (SELECT query_id, id FROM nn WHERE rank <= 5 AND query_id <> id AND distance < 1.15)
SELECT query_id AS source, id AS target, 1.0::DOUBLE AS weight FROM h UNION SELECT id, query_id, 1.0 FROM h""")
def synonym_links(spark, d):
    v = _vectors(spark, d)
    return vectors.synonym_links(v, v, max_distance=1.15)


@query(f"""WITH {_V}, c AS (SELECT a.id AS query_id, b.id, list_cosine_similarity(a.e, b.e) AS s FROM v a, v b WHERE a.id % 50 = 0 AND a.id <> b.id)
SELECT query_id, arg_max(id, (s, -id)) AS id, round(max(s), 6) AS cosine FROM c GROUP BY 1""")
def cosine_top1(spark, d):
    """Every vector whose id is divisible by 50 against all others, in blocks."""
    v = _vectors(spark, d)
    q = v.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    return vectors.cosine_top1(q, v).withColumns(_r("cosine"))


@query("SELECT vec_id AS id, round(1 / (1 + sqrt(list_sum([x * x for x in embedding::DOUBLE[]]))), 6) AS sim FROM embeddings")
def seed_similarity(spark, d):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return _vectors(spark, d).select("id", F.round(vectors.similarity(F.sqrt(total)), 6).alias("sim"))


# ---- text ----------------------------------------------------------------------

@query(r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
c AS (SELECT doc_id, i, word, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM e),
nxt AS MATERIALIZED (SELECT a.doc_id, a.i, min(b.i) AS stop FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 256 AND b.upto >= a.upto - length(a.word) - 1 + 512 GROUP BY 1, 2),
r AS (SELECT doc_id, 1::BIGINT AS first, 0 AS k FROM w WHERE len(ws) > 0
      UNION ALL SELECT r.doc_id, n.stop + 1, k + 1 FROM r JOIN nxt n ON n.doc_id = r.doc_id AND n.i = r.first WHERE n.stop + 1 <= (SELECT len(ws) FROM w WHERE w.doc_id = r.doc_id)),
b AS (SELECT doc_id, first, k, coalesce(lead(first) OVER (PARTITION BY doc_id ORDER BY k) - 1, 1000000000) AS last FROM r)
SELECT b.doc_id, k::INT AS chunk_idx, length(string_agg(word, ' ' ORDER BY i))::BIGINT AS n_chars, md5(string_agg(word, ' ' ORDER BY i)) AS digest
FROM b JOIN e ON e.doc_id = b.doc_id AND e.i BETWEEN b.first AND b.last GROUP BY 1, 2""")
def chunks(spark, d):
    p = S.passages(S.read(spark, d, "documents"))
    return p.select("doc_id", "chunk_idx", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("digest"))


@query(r"""SELECT c_custkey, trim(lower(regexp_replace('  ' || c_name || chr(9) || ' X' || chr(1), '[\x00-\x20\x7f]+', ' ', 'g'))) AS norm FROM customer""")
def normalize_ascii(spark, d):
    raw = F.concat(F.lit("  "), F.col("c_name"), F.lit("\t X\x01"))
    return S.read(spark, d, "customer").select("c_custkey", X.normalize_text(raw).alias("norm"))


@query("""WITH k AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'u' || user_id || ':' || event_type || ':x' END AS key FROM events)
SELECT event_id, CASE WHEN contains(key, ':') THEN split_part(key, ':', 1) ELSE 'global' END AS scope,
 CASE WHEN contains(key, ':') THEN substr(key, strpos(key, ':') + 1) ELSE key END AS name FROM k""")
def split_mem_key(spark, d):
    key = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(":"), "event_type", F.lit(":x")))
    scope, name = X.split_key(key)
    return S.read(spark, d, "events").select("event_id", scope.alias("scope"), name.alias("name"))


@query("""WITH k AS (SELECT DISTINCT user_id, event_type || '.' || (event_id % 3) || '/x_y' AS key FROM events)
SELECT user_id, count(*) AS keys, count(DISTINCT split_part(key, '.', 1)) AS prefixes FROM k GROUP BY 1""")
def known_keys(spark, d):
    e = S.read(spark, d, "events")
    key = F.concat("event_type", F.lit("."), (F.col("event_id") % 3).cast("string"), F.lit("/x_y"))
    k = e.select("user_id", key.alias("key")).distinct()
    return k.groupBy("user_id").agg(F.count("*").alias("keys"), F.count_distinct(X.key_prefix(F.col("key"))).alias("prefixes"))


@query("SELECT p_partkey, length(p_name) BETWEEN 2 AND 64 AND regexp_matches(p_name, '\\p{L}') AS ok, length(p_name) >= 4 AS substr_ok FROM part")
def phrase_candidates(spark, d):
    return S.read(spark, d, "part").select("p_partkey", X.is_phrase(F.col("p_name")).alias("ok"), X.supports_substring(F.col("p_name")).alias("substr_ok"))


# ---- memory --------------------------------------------------------------------

_LOG = """lg AS (SELECT 'u' || user_id || ':' || event_type AS mem_key, event_type, event_id AS seq, floor(epoch(ts))::BIGINT AS ts, event_id AS i,
 CASE WHEN event_id % 17 = 0 THEN 'delete' WHEN event_id % 5 = 3 THEN 'update' ELSE 'create' END AS action,
 CASE WHEN event_id % 7 <> 0 THEN CASE event_type WHEN 'purchase' THEN 'fact' WHEN 'view' THEN 'preference' WHEN 'click' THEN 'task' ELSE 'other' END END AS kind,
 CASE WHEN event_id % 6 <> 0 THEN event_type || '-' || (event_id % 11) END AS value FROM events),
sg AS (SELECT *, coalesce(sum(CASE WHEN action = 'delete' THEN 1 END) OVER (PARTITION BY mem_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life,
 CASE WHEN action = 'update' THEN CASE WHEN i % 4 = 0 THEN (i % 90) / 90.0::DOUBLE WHEN i % 3 = 0 THEN (i % 100) / 100.0::DOUBLE END
      WHEN action = 'create' THEN (i % 100) / 100.0::DOUBLE END AS tr,
 CASE WHEN action = 'update' THEN CASE WHEN i % 4 = 1 THEN (i % 60) / 60.0::DOUBLE WHEN i % 3 = 1 THEN (i % 70) / 70.0::DOUBLE END
      WHEN action = 'create' THEN (i % 70) / 70.0::DOUBLE END AS st FROM lg),
op AS (SELECT *, min(CASE WHEN action = 'create' THEN seq END) OVER (PARTITION BY mem_key, life) AS opened FROM sg),
mem AS (SELECT mem_key, life::BIGINT AS life, CASE WHEN bool_or(action = 'delete') THEN 'deleted' ELSE 'active' END AS status,
  (arg_max({'v': kind}, seq) FILTER (WHERE seq = opened OR (action = 'create' AND kind IS NOT NULL) OR (action = 'update' AND i % 2 = 0))).v AS kind,
  greatest(0.05, arg_max(tr, seq) FILTER (WHERE tr IS NOT NULL)) AS trust, greatest(0.01, arg_max(st, seq) FILTER (WHERE st IS NOT NULL)) AS strength,
  coalesce(arg_max(value, seq) FILTER (WHERE action <> 'delete' AND value IS NOT NULL), any_value(event_type)) AS value,
  arg_max(ts, seq) AS updated_at, arg_min(ts, seq) AS last_seen, split_part(mem_key, ':', 1) AS scope
  FROM op WHERE seq >= opened GROUP BY 1, 2)"""
_EFF = f"""greatest(0.01, strength * exp(-greatest(0, {NOW} - last_seen) / (86400.0::DOUBLE * CASE kind WHEN 'fact' THEN 30 WHEN 'preference' THEN 14 WHEN 'task' THEN 7 ELSE 21 END)))"""


def _memories(spark, d):
    return memory.fold(S.memory_log(spark, d))


@query(f"WITH {_LOG} SELECT mem_key, life, status, coalesce(kind, '-') AS kind, value, scope, round(trust, 6) AS trust, round(strength, 6) AS strength, updated_at, last_seen FROM mem")
def memory_upsert_state(spark, d):
    """Creates, converging creates, updates, deletes and creates after a delete."""
    return _memories(spark, d).withColumns(_r("trust", "strength")).select(
        "mem_key", F.col("life").cast("long").alias("life"), "status", F.coalesce("kind", F.lit("-")).alias("kind"), "value", "scope", "trust", "strength", "updated_at", "last_seen"
    )


@query(f"""WITH {_LOG} SELECT mem_key, seq, CASE WHEN action <> 'create' AND NOT coalesce(seq > opened, false) THEN 'noop' WHEN action = 'update' THEN 'updated'
 WHEN action = 'delete' THEN 'deleted' WHEN seq > opened THEN 'updated' ELSE 'created' END AS status,
 coalesce(CASE WHEN action <> 'create' AND NOT coalesce(seq > opened, false) THEN 'target_not_active' WHEN action = 'create' AND seq > opened THEN 'create_conflict_converged' END, '-') AS reason FROM op""")
def memory_outcomes(spark, d):
    return memory.outcomes(S.memory_log(spark, d)).withColumn("reason", F.coalesce("reason", F.lit("-")))


@query(f"""WITH {_LOG}, f AS (SELECT * FROM mem WHERE status = 'active' ORDER BY updated_at DESC, mem_key LIMIT 160),
s AS (SELECT *, {_EFF} AS strength_eff FROM f WHERE trust >= 0.2) SELECT mem_key, round(strength_eff, 6) AS strength_eff FROM s
ORDER BY s.strength_eff DESC, trust DESC, updated_at DESC, mem_key LIMIT 20""")
def memory_query(spark, d):
    return memory.query(_memories(spark, d), NOW, 20, min_trust=0.2).select("mem_key", F.round("strength_eff", 6).alias("strength_eff"))


@query(f"""WITH {_LOG} SELECT mem_key, life, round(CASE WHEN status = 'active' AND mem_key LIKE '%click' THEN least(1, {_EFF} + 0.1) ELSE strength END, 6) AS strength,
CASE WHEN status = 'active' AND mem_key LIKE '%click' THEN {NOW} ELSE last_seen END AS last_seen FROM mem""")
def memory_mark_used(spark, d):
    m = _memories(spark, d)
    keys = S.memory_log(spark, d).where("mem_key LIKE '%click'").select("mem_key")
    return memory.mark_used(m, keys, NOW).select("mem_key", F.col("life").cast("long").alias("life"), F.round("strength", 6).alias("strength"), "last_seen")


@query(f"""WITH {_LOG} SELECT mem_key, life, CASE WHEN status = 'active' AND mem_key LIKE '%view' THEN {NOW}::BIGINT ELSE -1 END AS last_retrieved FROM mem""")
def memory_mark_retrieved(spark, d):
    keys = S.memory_log(spark, d).where("mem_key LIKE '%view'").select("mem_key")
    return memory.mark_retrieved(_memories(spark, d), keys, NOW).select("mem_key", F.col("life").cast("long").alias("life"), F.coalesce("last_retrieved", F.lit(-1)).alias("last_retrieved"))


@query(f"""WITH {_LOG} SELECT mem_key, life, coalesce(status = 'active' AND {NOW} - last_seen >= 86400 * CASE kind WHEN 'fact' THEN 30 WHEN 'task' THEN 7 ELSE 14 END, false) AS purged FROM mem""")
def memory_purge(spark, d):
    return memory.purge(_memories(spark, d), NOW).select("mem_key", F.col("life").cast("long").alias("life"), "purged")


@query("""WITH e AS (SELECT event_id, ['create','update','delete','noop','merge'][(event_id % 5 + 1)::INT] AS a, event_id % 7 AS s, event_id % 3 AS t FROM events)
SELECT event_id, CASE WHEN a = 'merge' THEN 'unsupported_action' WHEN a = 'noop' THEN NULL WHEN s = 0 THEN 'missing_key'
 WHEN a = 'create' AND s = 1 THEN 'missing_init_values' WHEN a IN ('update', 'delete') AND s = 2 THEN 'candidate_missing_node_id'
 WHEN a IN ('update', 'delete') AND t = 2 THEN 'target_not_in_candidates' WHEN a IN ('update', 'delete') AND s = 3 THEN 'empty_affected_keys'
 WHEN a = 'update' AND s = 4 THEN 'immutable_scope_violation' WHEN a = 'update' AND s = 5 THEN 'immutable_key_violation' END AS reason FROM e""")
def decision_validation(spark, d):
    e, s, t = S.read(spark, d, "events"), F.col("event_id") % 7, F.col("event_id") % 3
    action = F.element_at(F.array(*map(F.lit, ("create", "update", "delete", "noop", "merge"))), (F.col("event_id") % 5 + 1).cast("int"))
    reason = memory.validate(
        action, F.when(s != 0, "k"), F.lit("fact"), F.when(s != 1, "v"), F.when(s != 2, t), F.when(s != 3, F.array(F.lit("k"))).otherwise(F.array().cast("array<string>")),
        F.array(F.lit(0), F.lit(1)).cast("array<bigint>"), F.when(s == 5, "other").otherwise("k"), F.when(s == 4, "a").otherwise("b"), F.lit("b"),
    )
    return e.select("event_id", reason.alias("reason"))


@query("WITH " + _SHARES + """, ph AS (SELECT p_partkey AS id, p_name AS name, p_partkey % 50 = 0 AS is_hub FROM part),
t AS (SELECT DISTINCT c_custkey AS node_id, CASE WHEN c_custkey % 3 = 0 THEN trim(lower(p_name)) ELSE trim(lower(substr(p_name, 1, 5))) END AS term FROM sh, customer JOIN part ON p_partkey % m = c_custkey % m),
u AS (SELECT * FROM t WHERE length(term) BETWEEN 2 AND 64 AND regexp_matches(term, '\\p{L}'))
SELECT node_id, term, coalesce((SELECT min(id) FROM ph WHERE lower(name) = term),
 CASE WHEN length(term) >= 4 THEN (SELECT arg_min(id, (length(name), id)) FROM ph WHERE is_hub AND contains(lower(name), term)) END, -1) AS phrase_id FROM u""")
def entity_links(spark, d):
    """Terms of all parts, each dealt to a customer."""
    part = S.read(spark, d, "part")
    c = S.read(spark, d, "customer").crossJoin(F.broadcast(_shares(spark, d)))
    terms = c.join(_dealt(spark, d).drop("m"), F.col("r") == F.col("c_custkey") % F.col("m")).select(
        F.col("c_custkey").alias("node_id"), F.when(F.col("c_custkey") % 3 == 0, F.col("p_name")).otherwise(F.substring("p_name", 1, 5)).alias("term")
    )
    found = memory.link_entities(terms, part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 50 == 0).alias("is_hub")))
    return found.withColumn("phrase_id", F.coalesce("phrase_id", F.lit(-1)))


# ---- fusion --------------------------------------------------------------------

_CANDS = """c AS (SELECT l_orderkey AS query_id, l_partkey AS passage_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS ppr_rank,
 CASE WHEN l_partkey % 13 = 0 THEN 'nan'::DOUBLE ELSE ((l_partkey * 31 + l_orderkey * 7) % 101) / 10.0::DOUBLE - 5 END AS logit FROM lineitem),
dd AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY query_id, passage_id ORDER BY ppr_rank) AS r FROM c) t WHERE r = 1),
p AS (SELECT *, NOT isnan(logit) AS ok FROM dd)"""


def _candidates(spark, d):
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    logit = F.when(F.col("l_partkey") % 13 == 0, F.lit(float("nan"))).otherwise(((F.col("l_partkey") * 31 + F.col("l_orderkey") * 7) % 101) / 10.0 - 5)
    rows = fusion.dealt(S.read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), "l_orderkey")
    return rows.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("passage_id"), rank.alias("ppr_rank"), logit.alias("logit"))


@query(f"WITH {_CANDS} SELECT query_id, passage_id, ppr_rank::INT AS ppr_rank FROM dd")
def candidate_dedup(spark, d):
    return fusion.dedup(_candidates(spark, d)).drop("logit")


@query(f"""WITH {_CANDS}, m AS (SELECT *, avg(CASE WHEN ok THEN logit END) OVER w AS mu, stddev_pop(CASE WHEN ok THEN logit END) OVER w AS sd FROM p WINDOW w AS (PARTITION BY query_id)),
z AS (SELECT *, CASE WHEN ok THEN greatest(-2.0, least(2.0, CASE WHEN sd > 1e-6 THEN (logit - mu) / sd ELSE logit END)) END AS x FROM m)
SELECT query_id, passage_id, CASE WHEN ok THEN round(1 / (1 + exp(-x)), 6) END AS rerank_score, ok AS rerank_valid FROM z""")
def logit_postprocess(spark, d):
    out = fusion.postprocess(fusion.dedup(_candidates(spark, d)), zscore=True, clip=2.0, squash=True)
    score = F.when(F.col("rerank_valid"), F.round("rerank_score", 6))
    return out.select("query_id", "passage_id", score.alias("rerank_score"), "rerank_valid")


@query(f"""WITH {_CANDS}, s AS (SELECT *, CASE WHEN count(*) OVER w <= 1 THEN 1.0 ELSE 1.0::DOUBLE - (row_number() OVER (PARTITION BY query_id ORDER BY ppr_rank, passage_id) - 1) / (count(*) OVER w - 1)::DOUBLE END AS place,
 min(CASE WHEN ok THEN logit END) OVER w AS lo, max(CASE WHEN ok THEN logit END) OVER w AS hi FROM p WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT *, CASE WHEN ok THEN 0.7::DOUBLE * place + 0.3::DOUBLE * CASE WHEN hi - lo < 1e-9 THEN 1 ELSE (logit - lo) / (hi - lo) END END AS fused FROM s)
SELECT query_id, passage_id, round(fused, 9) AS fused FROM f""")
def fusion_weighted_sum(spark, d):
    out = fusion.weighted_sum(fusion.postprocess(fusion.dedup(_candidates(spark, d))))
    return out.select("query_id", "passage_id", F.when(F.col("rerank_valid"), F.round("fused", 9)).alias("fused"))


@query(f"""WITH {_CANDS}, s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ok DESC, CASE WHEN ok THEN logit END DESC, ppr_rank, passage_id) AS rr FROM p)
SELECT query_id, passage_id, CASE WHEN ok THEN round(0.7::DOUBLE / (60 + ppr_rank) + 0.3::DOUBLE / (60 + rr), 9) END AS fused, rr::INT AS rerank_rank FROM s""")
def fusion_rrf(spark, d):
    out = fusion.reciprocal_ranks(fusion.postprocess(fusion.dedup(_candidates(spark, d))))
    return out.select("query_id", "passage_id", F.when(F.col("rerank_valid"), F.round("fused", 9)).alias("fused"), "rerank_rank")


# ---- sessions and evaluation -----------------------------------------------------

def _turns(spark, d):
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Z][a-z]{3,})"), F.lit(1)))
    return S.read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "turn", found.alias("entities"))


_T = r"t AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, list_distinct(regexp_extract_all(text, '([A-Z][a-z]{3,})', 1)) AS e FROM conversations)"


@query(f"WITH {_T} SELECT session_id, max(turn) AS turn, len(arg_max(e, turn)) AS n FROM t GROUP BY 1")
def session_context(spark, d):
    return sessions.latest_context(_turns(spark, d)).select("session_id", "turn", F.size("entities").cast("long").alias("n"))


@query(f"""WITH {_T} SELECT session_id, turn, coalesce(last_value(CASE WHEN len(e) > 0 THEN len(e) END IGNORE NULLS) OVER
 (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM t""")
def session_history(spark, d):
    return sessions.with_history(_turns(spark, d)).select("session_id", "turn", F.size("history").cast("long").alias("n"))


@query("""SELECT item_id, doc_id, CASE WHEN contains(d.text, b.text) OR contains(b.text, d.text) THEN 1.0::DOUBLE ELSE 0 END AS recall,
 contains(d.text, substr(b.text, 1, 30)) AS prefix_hit FROM benchmark b, documents d""")
def raw_recall(spark, d):
    """Every document against every item, a stated query set."""
    b, docs = S.read(spark, d, "benchmark"), S.read(spark, d, "documents")
    j = docs.select("doc_id", F.col("text").alias("result")).crossJoin(b.select("item_id", "text"))
    return j.select("item_id", "doc_id", evaluate.raw_hit(F.col("result"), F.col("text")).alias("recall"), evaluate.prefix_hit(F.col("result"), F.col("text")).alias("prefix_hit"))


@query(r"""SELECT doc_id, round(exp(-0.5 * (len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) / 5.0::DOUBLE) / 1500), 6) AS adaptive,
 round(1.0::DOUBLE - (length(substr(text, 1, 400)) / 4.0::DOUBLE) / (length(text) / 4.0::DOUBLE), 6) AS compression FROM documents WHERE length(text) > 0""")
def adaptive_recall(spark, d):
    t = F.col("text")
    return S.read(spark, d, "documents").where("length(text) > 0").select(
        "doc_id", F.round(evaluate.adaptive(F.lit(1.0), t), 6).alias("adaptive"), F.round(evaluate.compression(F.substring(t, 1, 400), t), 6).alias("compression")
    )


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, (SELECT any_value(b.embedding::DOUBLE[]) FROM embeddings b WHERE b.vec_id = a.vec_id + 1) AS n FROM embeddings a)
SELECT vec_id, round(1.0::DOUBLE - greatest(0, coalesce(list_cosine_similarity(e, n), 0)), 6) AS control FROM v""")
def drift_control(spark, d):
    v = S.read(spark, d, "embeddings")
    # the next vector by a join of neighbours in the order of ids, not by a window over all of them
    v = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("n")), "vec_id", "left")
    topics = F.when(F.col("n").isNull(), F.array().cast("array<array<float>>")).otherwise(F.array("n"))
    return v.select("vec_id", F.round(evaluate.drift_control(F.col("embedding"), topics), 6).alias("control"))


# ---- streams --------------------------------------------------------------------

def _stream(spark, d, name, pick):
    import tempfile

    schema = S.read(spark, d, name).schema
    # a stream cannot start from the path of one file, but from a pattern that fits it alone
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    s = spark.readStream.schema(schema).parquet(f"{d}/{name}.parque{'t' if folder else '[t]'}")
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or tempfile.mkdtemp()
    from uuid import uuid4

    return pick(s), f"{base}/stream-{uuid4().hex}"


@query(f"""WITH {_T} SELECT session_id, len(arg_max(e, turn)) AS n FROM t GROUP BY 1""")
def streaming_sessions(spark, d):
    def pick(s):
        found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Z][a-z]{3,})"), F.lit(1)))
        return state.session_contexts(s.select(F.col("conv_id").cast("string").alias("session_id"), "turn", found.alias("entities")))

    stream, at = _stream(spark, d, "conversations", pick)
    return state.drain(stream, "session_id", at).select("session_id", F.size("entities").cast("long").alias("n"))
