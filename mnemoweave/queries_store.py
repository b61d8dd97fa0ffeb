"""Queries of ingest, lookups, reranking, model-free kernels and memory writes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as X
from .operators import evaluate, fusion, graph, memory, sessions, transition, vectors
from .plans import retrieve
from .queries import _CANDS, _EDGES, _LOG, _STATS, NOW, _candidates, _memories, _r
from .registry import query
from .sources import tables as S

# ---- ingest and lookups ------------------------------------------------------------

_CAPS = r"unnest(list_distinct(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]{3,}'))))"


def _small(spark, d) -> DataFrame:
    """Documents of one chunk each: a conversation's turn."""
    c = S.read(spark, d, "conversations").where("text IS NOT NULL")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.substring("text", 1, 400).alias("text"))


@query(rf"""WITH t AS (SELECT conv_id * 1000 + turn AS doc_id, substr(text, 1, 400) AS text FROM conversations WHERE text IS NOT NULL),
p AS (SELECT DISTINCT doc_id, {_CAPS} AS name FROM (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), ' ') AS text FROM t) q WHERE text <> '')
SELECT name, count(*) AS passages FROM p GROUP BY 1""")
def ingest_phrases(spark, d):
    """Two ingests, the second onto the first: the passages of each phrase, named by its exact text."""
    docs = _small(spark, d)
    nodes, edges = S.ingest(docs.where("doc_id % 2 = 0"))
    nodes, edges = S.ingest(docs.where("doc_id % 2 = 1"), nodes, edges)
    n = edges.where("dst_type = 'phrase'").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("passages"))
    return nodes.where("type = 'phrase'").join(n, "id").select("name", "passages")


@query(r"""WITH t AS (SELECT conv_id * 1000 + turn AS doc_id, array_to_string(list_filter(regexp_split_to_array(substr(text, 1, 400), '\s+'), lambda x: x <> ''), ' ') AS text
 FROM conversations WHERE text IS NOT NULL) SELECT 'p_batch_' || doc_id || '_0' AS name, md5(text) AS digest FROM t WHERE text <> ''""")
def ingest_passages(spark, d):
    nodes, _ = S.ingest(_small(spark, d))
    return nodes.where("type = 'passage'").select("name", F.md5("content").alias("digest"))


@query(f"WITH {_EDGES} SELECT id FROM nodes WHERE type = 'passage'")
def passage_ids(spark, d):
    return S.passage_ids(S.order_graph(spark, d)[0])


def _part_nodes(spark, d) -> DataFrame:
    return S.read(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 0, "passage").otherwise("phrase").alias("type"), F.col("p_name").alias("name"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("content"),
    )


@query("SELECT p_name AS name, min(p_partkey) AS id FROM part WHERE p_partkey % 4 <> 0 AND p_name IN (SELECT p_name FROM part WHERE p_partkey % 5 = 0) GROUP BY 1")
def node_by_name(spark, d):
    n = _part_nodes(spark, d)
    return S.node_by_name(n, n.where("id % 5 = 0"))


@query("""SELECT c_custkey AS query_id, min(p_partkey) AS id, 1.0::DOUBLE AS score FROM customer JOIN part n ON n.p_partkey = c_custkey
 JOIN (SELECT p_name AS name, min(p_partkey) AS p_partkey FROM part WHERE p_partkey % 4 <> 0 GROUP BY 1) f ON f.name = n.p_name GROUP BY 1""".replace("min(p_partkey) AS id", "min(f.p_partkey) AS id"))
def seeds_by_name(spark, d):
    n = _part_nodes(spark, d)
    names = S.read(spark, d, "customer").join(n, F.col("c_custkey") == F.col("id")).select(F.col("c_custkey").alias("query_id"), "name")
    return retrieve.seeds_by_name(names, n)


_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings)"


@query(f"""WITH {_V}, dd AS (SELECT a.id AS query_id, b.id, list_distance(a.e, b.e) AS distance FROM v a, v b WHERE a.id % 50 = 0),
nn AS (SELECT query_id, id, 1 / (1 + distance) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS r FROM dd) t WHERE r <= 5),
u AS (SELECT * FROM nn UNION ALL SELECT id, id + 1, 1.0 FROM v WHERE id % 50 = 0 UNION ALL SELECT id, id, 0.25 FROM v WHERE id % 50 = 0)
SELECT query_id, id, round(max(score), 6) AS score FROM u GROUP BY 1, 2""")
def seeds_merged(spark, d):
    """Seeds by name and by the vector of each query whose id is divisible by 50: the best score of each."""
    v = S.read(spark, d, "embeddings").selectExpr("vec_id id", "embedding")
    asked = v.where("id % 50 = 0")
    near = vectors.knn(asked.withColumnRenamed("id", "query_id"), v)
    named = asked.select(F.col("id").alias("query_id"), (F.col("id") + 1).alias("id"), F.lit(1.0).alias("score"))
    weak = asked.select(F.col("id").alias("query_id"), "id", F.lit(0.25).alias("score"))
    return retrieve.merge_seeds(retrieve.seeds_by_distance(near), named, weak).withColumns(_r("score"))


@query("""SELECT p_partkey AS query_id, p_partkey + 1 AS id, p_partkey % 7 AS ppr_rank, coalesce((SELECT CASE WHEN q.p_partkey % 3 <> 0 THEN q.p_name END FROM part q
 WHERE q.p_partkey = p.p_partkey + 1), '') AS text FROM part p""")
def candidate_contents(spark, d):
    n = _part_nodes(spark, d)
    return retrieve.contents(n.select(F.col("id").alias("query_id"), (F.col("id") + 1).alias("id"), (F.col("id") % 7).alias("ppr_rank")), n)


@query("SELECT vec_id AS id, p_name AS name FROM embeddings JOIN part ON p_partkey = vec_id WHERE p_partkey % 4 = 0 AND embedding IS NOT NULL")
def passage_dump(spark, d):
    v = S.read(spark, d, "embeddings").selectExpr("vec_id id", "embedding")
    return S.passage_dump(_part_nodes(spark, d), v).select("id", "name")


@query(f"""WITH {_STATS} SELECT p_partkey AS id, coalesce(phrase_deg, 1.0) AS phrase_deg, coalesce(passage_phrase_deg, 1.0) AS passage_phrase_deg,
 round(coalesce(idf, CASE WHEN p_partkey % 4 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS idf FROM part LEFT JOIN stats ON stats.id = p_partkey AND p_partkey % 2 = 1""")
def default_stats(spark, d):
    """Nodes that the statistics lack get the defaults."""
    stats = graph.node_stats(*S.order_graph(spark, d)).where("id % 2 = 1")
    return transition.default_stats(_part_nodes(spark, d), stats).select("id", "phrase_deg", "passage_phrase_deg", F.round("idf", 6).alias("idf"))


@query(f"WITH {_EDGES} SELECT id FROM nodes WHERE type = 'phrase' ORDER BY id DESC LIMIT 10")
def newest_phrases(spark, d):
    return S.order_graph(spark, d)[0].where("type = 'phrase'").orderBy(F.desc("id")).limit(10).select("id")


@query("""SELECT c_custkey AS query_id, '--- [Score: ' || printf('%.4f', c_custkey / 7.0) || ' ] ---' AS head, 'text ' || c_name || chr(10) || 'more' AS first FROM customer""".replace("|| ' ] ---'", "|| '] ---'"))
def formatted_results(spark, d):
    """A result's text and what the parser reads back from it."""
    c = S.read(spark, d, "customer").select(
        F.col("c_custkey").alias("query_id"), (F.col("c_custkey") / 7.0).alias("score"), F.concat(F.lit("text "), "c_name", F.lit("\nmore")).alias("text")
    )
    rows = c.withColumn("ppr_rank", F.lit(1)).unionByName(c.withColumns({"ppr_rank": F.lit(2), "text": F.lit("second")})).unionByName(c.withColumns({"ppr_rank": F.lit(0), "text": F.lit("")}))
    out = retrieve.format_results(rows)
    return out.select("query_id", F.substring_index("result", "\n", 1).alias("head"), retrieve.first_passage(F.col("result")).alias("first"))


# ---- reranking ----------------------------------------------------------------------

_LOGITS = f"""{_CANDS}, sl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ppr_rank, passage_id) AS place FROM dd),
ok AS (SELECT *, bool_and(CASE WHEN place <= 4 THEN passage_id % 29 <> 0 END) OVER (PARTITION BY query_id) AS whole FROM sl),
top AS (SELECT *, NOT isnan(logit) AS valid FROM ok WHERE place <= 4 AND whole)"""


def _scores(spark, d):
    """The model's scores; a passage divisible by 29 has none."""
    return _candidates(spark, d).where("passage_id % 29 <> 0").select("query_id", "passage_id", "logit")


def _ranked(spark, d):
    return _candidates(spark, d).drop("logit").withColumn("ppr_score", 1.0 / F.col("ppr_rank"))


@query(f"""WITH {_LOGITS},
s AS (SELECT *, CASE WHEN count(*) OVER w <= 1 THEN 1.0 ELSE 1.0::DOUBLE - (place - 1) / (count(*) OVER w - 1)::DOUBLE END AS ps,
  min(CASE WHEN valid THEN logit END) OVER w AS lo, max(CASE WHEN valid THEN logit END) OVER w AS hi FROM top WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, passage_id, ppr_rank, valid, CASE WHEN valid THEN 0.7::DOUBLE * ps + 0.3::DOUBLE * CASE WHEN hi - lo < 1e-9 THEN 1 ELSE (logit - lo) / (hi - lo) END END AS fused FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY valid DESC, fused DESC NULLS LAST, ppr_rank, passage_id) AS final_rank FROM f)
SELECT query_id, passage_id, final_rank::INT AS final_rank FROM (SELECT query_id, passage_id, final_rank FROM r
 UNION ALL SELECT query_id, passage_id, place FROM ok WHERE place > 4 OR NOT whole) t WHERE final_rank <= 4""")
def rerank_weighted(spark, d):
    """Four of each query's candidates are fused; queries that lack a score keep their order."""
    return _fused(spark, d)


def _fused(spark, d, **more):
    out = fusion.rerank_and_fuse(_ranked(spark, d), _scores(spark, d), top_k=4, asked=4, **more)
    return out.select("query_id", "passage_id", F.col("final_rank").cast("int").alias("final_rank"))


@query(f"""WITH {_LOGITS},
s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY valid DESC, CASE WHEN valid THEN logit END DESC NULLS LAST, ppr_rank, passage_id) AS rr FROM top),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY valid DESC, CASE WHEN valid THEN 0.7::DOUBLE / (60 + ppr_rank) + 0.3::DOUBLE / (60 + rr) END DESC NULLS LAST, ppr_rank, rr, passage_id) AS final_rank FROM s)
SELECT query_id, passage_id, final_rank::INT AS final_rank FROM (SELECT query_id, passage_id, final_rank FROM r
 UNION ALL SELECT query_id, passage_id, place FROM ok WHERE place > 4 OR NOT whole) t WHERE final_rank <= 4""")
def rerank_rrf(spark, d):
    return _fused(spark, d, method="rrf")


@query(f"""WITH {_LOGITS} SELECT query_id, passage_id, place::INT AS final_rank FROM sl WHERE place <= 3""")
def rerank_off(spark, d):
    """Weights without a sum: the queries' own order, cut."""
    out = fusion.rerank_and_fuse(_ranked(spark, d), _scores(spark, d), top_k=3, w_ppr=0.0, w_rerank=0.0)
    return out.select("query_id", "passage_id", F.col("final_rank").cast("int").alias("final_rank"))


@query("""SELECT p_partkey AS query_id, p_partkey * 2 AS passage_id, round(len(list_intersect(a, b)) / len(a)::DOUBLE, 6) AS logit FROM (
 SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_name || ' x ' || p_type), ' ')) AS b FROM part
 WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')), list_distinct(string_split(lower(p_type), ' ')) FROM part WHERE p_partkey % 3 = 0) t""")
def pair_scores(spark, d):
    """Pairs scored through the batch interface, by a scorer that needs no model."""
    t = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.concat("p_name", F.lit(" x "), "p_type"))
    pairs = S.read(spark, d, "part").select(F.col("p_partkey").alias("query_id"), (F.col("p_partkey") * 2).alias("passage_id"), F.col("p_name").alias("query"), t.alias("text"))
    return fusion.score_pairs(pairs, fusion.word_overlap).withColumns(_r("logit"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_custkey / 2.0::DOUBLE WHEN 1 THEN 1.5::DOUBLE - c_custkey END AS logit FROM customer WHERE c_custkey % 3 <> 2""")
def output_reduction(spark, d):
    x = F.col("c_custkey").cast("double")
    out = F.when(x % 3 == 0, F.array(x / 2)).when(x % 3 == 1, F.array(x, F.lit(1.5))).otherwise(F.array(x, x, x))
    return S.read(spark, d, "customer").select("c_custkey", fusion.reduce_output(out).alias("logit")).where("logit IS NOT NULL")


@query("""WITH t AS (SELECT c_custkey, c_custkey % 9 AS n, c_custkey % 13 AS m FROM customer), u AS (SELECT *, least(n, 4) AS q, least(least(m, 8), 13 - least(n, 4)) AS p FROM t)
SELECT c_custkey, array_to_string([101] || range(1, q + 1) || [102] || range(100, 100 + p) || [102] || list_transform(range(0, 13 - q - p), lambda x: 0), ' ') AS ids,
 array_to_string(list_transform(range(0, 16), lambda i: CASE WHEN i < q + p + 3 THEN 1 ELSE 0 END), ' ') AS mask,
 array_to_string(list_transform(range(0, 16), lambda i: CASE WHEN i >= q + 2 AND i < q + p + 3 THEN 1 ELSE 0 END), ' ') AS segments FROM u""")
def pair_packing(spark, d):
    """[CLS] query [SEP] passage [SEP] of at most 16 ids, 4 of the query and 8 of the passage."""
    k = F.col("c_custkey")
    upto = lambda a, n: F.when(n > 0, F.sequence(F.lit(a).cast("long"), F.lit(a - 1) + n)).otherwise(F.array().cast("array<bigint>"))
    ids, mask, seg = fusion.pack_pair(upto(1, k % 9), upto(100, k % 13), model_max=16, query_max=4, passage_max=8)
    text = lambda x: F.array_join(x.cast("array<string>"), " ")
    return S.read(spark, d, "customer").select("c_custkey", text(ids).alias("ids"), text(mask).alias("mask"), text(seg).alias("segments"))


# ---- kernels around models -------------------------------------------------------------

@query("""SELECT p_partkey, i AS "start", j AS "end" FROM part, range(0, 11) a(i), range(0, 11) b(j) WHERE i < p_partkey % 12 AND j < p_partkey % 12 AND j BETWEEN i AND i + 3""")
def word_spans(spark, d):
    out = vectors.spans((F.col("p_partkey") % 12).cast("int"), 4)
    return S.read(spark, d, "part").select("p_partkey", F.inline(out)).select("p_partkey", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def _tokens(spark, d):
    """A vector of 8 as four tokens of two values, with a mask and word ids."""
    e = S.read(spark, d, "embeddings").where("embedding IS NOT NULL")
    tok = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(1)), lambda j: F.col("embedding")[i * 2 + j].cast("double")))
    mask = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i <= F.col("vec_id") % 4, 1).otherwise(0))
    words = F.array(F.lit(None).cast("int"), F.lit(0), F.when(F.col("vec_id") % 2 == 0, 0).otherwise(1), F.lit(2))
    return e.select("vec_id", tok.alias("tokens"), mask.alias("mask"), words.alias("words"))


@query("""WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS e, vec_id % 4 + 1 AS n FROM embeddings WHERE embedding IS NOT NULL),
m AS (SELECT vec_id, list_sum(list_transform(range(0, n), lambda i: e[2 * i + 1])) / n AS x, list_sum(list_transform(range(0, n), lambda i: e[2 * i + 2])) / n AS y FROM t)
SELECT vec_id, round(x / greatest(sqrt(x * x + y * y), 1e-12), 5) AS x, round(y / greatest(sqrt(x * x + y * y), 1e-12), 5) AS y FROM m""")
def sentence_pooling(spark, d):
    v = vectors.mean_pool(F.col("tokens"), F.col("mask"))
    return _tokens(spark, d).select("vec_id", v.alias("v")).select("vec_id", F.round(F.col("v")[0], 5).alias("x"), F.round(F.col("v")[1], 5).alias("y"))


@query("""WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL)
SELECT vec_id, 0 AS word, round(e[3], 5) AS x FROM t UNION ALL SELECT vec_id, 1, round(e[5], 5) FROM t WHERE vec_id % 2 = 1
UNION ALL SELECT vec_id, 2 - (vec_id + 1) % 2, round(e[7], 5) FROM t""")
def word_scatter(spark, d):
    """The vector of each word's first sub-word."""
    w = vectors.word_vectors(F.col("tokens"), F.col("words"))
    return _tokens(spark, d).select("vec_id", F.posexplode(w).alias("word", "v")).select("vec_id", F.col("word").cast("int").alias("word"), F.round(F.col("v")[0], 5).alias("x"))


@query("""SELECT c_custkey, round(1 / (1 + exp(-(c_custkey % 41 - 20)::DOUBLE)), 9) AS p, 'query: ' || c_name AS q, 'passage: ' || c_name AS t,
 TRY_CAST(CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE (c_custkey * 3)::VARCHAR END AS BIGINT) AS n,
 coalesce(nullif(replace(trim(lower(CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE c_name || ':X' END)), ':', '_'), ''), 'global') || ':' || 'k' AS key FROM customer""")
def scalar_functions(spark, d):
    k, name = F.col("c_custkey"), F.col("c_name")
    scope = F.when(k % 4 == 0, " ").otherwise(F.concat(name, F.lit(":X")))
    return S.read(spark, d, "customer").select(
        "c_custkey", F.round(X.sigmoid((k % 41 - 20).cast("double")), 9).alias("p"), X.query_text(name).alias("q"), X.passage_text(name).alias("t"),
        X.as_int(F.when(k % 3 == 0, name).otherwise((k * 3).cast("string"))).alias("n"), X.build_key(scope, F.lit("k")).alias("key"),
    )


@query("""WITH e AS (SELECT p_partkey, unnest([1, 2, 3, 4]) AS i, unnest([' ' || p_name, upper(p_name), p_name, 'x']) AS text, unnest(['A', 'A', 'B', 'A']) AS label FROM part),
t AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, lower(trim(text)), label ORDER BY i) AS r FROM e WHERE length(trim(text)) >= 2)
SELECT p_partkey, trim(text) AS text, label FROM t WHERE r = 1""")
def entity_dedup(spark, d):
    one = lambda t, label: F.struct(t.alias("text"), F.lit(label).alias("label"))
    n = F.col("p_name")
    e = F.array(one(F.concat(F.lit(" "), n), "A"), one(F.upper(n), "A"), one(n, "B"), one(F.lit("x"), "A"))
    return S.read(spark, d, "part").select("p_partkey", F.inline(X.dedup_entities(e)))


# ---- memory writes ------------------------------------------------------------------------

@query(f"""WITH {_LOG}, f AS (SELECT * FROM mem WHERE status = 'active' AND scope = 'u7' ORDER BY updated_at DESC, mem_key LIMIT 128)
SELECT mem_key, scope, split_part(mem_key, ':', 2) AS canonical_key FROM f WHERE trust >= 0.1""")
def memory_query_scope(spark, d):
    return memory.query(_memories(spark, d), NOW, 16, min_trust=0.1, scope="u7").select("mem_key", "scope", "canonical_key")


@query(f"WITH {_LOG} SELECT mem_key, life, status FROM mem ORDER BY updated_at DESC, mem_key, life LIMIT 128")
def memory_candidates(spark, d):
    return memory.list_candidates(_memories(spark, d)).select("mem_key", F.col("life").cast("long").alias("life"), "status")


@query(f"""WITH {_LOG}, c AS (SELECT mem_key, row_number() OVER (ORDER BY updated_at DESC, mem_key, life) AS r FROM mem QUALIFY r <= 128),
k AS (SELECT mem_key, min(r) AS r FROM c GROUP BY 1), p AS (SELECT split_part(split_part(split_part(split_part(mem_key, ':', 2), '.', 1), '/', 1), '_', 1) AS x, min(r) AS r FROM c GROUP BY 1)
SELECT (SELECT string_agg(mem_key, ' ' ORDER BY r) FROM (SELECT * FROM k ORDER BY r LIMIT 32)) AS known_keys,
 (SELECT string_agg(x, ' ' ORDER BY r) FROM (SELECT * FROM p WHERE x <> '' ORDER BY r LIMIT 12)) AS known_prefixes""")
def memory_known_keys(spark, d):
    out = memory.known_keys(memory.list_candidates(_memories(spark, d)))
    return out.select(F.array_join("known_keys", " ").alias("known_keys"), F.array_join("known_prefixes", " ").alias("known_prefixes"))


@query(f"WITH {_LOG} SELECT mem_key, life, last_seen AS created_at, status, scope, updated_at, false AS has_retrieved, round(trust, 6) AS trust FROM mem")
def memory_metadata(spark, d):
    """The snapshot that the metadata repeat, read back from their JSON."""
    m = memory.refresh_metadata(_memories(spark, d).withColumn("metadata", F.to_json(F.struct("created_at"))))
    got = F.from_json("metadata", "created_at long, mem struct<status:string,scope:string,updated_at:long,last_retrieved:long,trust:double>")
    return m.select("mem_key", F.col("life").cast("long").alias("life"), got.alias("j"), F.col("metadata").contains("last_retrieved").alias("has_retrieved")).select(
        "mem_key", "life", "j.created_at", "j.mem.status", "j.mem.scope", "j.mem.updated_at", "has_retrieved", F.round("j.mem.trust", 6).alias("trust")
    )


_LINKS = """ph AS (SELECT p_partkey AS id, p_name AS name, p_partkey % 50 = 0 AS is_hub FROM part),
lk AS (SELECT DISTINCT c_custkey AS node_id, CASE c_custkey % 3 WHEN 0 THEN lower(p_name) WHEN 1 THEN 'term ' || c_custkey % 40 ELSE 'a' END AS term
 FROM customer JOIN part ON p_partkey = c_custkey WHERE c_custkey % 5 IN (0, 1)),
rs AS (SELECT node_id, term, (SELECT min(id) FROM ph WHERE lower(name) = term) AS p FROM lk WHERE length(term) >= 2)"""


def _linked(spark, d):
    k = F.col("c_custkey")
    rows = S.read(spark, d, "customer").join(S.read(spark, d, "part"), F.col("p_partkey") == k)
    term = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.concat(F.lit("Term "), (k % 40).cast("string"))).otherwise("a")
    decided = rows.select(k.alias("node_id"), F.element_at(F.array(*map(F.lit, ("created", "updated", "noop", "deleted", "created"))), (k % 5 + 1).cast("int")).alias("status"),
                          F.when(k % 5 != 4, F.array(term)).alias("entities"))
    phrases = S.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 50 == 0).alias("is_hub"))
    return memory.link_entities(memory.linked_terms(decided), phrases)


@query(f"WITH {_LINKS} SELECT DISTINCT term AS name FROM rs WHERE p IS NULL")
def entity_phrases_made(spark, d):
    none = spark.createDataFrame([], "source long, target long, weight double")
    return memory.link_writes(_linked(spark, d), none)[0].select("name")


@query(f"""WITH {_LINKS}, e AS (SELECT p_partkey AS source, p_partkey AS target, 3.0::DOUBLE AS weight FROM part WHERE p_partkey % 6 = 0 UNION ALL SELECT node_id, p, 2.0 FROM rs UNION ALL SELECT p, node_id, 2.0 FROM rs)
SELECT source, target, max(weight) AS weight FROM e WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY 1, 2""")
def entity_edges(spark, d):
    """Links of memories to phrases that are there, both ways; an edge keeps its larger weight."""
    old = S.read(spark, d, "part").where("p_partkey % 6 = 0").selectExpr("p_partkey source", "p_partkey target", "3.0D weight")
    links = _linked(spark, d).where("phrase_id IS NOT NULL")
    return memory.link_writes(links, old)[1]


# ---- sessions and evaluation -----------------------------------------------------------------

@query("""WITH t AS (SELECT user_id AS session_id, arg_max(event_type, event_id) AS last, max(event_id) AS turn FROM events GROUP BY 1)
SELECT CAST(session_id AS VARCHAR) AS session_id, turn, last AS entity FROM t WHERE last <> 'error'""")
def session_current(spark, d):
    """Contexts replaced at each turn; an error clears its session's."""
    e = S.read(spark, d, "events").select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("turn"),
        F.when(F.col("event_type") == "error", "clear").otherwise("update").alias("action"), F.array("event_type").alias("entities"),
    )
    return sessions.current_context(e).select("session_id", "turn", F.col("entities")[0].alias("entity"))


@query("""SELECT coalesce(avg(recall), 0) AS recall, coalesce(avg(length), 0) AS length FROM (
 SELECT CASE WHEN event_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END AS recall, round(length(event_type), 6)::DOUBLE AS length FROM events) t""")
def benchmark_means(spark, d):
    e = S.read(spark, d, "events").select(F.when(F.col("event_id") % 3 == 0, 1.0).otherwise(0.0).alias("recall"), F.length("event_type").cast("double").alias("length"))
    return evaluate.means(e, "recall", "length").withColumns(_r("recall", "length"))


@query(f"""WITH {_V}, c AS (SELECT a.id AS query_id, b.id, list_cosine_similarity(a.e, b.e) AS s, list_distance(a.e, b.e) AS dist FROM v a, v b WHERE a.id % 50 = 0 AND a.id <> b.id),
b AS (SELECT query_id, arg_max(id, (s, -id)) AS b, arg_min(id, (dist, id)) AS f FROM c GROUP BY 1)
SELECT query_id, f = b AS hit, true AS baseline_hit FROM b""")
def hit_at_1(spark, d):
    """Nearest by L2 against the nearest by cosine, for every id divisible by 50."""
    v = S.read(spark, d, "embeddings").selectExpr("vec_id id", "embedding")
    asked = v.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    near = vectors.knn(asked, v, k=2).where("id <> query_id")
    first = near.groupBy("query_id").agg(F.min_by("id", F.struct("distance", "id")).alias("id"))
    best = vectors.cosine_top1(asked, v).select("query_id", "id")
    return evaluate.hit_at_1(first, best.select("query_id", F.col("id").alias("target")), best)
