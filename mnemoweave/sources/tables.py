"""Tables as the engine's graph, vectors and logs; text and JSON sources; sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import chunks


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """A document for each text file."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    """JSON fixtures: documents with a query and its target."""
    schema = "fixture_id string, docs array<struct<id:string,text:string>>, query string, target_doc_id string, target_substring string"
    return spark.read.schema(schema).json(path, multiLine=True)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def both_ways(pairs: DataFrame) -> DataFrame:
    """The edges of ``bipartite_edges`` from pairs that are distinct; a filter by types leaves one of two reads of them."""
    def one(source: str, target: str) -> DataFrame:
        types = [F.lit(source).alias("src_type"), F.lit(target).alias("dst_type")]
        return pairs.select(F.col(source).alias("source"), F.col(target).alias("target"), F.lit(1.0).alias("weight"), *types)

    return one("passage", "phrase").unionByName(one("phrase", "passage"))


def bipartite_edges(pairs: DataFrame) -> DataFrame:
    """Both directions of distinct (passage, phrase) pairs, weight 1, types carried."""
    both = F.explode(F.array(
        F.struct(F.col("passage").alias("source"), F.col("phrase").alias("target"), F.lit("passage").alias("src_type"), F.lit("phrase").alias("dst_type")),
        F.struct(F.col("phrase").alias("source"), F.col("passage").alias("target"), F.lit("phrase").alias("src_type"), F.lit("passage").alias("dst_type")),
    ))
    return pairs.distinct().select(both.alias("e")).select("e.source", "e.target", F.lit(1.0).alias("weight"), "e.src_type", "e.dst_type")


def order_graph(spark: SparkSession, folder: str, held=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): orders as passages (2 * key), parts as phrases (2 * key + 1).

    A part whose key is divisible by 3 and the next part are linked as phrases,
    with a weight of 0.5 to 0.9.  ``held`` writes what the edges are made of, if
    they are read several times: each pair of ends once, without what all share.
    """
    li = read(spark, folder, "lineitem")
    pairs = li.select((F.col("l_orderkey") * 2).alias("passage"), (F.col("l_partkey") * 2 + 1).alias("phrase"))
    part = li.select("l_partkey").distinct()
    near = part.where("l_partkey % 3 = 0").withColumn("b", F.col("l_partkey") + 1)
    near = near.join(part.withColumnRenamed("l_partkey", "b"), "b", "left_semi")
    weight = 0.5 + F.col("l_partkey") % 5 / 10.0
    one = F.struct((F.col("l_partkey") * 2 + 1).alias("source"), (F.col("b") * 2 + 1).alias("target"))
    two = F.struct((F.col("b") * 2 + 1).alias("source"), (F.col("l_partkey") * 2 + 1).alias("target"))
    alike = held(near.select(weight.alias("weight"), F.inline(F.array(one, two)))).select(
        "source", "target", "weight", F.lit("phrase").alias("src_type"), F.lit("phrase").alias("dst_type")
    )
    edges = both_ways(held(pairs.distinct())).unionByName(alike)
    return nodes_of(edges), edges


def nodes_of(edges: DataFrame) -> DataFrame:
    """(id, type) of a graph all of whose nodes have an edge out."""
    return edges.select(F.col("source").alias("id"), F.col("src_type").alias("type")).distinct()


def passages(docs: DataFrame, size: int = 512, source: str = "batch") -> DataFrame:
    """(doc_id, chunk_idx, name, content) by the greedy chunker."""
    out = docs.select("doc_id", F.posexplode(chunks(F.col("text"), size)).alias("chunk_idx", "content"))
    return out.withColumn("name", F.concat_ws("_", F.lit("p"), F.lit(source), F.col("doc_id").cast("string"), F.col("chunk_idx").cast("string")))


def phrases(chunks_: DataFrame) -> DataFrame:
    """(doc_id, chunk_idx, phrase): capitalised words as a rule-based extractor."""
    found = F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b([A-Z][a-z]{3,})\b"), F.lit(1)))
    return chunks_.select("doc_id", "chunk_idx", F.explode(found).alias("phrase"))


def document_graph(docs: DataFrame, size: int = 512) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of documents; ids are hashes of what names a node."""
    ps = passages(docs, size)
    found = phrases(ps)
    pid = F.xxhash64(F.lit("passage"), "doc_id", "chunk_idx")
    edges = bipartite_edges(found.select(pid.alias("passage"), F.xxhash64(F.lit("phrase"), "phrase").alias("phrase")))
    a = ps.select(pid.alias("id"), F.lit("passage").alias("type"), "name", "content")
    b = found.select("phrase").distinct().select(
        F.xxhash64(F.lit("phrase"), "phrase").alias("id"), F.lit("phrase").alias("type"), F.col("phrase").alias("name"),
        F.lit(None).cast("string").alias("content"),
    )
    return a.unionByName(b), edges


def passage_ids(nodes: DataFrame) -> DataFrame:
    return nodes.where("type = 'passage'").select("id")


def node_by_name(nodes: DataFrame, names: DataFrame, type_: str = "phrase") -> DataFrame:
    """(name, id): the lowest id of each name, compared exactly."""
    found = nodes.where(F.col("type") == type_).groupBy("name").agg(F.min("id").alias("id"))
    return names.select("name").distinct().join(found, "name")


def ingest(docs: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None, size: int = 512) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after adding ``docs(doc_id, text)`` to a graph, which may be empty.

    A phrase that is there by its exact name stays as it is, and an edge that is
    there keeps its weight; passages are named by document and chunk.  Nothing is
    added for no documents.
    """
    new_nodes, new_edges = document_graph(docs, size)
    if nodes is None or edges is None:
        return new_nodes, new_edges
    known = nodes.where("type = 'phrase'").groupBy("name").agg(F.min("id").alias("known"))
    # new phrases of a known name take its id in the edges
    same = new_nodes.where("type = 'phrase'").join(known, "name").select(F.col("id").alias("was"), "known").where("was <> known")
    renamed = new_edges
    for end in ("source", "target"):
        renamed = renamed.join(same.select(F.col("was").alias(end), "known"), end, "left").withColumn(end, F.coalesce("known", end)).drop("known")
    fresh = new_nodes.join(known.select("name", F.lit("phrase").alias("type")), ["name", "type"], "left_anti").select(nodes.columns)
    fresh = fresh.join(nodes.select("id"), "id", "left_anti")
    every = edges.withColumn("_new", F.lit(0)).unionByName(renamed.withColumn("_new", F.lit(1)))
    kept = every.groupBy("source", "target").agg(F.min_by(F.struct("weight", "src_type", "dst_type"), "_new").alias("e"))
    return nodes.unionByName(fresh), kept.select("source", "target", "e.weight", "e.src_type", "e.dst_type")


def passage_dump(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, name, content, embedding) of the passages that have a vector, by id."""
    rows = nodes.where("type = 'passage'").join(vectors.select("id", "embedding"), "id", "left")
    return rows.where("embedding IS NOT NULL").select("id", "name", "content", "embedding").orderBy("id")


def create_tables(spark: SparkSession, folder: str) -> None:
    """Empty tables of the engine's schemas, where there is none yet."""
    jvm = spark._jvm
    for name, schema in schemas.TABLES.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}")


def migrate_vectors(spark: SparkSession, old: str, new: str) -> DataFrame:
    """Copies a table of (rowid, embedding) to (id, embedding); the old one can go once this is read."""
    spark.read.parquet(old).select(F.col("rowid").cast("long").alias("id"), F.col("embedding").cast("array<float>")).write.mode("error").parquet(new)
    return spark.read.parquet(new)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def checked_fixtures(fixtures_: DataFrame) -> DataFrame:
    """Fixtures with ``missing``, the names of the keys that they lack."""
    need = [c for c in ("fixture_id", "docs", "query", "target_doc_id", "target_substring")]
    return fixtures_.withColumn("missing", F.filter(F.array(*[F.when(F.col(c).isNull(), c) for c in need]), lambda x: x.isNotNull()))


def memory_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as memory decisions: most create, some update or delete; some values are missing, some kinds explicitly null."""
    e = read(spark, folder, "events")
    i = F.col("event_id")
    kind = (
        F.when(F.col("event_type") == "purchase", "fact").when(F.col("event_type") == "view", "preference")
        .when(F.col("event_type") == "click", "task").otherwise("other")
    )
    update = (i % 17 != 0) & (i % 5 == 3)
    return e.select(
        F.concat_ws(":", F.concat(F.lit("u"), F.col("user_id").cast("string")), "event_type").alias("mem_key"),
        i.alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"),
        F.when(i % 17 == 0, "delete").when(update, "update").otherwise("create").alias("action"),
        F.when(i % 7 != 0, kind).alias("kind"), (i % 2 == 0).alias("kind_given"),
        F.when(update & (i % 4 == 0), (i % 90) / 90.0).alias("trust"), F.when(~update | (i % 3 == 0), (i % 100) / 100.0).alias("init_trust"),
        F.when(update & (i % 4 == 1), (i % 60) / 60.0).alias("strength"), F.when(~update | (i % 3 == 1), (i % 70) / 70.0).alias("init_strength"),
        F.when(i % 6 != 0, F.concat_ws("-", "event_type", (i % 11).cast("string"))).alias("value"),
    )
