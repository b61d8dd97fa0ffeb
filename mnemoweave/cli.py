"""Command line: index texts into a graph, search it, show its counts, link synonyms.

A store is a folder with a version for each write, so readers never see half of one.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import graph, vectors
from .plans import retrieve
from .sources import tables as S


def _versions(spark: SparkSession, folder: str) -> list[int]:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """(nodes, edges) of the newest version, or None."""
    for v in reversed(_versions(spark, folder)):
        return spark.read.parquet(f"{folder}/v{v}/nodes"), spark.read.parquet(f"{folder}/v{v}/edges")
    return None


def save(spark: SparkSession, folder: str, nodes: DataFrame, edges: DataFrame) -> int:
    v = max(_versions(spark, folder), default=0) + 1
    nodes.write.parquet(f"{folder}/v{v}/nodes")
    edges.write.parquet(f"{folder}/v{v}/edges")
    return v


def index(spark: SparkSession, folder: str, docs: DataFrame) -> int:
    have = load(spark, folder)
    return save(spark, folder, *S.ingest(docs, *(have or (None, None))))


def search(spark: SparkSession, folder: str, query: str, config: Config = Config(), k: int = 5) -> str:
    """The result's text for a query whose phrases are its capitalised words."""
    have = load(spark, folder)
    asked = spark.createDataFrame([(1, query)], "query_id long, content string")
    names = S.phrases(asked.select(F.col("query_id").alias("doc_id"), F.lit(0).alias("chunk_idx"), "content"))
    names = names.select(F.col("doc_id").alias("query_id"), F.col("phrase").alias("name"))
    if have is None:
        return retrieve.NOTHING_FOUND
    nodes, edges = have
    seeds = retrieve.seeds_by_name(names, nodes)
    if seeds.isEmpty():
        return retrieve.NOTHING_FOUND
    found = retrieve.contents(retrieve.search(seeds, nodes, edges, config, k), nodes)
    row = retrieve.format_results(found).first()
    return row["result"] if row else "No context found for entities."


def stats(spark: SparkSession, folder: str) -> dict[str, int]:
    have = load(spark, folder)
    if have is None:
        return {}
    nodes, edges = have
    return {r["metric"]: r["value"] for r in graph.integrity(nodes, edges, graph.hubs(edges)).collect()}


def optimize(spark: SparkSession, folder: str, vectors_path: str, max_distance: float = 0.55) -> int:
    """Adds synonym edges between nodes with near vectors (id, embedding); returns the version."""
    nodes, edges = load(spark, folder)
    v = spark.read.parquet(vectors_path)
    types = nodes.select("id", "type")
    phrases = v.join(types.where("type = 'phrase'"), "id", "left_semi")
    new = vectors.synonym_links(phrases, v, max_distance=max_distance)
    for end, name in (("source", "src_type"), ("target", "dst_type")):
        new = new.join(types.select(F.col("id").alias(end), F.col("type").alias(name)), end)
    every = edges.withColumn("_n", F.lit(0)).unionByName(new.select(edges.columns).withColumn("_n", F.lit(1)))
    kept = every.groupBy("source", "target").agg(F.min_by(F.struct("weight", "src_type", "dst_type"), "_n").alias("e"))
    return save(spark, folder, nodes, kept.select("source", "target", "e.weight", "e.src_type", "e.dst_type"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> object:
    p = argparse.ArgumentParser(prog="mnemoweave")
    p.add_argument("--store", default="store")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index")
    what = i.add_mutually_exclusive_group(required=True)
    what.add_argument("--text")
    what.add_argument("--file")
    sub.add_parser("search").add_argument("query")
    sub.add_parser("stats")
    o = sub.add_parser("optimize-graph")
    o.add_argument("--vectors", required=True)
    o.add_argument("--threshold", type=float, default=0.55)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "index":
        docs = spark.createDataFrame([(a.text,)], "text string") if a.text is not None else S.text_documents(spark, a.file)
        out = index(spark, a.store, docs.withColumn("doc_id", F.xxhash64("text")))
    elif a.command == "search":
        out = search(spark, a.store, a.query)
    elif a.command == "stats":
        out = stats(spark, a.store)
    else:
        out = optimize(spark, a.store, a.vectors, a.threshold)
    print(out)
    return out


if __name__ == "__main__":
    main()
