"""Mixing sources to target weights by capped water-filling (operator 6, native).

Every source has a weight; all targets together are the size of the whole
input.  A source stops at ``max_epochs`` times its own size and its excess goes
to the others by weight, until none is above: with the sources in the order of
cap / weight, those capped form a prefix, so the final level comes from running
sums over the (small) source table instead of a loop.

A source whose target is ``whole + fraction`` epochs takes every document
``whole`` times; the fractional epoch takes documents in the order of a seeded
hash up to the words still due, and the document at the cut takes a part.  The
cut is found from a histogram of 4,096 hash buckets a source and an exact look
into one bucket, so no source is ever gathered in one task.

Cases: a null text has size 0 and takes 0; a null source is a source of its own
and sorts last; texts are counted whole, however long; a source of size 0 has target 0; repeated rows each count and
share a cut between them; an empty table gives no rows; extra columns are
carried along, and an input column named like an added one is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, n_words, plain, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-17"


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources(source, source_size, weight)`` with ``target`` added."""
    cap = (F.col("source_size") * max_epochs).cast("double")
    w = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = sources.withColumn("cap", cap).withColumn("total", F.sum(F.col("source_size").cast("double")).over(every))
    s = s.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("weight_left", F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("capped", F.col("cap") * F.col("weight_left") <= (F.col("total") - F.col("cap_before")) * F.col("weight"))
    spent = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    open_weight = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every)
    level = F.try_divide(F.col("total") - spent, open_weight.cast("double"))
    return s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight"))).select(
        "source", "source_size", "weight", "target"
    )


def cycled_weights(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Weights by the source's place in code point order, nulls last, repeating."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    each = F.array(*[F.lit(int(x)) for x in weights])
    return sources.withColumn("weight", F.element_at(each, (place % len(weights) + 1).cast("int")))


def sample_key(seed: str, *columns: str):
    """A seeded hash of the columns, as hex; equal rows have equal keys."""
    return F.md5(F.concat(F.lit(seed), *[F.coalesce(F.concat(F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]))


def mix_plan(slim: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source from ``slim(source, size, key)``: what it takes.

    Columns: source, source_size, target, whole (epochs), and for the
    fractional epoch cut_key, cut_words, cut_size: documents below the key are
    taken, those at the key share cut_words of their cut_size words.
    """
    hist = slim.groupBy("source", F.substring("key", 1, 3).alias("bucket")).agg(F.sum("size").alias("words"))
    sources = hist.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = water_fill(cycled_weights(sources, weights), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("whole", F.least(whole, F.lit(max_epochs)).cast("long"))
    plan = plan.withColumn(
        "due", F.greatest(F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size"), F.lit(0))
    )
    due = plan.where("due > 0").select(F.col("source").alias("s"), "due")
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    at = (
        hist.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
        .join(due, F.col("source").eqNullSafe(F.col("s")))
        .where((F.col("before") < F.col("due")) & (F.col("before") + F.col("words") >= F.col("due")))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "due")
    )
    inside = (
        slim.withColumn("bucket", F.substring("key", 1, 3))
        .join(at, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .groupBy("source", "key", "before", "due")
        .agg(F.sum("size").alias("words"))
    )
    order = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(order), F.lit(0)))
    cut = inside.where((F.col("before") < F.col("due")) & (F.col("before") + F.col("words") >= F.col("due"))).select(
        F.col("source").alias("s"),
        F.col("key").alias("cut_key"),
        (F.col("due") - F.col("before")).alias("cut_words"),
        F.col("words").alias("cut_size"),
    )
    return plan.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "due", "weight")


def taken(size, key, partial: bool = True):
    """Words a document gives to the mix, from the columns of ``mix_plan``.

    With ``partial`` false the document at the cut is taken once more as a whole
    if at least half of it is due, else not.
    """
    at_cut = F.floor(F.col("cut_words") * size / F.col("cut_size")).cast("long")
    if not partial:
        at_cut = F.when(F.col("cut_words") * 2 >= F.col("cut_size"), size).otherwise(F.lit(0).cast("long"))
    more = F.when(key < F.col("cut_key"), size).when(key == F.col("cut_key"), at_cut).otherwise(F.lit(0).cast("long"))
    return (F.col("whole") * size + F.coalesce(more, F.lit(0).cast("long"))).cast("long")


def mix(slim: DataFrame, scratch: Scratch, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, partial: bool = True) -> DataFrame:
    """``slim`` (source, size, key and any others) with source_size, target, taken."""
    # written, so that its size is known and a small plan is broadcast, a large one joined
    plan = scratch.write(mix_plan(slim, weights, max_epochs).withColumnRenamed("source", "s"), "plan")
    rest = slim.drop("source_size", "target", "taken", "whole", "cut_key", "cut_words", "cut_size")
    both = rest.join(plan, F.col("source").eqNullSafe(F.col("s")))
    return both.withColumn("taken", taken(F.col("size"), F.col("key"), partial)).drop(
        "s", "whole", "cut_key", "cut_words", "cut_size"
    )


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), sample_key(SEED, "doc_id").alias("key"))
    scratch = Scratch(spark, "op6")
    return mix(scratch.write(slim, "slim"), scratch).select("doc_id", "size", "source_size", "target", "taken")


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as rows: a document taken n times is n equal rows, 0 times none.

    Documents stay whole: the one at a source's cut is taken or left.

    Cases: a null, empty or blank text has no words and is not taken; a null
    source is one of its own; equal keys (repeated rows) are taken or left
    together; extra columns of any name are carried along; an empty table gives
    no rows.
    """
    rows, at = plain(docs)
    sized = rows.withColumns({
        "source": F.col(at["source"]), "size": n_words(F.col(at["text"])), "key": sample_key(SEED, at["doc_id"]),
    })
    scratch = Scratch(spark, "mix")
    slim = scratch.write(sized.select("source", "size", "key"), "slim")
    plan = scratch.write(mix_plan(slim).withColumnRenamed("source", "s"), "plan")
    mixed = sized.join(plan, F.col("source").eqNullSafe(F.col("s")))
    times = F.try_divide(taken(F.col("size"), F.col("key"), partial=False), F.col("size"))
    repeated = mixed.withColumn("times", F.coalesce(times, F.lit(0)).cast("int")).where("times > 0")
    return repeated.select(*at.values(), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth")).drop("nth").toDF(*at)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         md5('mix-17' || coalesce(':' || CAST(doc_id AS VARCHAR), '-')) AS key
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CAST(source_size * 3 AS DOUBLE) AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM src),
run AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM weighted),
flagged AS (SELECT *, cap * weight_left <= (total - cap_before) * weight AS capped FROM run),
levels AS (
  SELECT *, (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())
            / nullif(CAST(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS DOUBLE), 0) AS level
  FROM flagged),
plan AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE level * weight END AS target FROM levels),
epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS whole
  FROM plan),
placed AS (
  SELECT d.*, e.source_size, e.target, e.whole,
         greatest(CAST(round(e.target) AS BIGINT) - e.whole * e.source_size, 0) AS due,
         sum(size) OVER (PARTITION BY d.source ORDER BY d.key RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY d.source, d.key) AS at_key
  FROM sized d JOIN epochs e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(whole * size + CASE WHEN due >= upto THEN size
            WHEN due > upto - at_key THEN floor(CAST((due - (upto - at_key)) * size AS DOUBLE) / at_key)
            ELSE 0 END AS BIGINT) AS taken
FROM placed
"""
