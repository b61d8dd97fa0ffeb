"""Near-duplicate documents by ProbMinHash (operator 4).

A text's shingles are its runs of five words, weighted by how often they occur.
Each shingle is a Poisson process of seeded exponential arrivals, faster with
its weight, and every arrival hits a random register; a register keeps its first
arrival, and a shingle stops once its next arrival is later than all registers'.
Two texts agree in a register with their probability Jaccard similarity.

Registers are banded.  In a bucket each text is compared with the smallest only
(so a group of thousands makes no pairs within itself); what is linked is one
component; the texts of buckets that still hold several components are paired
by their rarest shingles: first with the most central text of a family, then with
those the registers estimate to be similar, at last with all in other components
that an upper bound of the similarity and the estimate's error leave.
Every comparison computes the probability Jaccard of the whole texts.

Cases: equal texts are one class from the start; a null text is a class of its
own; a text of one to four words has one shingle of all its words; a text
without words equals only equal texts; texts of any length are compared whole, in
slices bounded by bytes or of a single pair; rows with the same id and text are
copies; of a class the smallest id names it; a null id has a null class and is kept; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, in_parts, plain, table
from ._graph import components
from ._words import Words, mix

WORDS = 5
MIN_SIMILARITY = 0.8
#: A pair at the threshold misses all 42 bands of 7 with a chance of 5e-5.
BANDS, ROWS = 42, 7
#: Rounds of comparing with central texts before all remaining pairs are compared.
CENTRAL_ROUNDS = 1
#: Bits kept of a register in a text's sketch, and how many standard deviations
#: below the threshold the share of agreeing registers may lie: a pair at the
#: threshold lies lower with a chance of 3e-5, like that of missing all bands.
SKETCH_BITS, DEVIATIONS = 4, 4.0
#: So many shingles before a leading one are looked at for an earlier meeting.
EARLIER = 16
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


# ---- sketches ------------------------------------------------------------------

def shingles(w: Words, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight), sorted: the distinct shingles of each text."""
    at = np.flatnonzero(w.whole(n))
    of, h = w.text_of()[at], w.grams(n)[at]
    few = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(few):
        short = []
        for i in few.tolist():
            x = np.array([w.count[i]], np.uint64)
            for y in w.hash[w.first[i] : w.first[i + 1]]:
                x = mix(x * _GOLDEN ^ y)
            short.append(x)
        of, h = np.r_[of, few], np.concatenate([h, *short])
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, int)
    return of[first], h[first], np.diff(np.r_[first, len(h)]).astype(np.float64)


def prob_minhash(of: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """The shingle that comes first in each register, (texts, registers)."""
    first = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    latest = np.full(texts, np.inf)
    time, live = np.zeros(len(h)), np.arange(len(h))
    k = 0
    while len(live):
        k += 1
        seed = mix(h[live] + np.uint64(k * int(_GOLDEN) % (1 << 64)))
        u = ((seed >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
        time[live] -= np.log(u) / weight[live]
        early = time[live] < latest[of[live]]
        live, seed = live[early], seed[early]
        slot = of[live] * registers + (mix(seed) % np.uint64(registers)).astype(np.int64)
        t = time[live]
        np.minimum.at(first, slot, t)
        won = first[slot] == t
        winner[slot[won]] = h[live[won]]
        some = np.unique(of[live]) if len(live) < texts else np.arange(texts)
        latest[some] = first.reshape(texts, registers)[some].max(axis=1)
        live = live[t < latest[of[live]]]
    return winner.reshape(texts, registers)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each text and band."""
    place = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
    return mix((mix(signature) * place).reshape(-1, bands, rows).sum(axis=2, dtype=np.uint64))


def bit_planes(signature: np.ndarray) -> np.ndarray:
    """Few bits of each register, as 64-bit words: (texts, words x bits), a word's planes together."""
    texts, registers = signature.shape
    words = -(-registers // 64)
    low = np.zeros((texts, words * 64), np.uint8)
    low[:, :registers] = mix(signature) & np.uint64((1 << SKETCH_BITS) - 1)
    planes = (low.reshape(texts, words, 1, 64) >> np.arange(SKETCH_BITS, dtype=np.uint8)[:, None]) & 1
    return np.packbits(planes, axis=-1, bitorder="little").view(np.int64).reshape(texts, words * SKETCH_BITS)


def least_agreeing(registers: int, least: float, deviations: float) -> float:
    """So many registers of two texts agree in their bits if the texts are ``least`` similar, less some deviations."""
    p = least + (1 - least) / (1 << SKETCH_BITS)
    return registers * p - deviations * np.sqrt(registers * p * (1 - p))


def probability_jaccard(xa, wa, xb, wb) -> float:
    """Exactly, from sorted distinct shingles and weights, by sorting weight ratios."""
    every = np.union1d(xa, xb)
    a, b = np.zeros(len(every)), np.zeros(len(every))
    a[np.searchsorted(every, xa)], b[np.searchsorted(every, xb)] = wa, wb
    with np.errstate(divide="ignore"):
        ratio = b / a
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    low, high = np.cumsum(a), np.r_[np.cumsum(b[::-1])[::-1], 0.0]
    both = np.flatnonzero((a > 0) & (b > 0))
    upto = np.searchsorted(ratio, ratio[both], side="right")
    return float(np.sum(1.0 / (low[upto - 1] / a[both] + high[upto] / b[both]))) if len(both) else 0.0


# ---- Spark ----------------------------------------------------------------------

def _texts(col: pa.Array) -> list[bytes]:
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def sketches(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, digest, keys, sketch) of ``docs(doc_id, text)``; keys are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in in_parts(b, 1):
                w = Words(_texts(p.column(1)))
                sig = prob_minhash(*shingles(w), p.num_rows, bands * rows)
                keys = pa.ListArray.from_arrays(
                    pa.array(np.arange(p.num_rows + 1) * bands, pa.int32()), pa.array(band_keys(sig, bands, rows).view(np.int64).ravel()),
                    mask=pa.array(w.count == 0),
                )
                planes = bit_planes(sig)
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(p.num_rows + 1) * planes.shape[1], pa.int32()), pa.array(planes.ravel()))
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(2), keys, sketch], names=["doc_id", "digest", "keys", "sketch"])

    rows_ = docs.select("doc_id", "text", F.sha2("text", 256).alias("digest"))
    return rows_.mapInArrow(run, "doc_id long, digest string, keys array<long>, sketch array<long>")


def verified(pairs: DataFrame, texts: DataFrame, n: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) are at least ``least`` similar."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in in_parts(batch, 2, 3):
                m = p.num_rows
                w = Words(_texts(p.column(2)) + _texts(p.column(3)))
                of, h, weight = shingles(w, n)
                cut = np.searchsorted(of, np.arange(2 * m + 1))
                part = lambda i: (h[cut[i] : cut[i + 1]], weight[cut[i] : cut[i + 1]])  # noqa: E731, B023
                ok = [probability_jaccard(*part(i), *part(m + i)) >= least - 1e-9 for i in range(m)]
                yield p.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def weighted_shingles(texts: DataFrame, n: int) -> DataFrame:
    """(node, part, shingle, weight, total) of ``texts(node, text)``; part tells a node's texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in in_parts(b, 1):
                of, h, weight = shingles(Words(_texts(p.column(1))), n)
                total = np.bincount(of, weights=weight, minlength=p.num_rows)
                node, part = p.column(0).to_numpy()[of], p.column(2).to_numpy()[of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (node, part, h.view(np.int64), weight, total[of])], names=["node", "part", "shingle", "weight", "total"]
                )

    rows = texts.select("node", "text", F.xxhash64("text"))
    return rows.mapInArrow(run, "node long, part long, shingle long, weight double, total double")


def leading_shingles(parts: DataFrame, least: float) -> DataFrame:
    """(shingle, node, g, gb, earlier): of each text the shingles that a partner may have first.

    Let u be the weight share of a text's shingles that no other text has, and
    g = u / (1 - u).  Two texts whose own shares outside what they have in
    common are u and v are at most 1 / (1 + g(u) + g(v)) similar.  So, with
    shingles in one order, rarest first, the first common one stands where at
    most 1 - least of each text's weight comes before it; and what comes before
    it in either text (its share as gb) is not common.  ``earlier`` holds the
    few leading shingles before: two texts that share one of them meet there.
    """
    often = parts.groupBy("shingle").agg(F.count("*").alias("n"))
    node = Window.partitionBy("node", "part")
    before = F.coalesce(F.sum("weight").over(node.orderBy("n", "shingle").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    own = F.sum(F.when(F.col("n") == 1, F.col("weight")).otherwise(0.0)).over(node) / F.col("total")
    leading = parts.join(often, "shingle").withColumns({"before": before, "own": own}).where(
        (F.col("before") <= (1 - least + 1e-9) * F.col("total")) & (F.col("n") > 1) & (F.col("own") <= 1 - least + 1e-9)
    )
    return leading.select(
        "shingle", "node", (F.col("own") / (1 - F.col("own"))).alias("g"),
        (F.col("before") / (F.col("total") - F.col("before"))).alias("gb"),
        F.collect_list("shingle").over(node.orderBy("n", "shingle").rowsBetween(-EARLIER, -1)).alias("earlier"),
    )


def _reachable(g, other, least: float):
    return g + other <= 1 / least - 1 + 1e-9


def _agreeing(x, y, registers: int):
    """In how many registers two sketches agree."""
    words = -(-registers // 64)
    differ = [
        reduce(lambda a, b: a.bitwiseOR(b), [x[w * SKETCH_BITS + k].bitwiseXOR(y[w * SKETCH_BITS + k]) for k in range(SKETCH_BITS)])
        for w in range(words)
    ]
    return F.lit(registers) - reduce(lambda a, b: a + b, [F.bit_count(d) for d in differ])


def central_pairs(leading: DataFrame, placed: DataFrame, least: float, most: int = 4) -> DataFrame:
    """Each text with the texts of least own weight in another component.

    If a text is similar to any of a family, it most likely is to the family's
    most central members.  Of a shingle's texts the most central one and the
    most central of any other component stand for all; at most ``most`` are
    tried for a text here, the rest later.
    """
    keyed = leading.join(placed, "node")
    one = keyed.groupBy("shingle").agg(F.min(F.struct("g", "node", "c")).alias("m"))
    two = keyed.join(one, "shingle").where(F.col("c") != F.col("m.c")).groupBy("shingle").agg(
        F.min("m").alias("m"), F.min(F.struct("g", "node", "c")).alias("m2")
    )
    met = F.when(F.col("c") != F.col("m.c"), F.col("m")).otherwise(F.col("m2"))
    pairs = keyed.join(two, "shingle").withColumn("t", met).where(_reachable(F.col("g"), F.col("t.g"), least))
    pairs = pairs.groupBy("node", F.col("t.node").alias("a")).agg(F.min("t.g").alias("ga"))
    pairs = pairs.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("ga", "a"))).where(F.col("r") <= most)
    return pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def remaining_pairs(leading: DataFrame, placed: DataFrame, least: float, registers: int, deviations: float) -> DataFrame:
    """All pairs (a, b) in different components of ``placed(node, c, sketch)`` that can reach ``least``."""
    keyed = leading.drop("g").withColumnRenamed("gb", "g").join(placed, "node")
    limits = keyed.groupBy("shingle").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.min("g").alias("g0")).where("x < y")
    keyed = keyed.join(limits.select("shingle", "g0"), "shingle").where(_reachable(F.col("g"), F.col("g0"), least))
    other = keyed.select("shingle", F.col("node").alias("b"), F.col("c").alias("d"), F.col("g").alias("h"), F.col("sketch").alias("other"), F.col("earlier").alias("sooner"))
    left = keyed.select("shingle", F.col("node").alias("a"), "c", "g", "sketch", "earlier")
    alike = _agreeing(F.col("sketch"), F.col("other"), registers) >= F.lit(least_agreeing(registers, least, deviations))
    met = left.join(
        other, (left["shingle"] == other["shingle"]) & F.expr("a < b AND c <> d") & _reachable(F.col("g"), F.col("h"), least) & alike
        & ~F.arrays_overlap("earlier", "sooner")
    )
    return met.select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame, scratch: Scratch, n: int = WORDS, least: float = MIN_SIMILARITY, bands: int = BANDS, rows: int = ROWS,
    rounds: int = CENTRAL_ROUNDS,
) -> DataFrame:
    """(doc_id, digest, class_id) for ``docs(doc_id, text)``, a row for each row."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    marked = scratch.write(sketches(docs, bands, rows), "sketches")
    usable = marked.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    # equal texts are one node, named by their smallest id
    nodes = scratch.write(
        usable.groupBy("digest").agg(F.min("doc_id").alias("node"), F.any_value("keys").alias("keys"), F.any_value("sketch").alias("sketch")),
        "nodes",
    )
    banded = nodes.select("node", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").drop("high")
    members = scratch.write(banded.join(shared, "key"), "members")
    wanted = members.select("node").distinct()
    texts = scratch.write(
        docs.where("text IS NOT NULL").join(wanted, F.col("doc_id") == F.col("node"), "left_semi")
        .select(F.col("doc_id").alias("node"), "text").distinct(), "texts",
    )
    # first the likeliest link of each text: the bucket minimum it meets most often
    stars = members.where("node > low").groupBy("node", "low").agg(F.count("*").alias("n"))
    stars = stars.groupBy(F.col("node").alias("b")).agg(F.max_by("low", F.struct("n", -F.col("low"))).alias("a"))
    stars = scratch.write(stars.select("a", "b"), "stars")
    comp = components(verified(stars, texts, n, least), scratch, "c")
    # then the texts of buckets that still hold different components
    placed = members.join(comp, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("key")
    open_ = scratch.write(placed.join(mixed, "key").select("node", "c").distinct(), "open")
    parts = scratch.write(weighted_shingles(texts.join(open_, "node"), n), "parts")
    leading = scratch.write(leading_shingles(parts, least), "leading")
    scratch.drop("parts", "members")
    tested, placed = stars, open_
    for k in range(rounds):
        central = central_pairs(leading, placed, least).join(tested, ["a", "b"], "left_anti")
        central = scratch.write(central, f"central{k}")
        tested = tested.unionByName(central)
        near = scratch.write(verified(central, texts, n, least), f"near{k}")
        comp = components(near, scratch, f"r{k}", comp)
        placed = open_.select("node").join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("c"))
        if near.isEmpty():
            break
    sketched = scratch.write(nodes.join(open_, "node", "left_semi").select("node", "sketch"), "sketched")
    likely = remaining_pairs(leading, placed.join(sketched, "node"), least, bands * rows, 0.0).join(tested, ["a", "b"], "left_anti")
    likely = scratch.write(likely, "likely")
    tested = tested.unionByName(likely)
    comp = components(verified(likely, texts, n, least), scratch, "l", comp)
    placed = sketched.join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("c"), "sketch")
    across = remaining_pairs(leading, placed, least, bands * rows, DEVIATIONS).join(tested, ["a", "b"], "left_anti")
    more = verified(scratch.write(across, "across"), texts, n, least)
    # rows of one id are one document, whatever their texts
    same_id = usable.join(nodes.select("digest", "node"), "digest").where("doc_id <> node").groupBy("doc_id").agg(
        F.min("node").alias("node"), F.max("node").alias("m")
    ).where("node <> m").select(F.col("node").alias("a"), F.col("m").alias("b"))
    comp = components(more.unionByName(same_id), scratch, "e", comp)
    classes = nodes.select("digest", "node").join(comp, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("class_id")
    )
    out = marked.select("doc_id", "digest").join(classes, "digest", "left")
    return out.withColumn(
        "class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    )


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op4")
    found = near_duplicates(table(spark, sf_dir, "documents"), scratch)
    return found.select(
        "doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept")
    )


def stage_minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the smallest id.

    Cases: rows with a null id are all kept, as are documents with a null text;
    of rows equal in id and text that with the least JSON of all its columns
    stays, so reruns agree; an id's rows with different texts are one document
    and stay or go together; extra columns of any name are carried along.
    """
    docs, at = plain(docs)
    names, c, doc_id, text = list(at), list(at.values()), at["doc_id"], at["text"]
    found = near_duplicates(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), Scratch(spark, "dedup"))
    dropped = found.where("doc_id <> class_id").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    kept = docs.where(F.col(doc_id).isNotNull()).join(
        dropped, (F.col(doc_id) == F.col("_id")) & (F.sha2(text, 256) == F.col("_digest")), "left_anti"
    )
    rest = F.struct(*[x for x in c if x not in (doc_id, text)]) if len(c) > 2 else F.struct(F.lit(0))
    one = kept.groupBy(doc_id, text).agg(F.min_by(rest, F.to_json(rest)).alias("_r"))
    one = one.select(*[F.col(x) if x in (doc_id, text) else F.col(f"_r.{x}").alias(x) for x in c])
    return one.unionByName(docs.where(F.col(doc_id).isNull())).toDF(*names)
