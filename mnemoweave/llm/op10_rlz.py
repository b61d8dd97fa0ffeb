"""Substring deduplication by relative Lempel-Ziv parsing (operator 10).

The reference of a document is all documents with smaller ids.  It is indexed in
blocks by anchors: of each window of ``window`` words the smallest hash among
its five-word grams, a function of the window's words alone, so equal windows
have equal anchors and a document meets only the blocks where its anchors are.
For every anchor that several documents share, the blocks are the stretches of
the smallest such document whose windows have it, as text.  A document is
factored greedily against its blocks: from the first window that stands in one,
the longest match is taken, word by word; then the next window that is not
inside the factor is looked up, which checks what lies across the boundary.
Factors of at least ``window`` words are duplicate spans.  What is left are
windows whose anchor stands in the reference, but not their words: those are
checked against each other by their hash and their anchor (128 bits), so a
window is removed exactly if its words also start in a document with a smaller id.

Cases: a null text has no words; texts shorter than a window lose nothing; a
null doc_id neither loses words nor takes them from others; rows with equal ids
are one document for the comparison and a row each in the result, whether their
texts are equal or not; of documents with equal passages the smallest id keeps
them; very common passages are pre-aggregated by anchor; texts of any length are
factored whole, in batches bounded by bytes or of a single text; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ._common import Scratch, in_parts, table
from ._words import Words, mix

WINDOW, GRAM = 13, 5


def _anchors(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(word places where whole windows start, their anchors)."""
    starts = np.flatnonzero(w.whole(window))
    grams = w.grams(gram)
    least = grams.copy()
    for i in range(1, window - gram + 1):
        np.minimum(least[:-i], grams[i:], out=least[: len(grams) - i])
    return starts, least[starts]


def _texts(col: pa.Array) -> list[bytes]:
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, doc_id) of ``docs(doc_id, text)``, distinct for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in in_parts(b, 1):
                w = Words(_texts(p.column(1)))
                starts, found = _anchors(w, window, gram)
                of = w.text_of()[starts]
                order = np.lexsort((found, of))
                found, of = found[order], of[order]
                new = np.ones(len(found), bool)
                new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
                ids = p.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[of[new]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[new].view(np.int64)), pa.array(ids)], names=["anchor", "doc_id"]
                )

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "anchor long, doc_id long")


def reference(shared: DataFrame, docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, low, block): the reference blocks of ``shared(anchor, low)``.

    A block is a stretch of the smallest document of an anchor: the words of a
    run of windows that all have it.  Equal stretches of a document count once.
    """
    wanted = shared.groupBy(F.col("low").alias("doc_id")).agg(F.collect_list("anchor").alias("anchors"))
    rows = docs.where("text IS NOT NULL").join(wanted, "doc_id").select("doc_id", "text", "anchors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in in_parts(b, 1):
                w = Words(_texts(p.column(1)))
                starts, found = _anchors(w, window, gram)
                bound = np.searchsorted(w.text_of()[starts], np.arange(p.num_rows + 1))
                keys, lows, blocks = [], [], []
                for i, low in enumerate(p.column(0).to_pylist()):
                    want = p.column(2)[i].values.to_numpy().view(np.uint64)
                    a, at = found[bound[i] : bound[i + 1]], starts[bound[i] : bound[i + 1]]
                    mine = np.isin(a, want)
                    a, at = a[mine], at[mine]
                    if not len(a):
                        continue
                    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (np.diff(at) != 1))))
                    first, last = w.start[at[new]], w.end[at[np.append(new[1:], len(at)) - 1] + window - 1]
                    stretches = {(k, w.joined[s:e]) for k, s, e in zip(a[new].view(np.int64).tolist(), first.tolist(), last.tolist(), strict=True)}
                    keys += [k for k, _ in stretches]
                    blocks += [x for _, x in stretches]
                    lows += [low] * len(stretches)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(lows, pa.int64()), pa.array(blocks, pa.string())], names=["anchor", "low", "block"]
                )

    return rows.mapInArrow(run, "anchor long, low long, block string")


def longest(w: Words, ref: Words, s: int, end: int, places: np.ndarray, ends: np.ndarray) -> tuple[int, int]:
    """(length, place) of the longest match of the words from ``s`` on, up to ``end``, at the reference's ``places``."""
    if len(places) == 1:
        n = min(end - s, int(ends[0] - places[0]))
        same = w.hash[s : s + n] == ref.hash[places[0] : places[0] + n]
        return (n if same.all() else int(same.argmin())), int(places[0])
    done, step, best = 0, 32, (0, int(places[0]))
    while len(places) and s + done < end:
        span = np.arange(done, min(done + step, end - s))
        some = places[: (1 << 20) // step]  # the rest follows in the same way
        at = some[:, None] + span
        same = (at < ends[: len(some), None]) & (ref.hash[np.minimum(at, len(ref.hash) - 1)] == w.hash[s + span])
        n = np.where(same.all(axis=1), len(span), same.argmin(axis=1))
        k = int(n.argmax())
        if done + n[k] > best[0]:
            best = (done + int(n[k]), int(some[k]))
        if len(some) < len(places):
            other = longest(w, ref, s, end, places[len(some) :], ends[len(some) :])
            best = max(best, other, key=lambda x: x[0])
        whole = n == len(span)
        places, ends, done, step = some[whole], ends[: len(some)][whole], done + len(span), min(2 * step, 1024)
    return best


def factors(w: Words, ref: Words, at: np.ndarray, end: int, low: np.ndarray, high: np.ndarray, order: np.ndarray, block_end: np.ndarray, window: int):
    """(factors, missed) of one document: greedy longest matches (first word, words), and windows whose words differ after all.

    ``at`` are the starts of windows that the reference has by their hash, at
    ``order[low:high]``.  After a factor the next window that is not inside it
    is looked up: the windows across a factor's boundary are checked like this.
    """
    out, missed, k = [], [], 0
    while k < len(at):
        s = int(at[k])
        places = order[low[k] : high[k]]
        n, r = longest(w, ref, s, end, places, block_end[places])
        mine = w.joined[w.start[s] : w.end[s + n - 1]].split() if n else []
        other = ref.joined[ref.start[r] : ref.end[r + n - 1]].split() if n else []
        if mine != other:  # equal hashes of unequal words
            n = next(j for j, (x, y) in enumerate(zip(mine, other, strict=True)) if x != y)
        if n < window:
            missed.append(s)
            k += 1
            continue
        out.append((s, n))
        k = int(np.searchsorted(at, s + n - window + 1))
    return out, missed


def covered(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    """True for the words of a text of n words that lie in one of the spans (first word, words)."""
    step = np.zeros(n + 1, dtype=np.int64)
    if spans:
        first, length = np.array(spans, dtype=np.int64).T
        np.add.at(step, first, 1)
        np.add.at(step, first + length, -1)
    return np.cumsum(step[:-1]) > 0


def _digest(w: Words, i: int, mask: np.ndarray) -> tuple[int, int, str]:
    s, e = w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]]
    keep = ~mask
    kept = b" ".join([w.joined[a:b] for a, b in zip(s[keep].tolist(), e[keep].tolist(), strict=True)])
    return len(s), int(mask.sum()), hashlib.sha256(kept).hexdigest()


def _own(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes made different for each document of a batch."""
    return mix(h ^ mix(doc.astype(np.uint64) + np.uint64(1)))


_STATE = (
    "doc_id long, n_words long, n_removed long, kept_sha256 string, row long, text string, "
    "factor_at array<int>, factor_words array<int>, open_at array<int>, open_windows array<long>, open_anchors array<long>"
)


def parse(docs: DataFrame, index: DataFrame, window: int, gram: int) -> DataFrame:
    """Factors every document against its reference blocks, ``index(doc_id, entries)``.

    A document whose windows are all decided has its result; others keep their
    text (and ``row``, its hash, as ids may repeat), the factors and the open
    windows: those whose anchor stands in the reference, but not their words.
    """
    schema = to_arrow_schema(_parse_datatype_string(_STATE))
    rows = docs.join(index, "doc_id", "left").select("doc_id", "text", "entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lens = pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy(zero_copy_only=False)
            sizes = pc.binary_length(b.column(2).flatten().field("block")).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.concatenate(([0], np.cumsum(sizes)))
            ends = np.cumsum(lens)
            for p in in_parts(b, 1, more=upto[ends] - upto[ends - lens]):
                w = Words(_texts(p.column(1)))
                starts, found = _anchors(w, window, gram)
                h, of = w.grams(window)[starts], w.text_of()[starts]
                entries = p.column(2).flatten()
                owner = np.repeat(np.arange(p.num_rows), pc.fill_null(pc.list_value_length(p.column(2)), 0).to_numpy(zero_copy_only=False))
                ref = Words(_texts(entries.field("block")))
                block = ref.text_of()
                block_end = ref.first[1:][block]
                # of each document's blocks the windows, by hash and then by place
                whole = np.flatnonzero(ref.whole(window))
                key = _own(ref.grams(window)[whole], owner[block[whole]])
                order = np.argsort(key, kind="stable")
                key, order = key[order], whole[order]
                own = _own(h, of)
                low, high = np.searchsorted(key, own), np.searchsorted(key, own, side="right")
                known = np.isin(_own(found, of), _own(entries.field("anchor").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), owner))
                bound = np.searchsorted(of, np.arange(p.num_rows + 1))
                out = []
                for i, (doc, text) in enumerate(zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True)):
                    part = np.arange(bound[i], bound[i + 1])
                    hit = part[high[part] > low[part]]
                    spans, missed = factors(w, ref, starts[hit], int(w.first[i + 1]), low[hit], high[hit], order, block_end, window)
                    spans = [(s - int(w.first[i]), n) for s, n in spans]
                    open_ = part[known[part] & ((high[part] == low[part]) | np.isin(starts[part], missed))]
                    n = int(w.count[i])
                    if len(open_):
                        row = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)
                        out.append((
                            doc, n, None, None, row, text, [s for s, _ in spans], [k for _, k in spans],
                            (starts[open_] - w.first[i]).tolist(), h[open_].view(np.int64).tolist(), found[open_].view(np.int64).tolist(),
                        ))
                    else:
                        out.append((doc, *_digest(w, i, covered(spans, n)), *[None] * 7))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema
                )

    return rows.mapInArrow(run, _STATE)


def finish(left: DataFrame, window: int) -> DataFrame:
    """Results from (doc_id, text, factor_at, factor_words, more): factors and the windows found since."""
    result = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in in_parts(b, 1):
                w, out = Words(_texts(p.column(1))), []
                for i, (doc, at, words, more) in enumerate(zip(*(p.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True)):
                    spans = [*zip(at, words, strict=True), *((s, window) for s in more or [])]
                    out.append((doc, *_digest(w, i, covered(spans, int(w.count[i])))))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    return left.select("doc_id", "text", "factor_at", "factor_words", "more").mapInArrow(run, result)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for ``docs(doc_id, text)``."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    scratch = Scratch(docs.sparkSession, "op10")
    found = scratch.write(anchors(docs, window, gram), "anchors")
    shared = scratch.write(
        found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .where("low < high").drop("high"), "shared",
    )
    refs = scratch.write(reference(shared, docs, window, gram), "reference")
    # a set: rows of one id have an anchor each, but need its blocks once
    entries = (
        found.join(refs, "anchor").where("doc_id > low")
        .groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "block")).alias("entries"))
    )
    entries = scratch.write(entries, "entries")
    scratch.drop("anchors", "shared", "reference")
    state = scratch.write(parse(docs, entries, window, gram), "state")
    scratch.drop("entries")
    decided = state.where("kept_sha256 IS NOT NULL").select("doc_id", "n_words", "n_removed", "kept_sha256")
    left = state.where("kept_sha256 IS NULL")
    open_ = left.select(
        "doc_id", "row", F.explode(F.arrays_zip("open_at", "open_windows", "open_anchors")).alias("o")
    ).select("doc_id", "row", F.col("o.open_at").alias("at"), F.col("o.open_windows").alias("h"), F.col("o.open_anchors").alias("k"))
    lows = open_.groupBy("h", "k").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    more = (
        open_.join(lows, ["h", "k"]).where("doc_id > low")
        .groupBy("doc_id", "row").agg(F.collect_set("at").alias("more"))
    )
    return decided.unionByName(finish(left.join(more, ["doc_id", "row"], "left"), window))


def op10_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
