"""Best-fit packing by a grouping genetic algorithm (operator 3).

Documents become token pieces of at most ``capacity``; pieces are packed into
as few sequences as can be.  Pieces of equal length are interchangeable, so a
chromosome is a list of bins and a bin a tuple of lengths.  Crossover injects
whole well-filled bins of one parent, drops the other parent's bins that would
use a piece twice, and best-fits what was displaced.  Islands are disjoint sets
of pieces, evolved in parallel; elite bins migrate around a ring as length
patterns, which an island takes over as far as its own pieces allow.  Bins that
islands could not fill well are packed again together, in a tree of groups.

Cases: a null or empty text is the end token alone; only documents above the
capacity are cut, the first piece taking the remainder, however long they are;
repeated rows are packed each; pieces of equal length are placed by their row
numbers, so any of them may come first; a null doc_id is kept; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import bisect
import json
import os
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, in_parts, table

CAPACITY = 1024
END_ID = 2
#: Pieces of an island, and how many islands' pieces the last group may have.
ISLAND_PIECES, LAST_ISLANDS = 4096, 4
POPULATION, GENERATIONS, ELITES = 8, 1500, 48
#: Pieces times generations of an island, and of the last group, if the lower bound is not met before.
ISLAND_WORK, LAST_WORK = 200_000, 1_000_000
#: Populations that evolve side by side on the last group's pieces.
RACES = 4
#: Bins of a child that may exchange pieces with the displaced ones.
EXCHANGED = 512
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, spread long"


# ---- tokens -----------------------------------------------------------------

def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Token ids of whole batches, as ``tokenizers`` gives them.

    Byte-level BPE never merges across a space that follows a letter, digit or
    mark, so a text may be cut before such spaces.  The distinct slices of a
    batch are encoded once, put together to one text, and looked up by place.
    That text goes through tiktoken, which has the same vocabulary and merges
    several times faster; a batch that holds a special token's string goes
    through ``tokenizers`` itself.
    """

    def __init__(self, path: str, ranks: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            pairs = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("slices", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})
        self.width = np.zeros(max(pairs.values()) + 1, dtype=np.int64)
        self.width[list(pairs.values())] = [len(x) for x in pairs]
        self.path, self.tok, self.special = path, None, special_tokens(path)

    def exact(self, text: bytes) -> np.ndarray:
        if self.tok is None:
            self.tok = _tokenizer(self.path)
        return np.array(self.tok.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype=np.uint32)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Marks the spaces before which the bytes may be cut; one place more than bytes."""
        prev, lead = data[1:-1], data[:-2]
        safe = ((prev > 32) & (prev < 127)) | ((prev >= 128) & (lead >= 0xC3) & (lead <= 0xC5))
        marks = np.zeros(len(data) + 1, dtype=bool)
        marks[2:-1] = (data[2:] == 32) & safe
        return marks

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of the texts in them)."""
        raw = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
        if any(s in x for x in raw for s in self.special):
            own = [self.exact(x) for x in raw]
            return np.concatenate(own), np.concatenate(([0], np.cumsum([len(x) for x in own])))
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        joined = b"".join(raw)
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(raw) + 1, np.int64)
        marks = self.cuts(np.frombuffer(joined, np.uint8))
        marks[bounds] = True
        starts = np.flatnonzero(marks)
        marks[:] = False
        marks[bounds] = True  # now the texts' bounds alone
        edge = marks[starts[:-1]] | marks[starts[1:]]
        starts = starts[:-1]
        slices = pa.Array.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(joined))), pa.py_buffer(joined)]
        )
        inner = slices.filter(pa.array(~edge)).dictionary_encode()
        flat, first = self.inner(inner.dictionary)
        # ids of slice k: flat[first[at[k]] : first[at[k]] + n[k]]
        ends = [
            self.fast.encode_to_numpy(x.decode("utf-8", "replace"), disallowed_special=())
            for x in slices.filter(pa.array(edge)).to_pylist()
        ]
        at, n = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        i = inner.indices.to_numpy()
        at[~edge], n[~edge] = first[i], (first[1:] - first[:-1])[i]
        n[edge] = sizes = np.array([len(x) for x in ends], dtype=np.int64)
        at[edge] = len(flat) + np.cumsum(sizes) - sizes
        flat = np.concatenate([flat, *ends])
        upto = np.cumsum(n)
        out = flat[np.repeat(at - (upto - n), n) + np.arange(upto[-1])]
        return out, np.concatenate(([0], upto))[np.searchsorted(starts, bounds)]

    def inner(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of slices that begin with a cut and end before one."""
        if not len(distinct):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        offsets = np.frombuffer(distinct.buffers()[1], np.int64, len(distinct) + 1, distinct.offset * 8)
        text = distinct.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]].decode()
        ids = self.fast.encode_to_numpy(text, disallowed_special=())
        place = np.concatenate(([0], np.cumsum(self.width[ids])))
        return ids.astype(np.uint32), np.searchsorted(place, offsets - offsets[0])


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, ranks: str) -> Encoder:
    """One encoder for each Python worker; the driver builds none."""
    if (path, ranks) not in _ENCODERS:
        _ENCODERS[path, ranks] = Encoder(path, ranks)
    return _ENCODERS[path, ranks]


def special_tokens(path: str) -> tuple[bytes, ...]:
    """The added tokens of a tokenizer file; its vocabulary is not built for them."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    tokens, _ = json.JSONDecoder().raw_decode(text, text.index("[", text.index('"added_tokens"')))
    return tuple(t["content"].encode() for t in tokens)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first takes the remainder."""
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(s, capacity) for s in range(first, n, capacity)]


def tokenize(
    docs: DataFrame, tokenizer: str, ranks: str, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``; ``spread`` is a row number that deals them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, row = encoder(tokenizer, ranks), TaskContext.get().partitionId() << 36
        for b in batches:
            for part in in_parts(b, 1):
                ids, ends = encode(part.column(1))
                out: list[tuple] = []
                for doc, i, j in zip(part.column(0).to_pylist(), ends[:-1], ends[1:], strict=True):
                    own = np.append(ids[i:j], np.uint32(end_id)).astype("<u4")
                    for k, (s, n) in enumerate(cut(len(own), capacity)):
                        out.append((doc, k, s, n, zlib.crc32(own[s : s + n].tobytes()), row + len(out)))
                row += len(out)
                cols = zip(*out, strict=True)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "spread"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


# ---- grouping genetic algorithm ----------------------------------------------

Bin = tuple[int, ...]


def best_fit(lengths: list[int], bins: list[Bin], capacity: int) -> list[Bin]:
    """Puts each length, in the order given, into the fullest bin that has room."""
    room: dict[int, list[list[int]]] = {}
    mask = 0
    for b in bins:
        gap = capacity - sum(b)
        room.setdefault(gap, []).append(list(b))
        mask |= 1 << gap
    for n in lengths:
        fits = mask >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            b = room[gap].pop()
            if not room[gap]:
                mask &= ~(1 << gap)
        else:
            gap, b = capacity, []
        b.append(n)
        room.setdefault(gap - n, []).append(b)
        mask |= 1 << (gap - n)
    return [tuple(b) for gap in sorted(room) for b in room[gap]]


def fitness(bins: list[Bin], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then unevenly filled ones (they can still be emptied)."""
    return -len(bins), sum((sum(b) / capacity) ** 2 for b in bins)


def take(bins: list[Bin], left: list[int]) -> list[Bin]:
    """The bins whose pieces are all still in ``left`` (counts), removed from it."""
    kept = []
    for b in bins:
        for i, n in enumerate(b):
            left[n] -= 1
            if left[n] < 0:
                for m in b[: i + 1]:
                    left[m] += 1
                break
        else:
            kept.append(b)
    return kept


def exchange(bins: list[Bin], displaced: list[int], capacity: int) -> tuple[list[Bin], list[int]]:
    """Gives bins one or two displaced pieces for one or two of theirs where that fills them better.

    What is displaced becomes smaller pieces, which fit into gaps more easily.
    """
    free, out = sorted(displaced), []
    for b in bins:
        gap = capacity - sum(b)
        while gap and free:
            gain, swap = 0, None
            some = [((i,), n) for i, n in enumerate(b)] + [((j, i), m + b[j]) for i, m in enumerate(b) for j in range(i)]
            for places, old in some:
                limit = old + gap
                p = bisect.bisect_right(free, limit) - 1
                if p >= 0 and free[p] - old > gain:
                    gain, swap = free[p] - old, (places, (p,))
                x, y = 0, p
                while x < y and gain < gap:
                    both = free[x] + free[y]
                    if both > limit:
                        y -= 1
                    else:
                        if both - old > gain:
                            gain, swap = both - old, (places, (x, y))
                        x += 1
                if gain == gap:
                    break
            if swap is None:
                break
            out_places, in_places = swap
            back = [b[i] for i in out_places]
            b = tuple(n for i, n in enumerate(b) if i not in out_places) + tuple(free[p] for p in in_places)
            for p in reversed(in_places):
                del free[p]
            for n in back:
                bisect.insort(free, n)
            gap -= gain
        out.append(b)
    return out, free


def crossover(a: list[Bin], injected: list[Bin], counts: list[int], capacity: int, rng: random.Random | None = None) -> list[Bin]:
    """Bins injected whole, then a's bins without duplicates, then best fit.

    With ``rng`` some bins first exchange pieces with the displaced ones, and
    these come in an order a little off their lengths'.
    """
    left = counts[:]
    child = take(injected, left) + take(a, left)
    displaced = [n for n in range(capacity, 0, -1) for _ in range(left[n])]
    if rng is not None:
        if rng.random() < 0.5:
            rng.shuffle(child)
            some, displaced = exchange(child[:EXCHANGED], displaced, capacity)
            child = some + child[EXCHANGED:]
        displaced = [n for _, n in sorted(((n * rng.uniform(0.85, 1.15), n) for n in displaced), reverse=True)]
    return best_fit(displaced, child, capacity) if displaced else child


def well_filled(bins: list[Bin], capacity: int) -> list[Bin]:
    return [b for b in bins if sum(b) >= capacity - capacity // 128]


def evolve(
    lengths: list[int], capacity: int, seed: int, start: list[list[Bin]] = (), migrants: list[Bin] = (),
    population: int = POPULATION, work: int = ISLAND_WORK,
) -> list[Bin]:
    """The best packing found for ``lengths``; the same for the same arguments.

    Plain best-fit is among the first individuals, so no result is worse.
    """
    counts = np.bincount(lengths, minlength=capacity + 1).tolist()
    rng = random.Random(seed)
    least = -(-sum(lengths) // capacity)
    ranked = lambda bins: (fitness(bins, capacity), bins)
    first = ranked(best_fit(sorted(lengths, reverse=True), [], capacity))
    pool = [*(ranked(list(x)) for x in start), first]
    if migrants:
        pool.append(ranked(crossover(pool[0][1], migrants, counts, capacity)))
    pool.sort(key=lambda x: x[0], reverse=True)
    for _ in range(min(GENERATIONS, max(population, work // max(1, len(lengths))))):
        best = pool[0][1]
        if len(best) <= least:
            break
        good = well_filled(pool[rng.randrange(len(pool))][1], capacity)
        rng.shuffle(good)
        # the poorest bins and a few others are given up, so that others can be completed
        order = sorted(best, key=sum)
        rest = order[2:]
        rng.shuffle(rest)
        few = rng.randint(2, max(3, len(rest) // 10))
        child = ranked(crossover(rest[few:], good[: rng.randint(0, few)], counts, capacity, rng))
        if len(pool) < population:
            pool.append(child)
        elif child[0] >= pool[-1][0]:
            pool[-1] = child
        pool.sort(key=lambda x: x[0], reverse=True)
    return pool[0][1]


def _place(pdf: pd.DataFrame, bins: list[Bin]) -> pd.DataFrame:
    """Gives the pieces (sorted by length, spread) their bin and offset."""
    slots: dict[int, list[tuple[int, int]]] = {}
    for i, b in enumerate(bins):
        at = 0
        for n in b:
            slots.setdefault(n, []).append((i, at))
            at += n
    pdf = pdf.sort_values(["length", "spread"], kind="stable")
    each = [slots[n].pop() for n in pdf["length"].tolist()]
    pdf["bin"], pdf["offset"] = [x[0] for x in each], [x[1] for x in each]
    return pdf


def _bins(pdf: pd.DataFrame) -> list[Bin]:
    out: dict[int, list[int]] = {}
    for b, n in zip(pdf["bin"].tolist(), pdf["length"].tolist(), strict=True):
        out.setdefault(b, []).append(n)
    return [tuple(out[b]) for b in sorted(out)]


_COLS = ["doc_id", "piece", "start", "length", "ids_crc32", "spread"]
_ROWS = "doc_id long, piece int, start long, length long, ids_crc32 long, spread long, island long, bin long, offset long, pattern array<long>"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, spread long, sequence_id long, offset long, open boolean, island long"


def _found(key: int, pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """An island's first packing, and its fullest bins as patterns for its neighbour."""
    bins = evolve(pdf["length"].tolist(), capacity, key)
    out = _place(pdf, bins).assign(pattern=None)
    elite = sorted({tuple(sorted(b, reverse=True)) for b in well_filled(bins, capacity)}, key=lambda b: (-sum(b), len(b), b))
    more = pd.DataFrame({"island": key, "pattern": [list(b) for b in elite[:ELITES]]})
    every = pd.concat([out, more], ignore_index=True)[[*_COLS, "island", "bin", "offset", "pattern"]]
    return every.astype({k: "Int64" for k in every.columns if k != "pattern"})


def _settled(key: int, pdf: pd.DataFrame, capacity: int, level: int, last: bool) -> pd.DataFrame:
    """A group's packing, from the bins its pieces are in and the migrants; bins with room are open unless it is the last."""
    mine = pdf[pdf["spread"].notna()].copy()
    if mine.empty:
        return pd.DataFrame({c: pd.Series(dtype="Int64") for c in (*_COLS, "sequence_id", "offset", "open", "island")}).astype({"open": bool})
    migrants = sorted(tuple(int(x) for x in p) for p in pdf["pattern"] if p is not None)
    for c in (*_COLS, "bin", "offset"):
        mine[c] = mine[c].astype("Int64")
    start = [_bins(mine)] if mine["bin"].notna().all() else []
    bins = evolve(mine["length"].astype(int).tolist(), capacity, key + level, start, migrants, work=LAST_WORK if last else ISLAND_WORK)
    mine = _place(mine, bins)
    roomy = sorted((i for i, b in enumerate(bins) if sum(b) < capacity and not last), key=lambda i: sum(bins[i]))
    upto = np.searchsorted(np.cumsum([len(bins[i]) for i in roomy]), 3 * len(mine) // 4, side="right")
    mine["open"] = mine["bin"].isin(roomy[:upto]).astype(bool)
    mine["island"] = key
    # above all numbers of full pieces, which are row numbers of a partition
    mine["sequence_id"] = (1 << 62) + (level << 54) + (key << 24) + mine["bin"]
    return mine[[*_COLS, "sequence_id", "offset", "open", "island"]]


def _settling(capacity: int, level: int, last: bool):
    return lambda key, pdf: _settled(int(key[0]), pdf, capacity, level, last)


def pack(pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY, island_pieces: int = ISLAND_PIECES) -> DataFrame:
    """Adds sequence_id and offset to written ``pieces`` (see ``PIECES``).

    Islands evolve, send elites around the ring and evolve again.  Of the bins
    with room left the poorest, with three quarters of an island's pieces at most,
    are dealt anew to fewer islands, until all fit one group; on its few pieces several
    populations evolve, of which the best is taken.
    """
    full = pieces.where(F.col("length") >= capacity).select(
        *_COLS, F.col("spread").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    none = lambda t: F.lit(None).cast(t)
    rest = pieces.where(F.col("length") < capacity).withColumns({"bin": none("long"), "offset": none("long"), "pattern": none("array<long>")})
    key, done, level = "spread", full, 0
    while True:
        n = rest.count()
        last = n <= LAST_ISLANDS * island_pieces
        groups = RACES if last else -(-n // island_pieces)
        if last:
            dealt = rest.withColumn("island", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(RACES - 1).cast("long"))))
        else:
            dealt = rest.withColumn("island", F.pmod(F.xxhash64(key, F.lit(level)), F.lit(groups)))
        if level == 0 and not last:
            first = scratch.write(dealt.repartition(groups, "island").groupBy("island").applyInPandas(lambda k, pdf: _found(int(k[0]), pdf, capacity), _ROWS), "first")
            island = F.when(F.col("pattern").isNotNull(), (F.col("island") + 1) % groups).otherwise(F.col("island"))
            dealt = first.withColumn("island", island)
        # a task for each island: their few bytes would be read by one
        dealt = dealt.repartition(groups, "island")
        settled = scratch.write(dealt.groupBy("island").applyInPandas(_settling(capacity, level, last), _PLACED), f"level{level}")
        if last:
            bins = settled.groupBy("island").agg(F.count_distinct("sequence_id").alias("n"))
            best = bins.agg(F.min_by("island", F.struct("n", "island")).alias("island"))
            return done.unionByName(settled.join(F.broadcast(best), "island", "left_semi").drop("open", "island")).drop("spread")
        done = done.unionByName(settled.where("NOT open").drop("open", "island"))
        rest = settled.where("open").select(*_COLS, F.col("sequence_id").alias("bin"), "offset", none("array<long>").alias("pattern"))
        key, level = "bin", level + 1


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_pack(spark: SparkSession, sf_dir: str, name: str = "op3") -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, name)


def pack_documents(docs: DataFrame, name: str = "op3") -> DataFrame:
    scratch = Scratch(docs.sparkSession, name)
    pieces = scratch.write(tokenize(docs, vocabulary(), vocabulary(RANKS)), "pieces")
    return pack(pieces, scratch)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: the packed pieces of what the mix takes."""
    return pack_documents(docs.select("doc_id", "text"), "pack")
