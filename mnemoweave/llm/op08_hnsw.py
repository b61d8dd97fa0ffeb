"""Near-duplicate embeddings by HNSW graphs (operator 8).

Vectors of a label are dealt to shards; each shard gets a hierarchical navigable
small-world graph, and every vector of the label queries every shard.  A beam is
widened until it has passed below the threshold and until a sample of queries,
compared with all of the shard, shows the wanted recall; the sample holds vectors
of the shard and of the label's other shards.  Pairs are verified by
cosine in double precision and counted where they are found; only a spanning
forest of the links leaves a task, for the union of components.

Cases: a null, zero, ragged or non-finite vector, or a null label, links with
nothing and is its own component; equal vectors are held once in a graph and
counted each, named by their smallest id; repeated vec_ids give a row each (a
null id too, with a null component); a cosine of exactly the threshold links;
vectors of any length that their label shares are compared; an empty table gives
no rows; extra columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, table
from ._graph import components

MIN_COSINE = 0.93
#: A shard holds at most so many vectors, and bytes of them in double precision.
SHARD_VECTORS, SHARD_BYTES = 50_000, 128 << 20
#: So many vectors of a label meet a shard's graph in one slot.
QUERY_ROWS = 131_072
M, EF_BUILD, EF_SEARCH = 12, 48, 32
AUDIT_QUERIES, AUDIT_RECALL = 64, 0.98
_BLOCK = 512
#: Single precision may miss the threshold by this much.
_SLACK = 1e-4


class Hnsw:
    """A graph over unit vectors; searches run in lock step for many queries."""

    def __init__(self, x: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 7) -> None:
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        n = len(x)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(m)).astype(int), 8)
        self.order = np.argsort(-self.level, kind="stable")  # upper levels first
        self.top = int(self.level.max()) if n else 0
        self.entry = int(self.order[0]) if n else -1
        self.links = [np.full((n, (2 * m if lv == 0 else m)), -1, np.int64) for lv in range(self.top + 1)]
        self._build(m, ef)

    def _build(self, m: int, ef: int) -> None:
        done, n = 1, len(self.x)
        while done < n:
            batch = self.order[done : done + min(_BLOCK, max(1, done // 2))]
            q = self.x[batch]
            start = np.full((len(batch), 1), self.entry)
            for lv in range(self.top, -1, -1):
                here = np.flatnonzero(self.level[batch] >= lv)
                ids, sims = self._beam(q, start, lv, ef if len(here) else 1)
                if len(here):
                    # the batch's own members are not in the graph yet: compare them directly
                    own = q[here] @ q[here].T
                    np.fill_diagonal(own, -2)
                    ids_h = np.concatenate([ids[here], np.broadcast_to(batch[here], (len(here), len(here)))], axis=1)
                    sims_h = np.concatenate([sims[here], own], axis=1)
                    self._connect(batch[here], ids_h, sims_h, lv, m)
                start = ids[:, :1]
            done += len(batch)

    def _select(self, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """Nearest first, skipping a candidate nearer to a chosen one than to the
        node; free places then go to the nearest that were skipped."""
        width = min(ids.shape[1], 4 * m)
        part = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        ids, sims = np.take_along_axis(ids, part, 1), np.take_along_axis(sims, part, 1)
        ids = np.where(sims > -1.5, ids, -1)
        vec = self.x[np.maximum(ids, 0)]
        near = np.einsum("qid,qjd->qij", vec, vec)
        chosen = np.zeros(ids.shape, bool)
        for j in range(width):
            shaded = (near[:, j, :] > sims[:, j, None]) & chosen
            chosen[:, j] = (ids[:, j] >= 0) & ~shaded.any(axis=1) & (chosen.sum(axis=1) < m)
        rank = np.argsort(np.where(chosen, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :m]
        return np.take_along_axis(ids, rank, 1)

    def _connect(self, nodes, ids, sims, lv, m) -> None:
        links = self.links[lv]
        chosen = self._select(ids, sims, m)
        links[nodes, : chosen.shape[1]] = chosen
        src, dst = np.repeat(nodes, chosen.shape[1]), chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, first, count = np.unique(dst, return_index=True, return_counts=True)
        room = links.shape[1]
        for at in range(0, len(targets), _BLOCK):
            t, f, c = targets[at : at + _BLOCK], first[at : at + _BLOCK], count[at : at + _BLOCK]
            extra = np.full((len(t), int(c.max())), -1)
            col = np.arange(extra.shape[1])
            mask = col < c[:, None]
            extra[mask] = src[(f[:, None] + col)[mask]]
            every = np.concatenate([links[t], extra], axis=1)
            s = np.einsum("qd,qjd->qj", self.x[t], self.x[np.maximum(every, 0)])
            every_sorted = np.sort(every, axis=1)
            s[every < 0] = -2
            twice = np.zeros(every.shape, bool)  # an id that stands twice counts once
            o = np.argsort(every, axis=1, kind="stable")
            same = np.zeros(every.shape, bool)
            same[:, 1:] = every_sorted[:, 1:] == every_sorted[:, :-1]
            np.put_along_axis(twice, o, same, 1)
            s[twice] = -2
            kept = self._select(every, s, room)
            links[t] = -1
            links[t[:, None], np.arange(kept.shape[1])] = kept

    def _beam(self, q, start, lv: int, ef: int):
        """Beams (ids, similarities), best first; ids are -1 where there are fewer."""
        links, nq = self.links[lv], len(q)
        seen = np.zeros((nq, len(self.x)), bool)
        ids = np.full((nq, ef), -1)
        sims = np.full((nq, ef), -2.0, np.float32)
        open_ = np.zeros((nq, ef), bool)
        w = min(ef, start.shape[1])
        ids[:, :w] = start[:, :w]
        sims[:, :w] = np.where(ids[:, :w] >= 0, np.einsum("qd,qjd->qj", q, self.x[np.maximum(ids[:, :w], 0)]), -2)
        open_[:, :w] = ids[:, :w] >= 0
        np.put_along_axis(seen, np.maximum(ids[:, :w], 0), True, 1)
        live = np.arange(nq)
        while len(live):
            best = np.where(open_[live], sims[live], -3).argmax(axis=1)
            has = open_[live, best]
            live, best = live[has], best[has]
            if not len(live):
                break
            open_[live, best] = False
            nb = links[ids[live, best]]
            fresh = nb >= 0
            at = np.maximum(nb, 0)
            fresh &= ~seen[live[:, None], at]
            r, c = np.nonzero(fresh)
            seen[live[r], at[r, c]] = True
            s = np.full(nb.shape, -2.0, np.float32)
            s[r, c] = np.einsum("kd,kd->k", q[live[r]], self.x[at[r, c]])
            go = (s > sims[live, -1:]).any(axis=1)
            rows = live[go]
            if len(rows):
                all_i = np.concatenate([ids[rows], nb[go]], axis=1)
                all_s = np.concatenate([sims[rows], s[go]], axis=1)
                all_o = np.concatenate([open_[rows], fresh[go]], axis=1)
                o = np.argsort(-all_s, axis=1, kind="stable")[:, :ef]
                ids[rows], sims[rows] = np.take_along_axis(all_i, o, 1), np.take_along_axis(all_s, o, 1)
                open_[rows] = np.take_along_axis(all_o, o, 1) & (sims[rows] > -1.5)
                ids[rows] = np.where(sims[rows] > -1.5, ids[rows], -1)
        return ids, sims

    def near(self, q: np.ndarray, least: float, ef: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (query, node) pairs with similarity >= ``least``.

        A beam that ends above it is widened and searched again; one that would
        become wider than a sixteenth of the graph (or 512) reads the graph's
        vectors one by one instead, which costs less from there on.
        """
        n = len(self.x)
        size = max(1, min(_BLOCK, (64 << 20) // max(1, n)))
        for at in range(0, len(q), size):
            todo = np.arange(at, min(at + size, len(q)))
            start = np.full((len(todo), 1), self.entry)
            for lv in range(self.top, 0, -1):
                start = self._beam(q[todo], start, lv, 1)[0]
            width = min(ef, n)
            while len(todo):
                ids, sims = self._beam(q[todo], start, 0, width)
                full = (ids[:, -1] >= 0) & (sims[:, -1] >= least) & (width < n)
                r, c = np.nonzero((sims >= least) & (ids >= 0) & ~full[:, None])
                yield todo[r], ids[r, c]
                todo, start = todo[full], ids[full][:, :8]
                width *= 4
                if width > min(512, n // 16):
                    break
            for s in range(0, len(todo), 64):
                r, c = np.nonzero(q[todo[s : s + 64]] @ self.x.T >= least)
                yield todo[s : s + 64][r], c

    def to_bytes(self) -> bytes:
        """The links; the vectors are kept once, as they came."""
        out = io.BytesIO()
        np.savez(out, entry=self.entry, **{f"l{i}": a.astype(np.int32) for i, a in enumerate(self.links)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes, x: np.ndarray) -> Hnsw:
        with np.load(io.BytesIO(data)) as f:
            g = cls.__new__(cls)
            g.x, g.entry, g.top = np.ascontiguousarray(x, dtype=np.float32), int(f["entry"]), len(f.files) - 2
            g.links = [f[f"l{i}"] for i in range(g.top + 1)]
            return g


def audited(graph: Hnsw, least: float, ef: int = EF_SEARCH, wanted: float = AUDIT_RECALL, probes: np.ndarray | None = None) -> int:
    """The beam width at which the recall of a sample of the shard's vectors, and of
    ``probes`` from the label's other shards, against all of the shard is as wanted."""
    n = len(graph.x)
    sample = np.random.default_rng(11).choice(n, min(n, AUDIT_QUERIES), replace=False)
    q = graph.x[sample]
    if probes is not None and len(probes):
        q = np.concatenate([q, probes.astype(np.float32)])
    own = np.concatenate([sample, np.full(len(q) - len(sample), -1)])
    truth = {(i, j) for i, j in zip(*(a.tolist() for a in np.nonzero(q @ graph.x.T >= least)), strict=True) if own[i] != j}
    while ef < n and truth:
        found = {p for i, j in graph.near(q, least, ef) for p in zip(i.tolist(), j.tolist(), strict=True)}
        if len(truth & found) >= wanted * len(truth):
            break
        ef *= 2
    return ef


# ---- Spark --------------------------------------------------------------------

def usable(embedding):
    """True for vectors that can link: no null or non-finite part, not zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class _Forest:
    """Keeps, of the edges it is shown, those that join two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                self.edges.append((x, y))


def graphs(keyed: DataFrame) -> DataFrame:
    """(label, dim, shard, blocks, ef, reps, copies, vectors, graph): a shard's graph, built
    and audited once, with the ids, copies and vectors behind it.  ``probe`` rows only audit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        probes, pdf = pdf[pdf.probe], pdf[~pdf.probe].sort_values("rep")
        if pdf.empty:
            return pd.DataFrame({c: [] for c in ("label", "dim", "shard", "blocks", "ef", "reps", "copies", "vectors", "graph")})
        x = np.stack(pdf.embedding.to_numpy())
        graph = Hnsw(_unit(x))
        others = _unit(np.stack(probes.embedding.to_numpy())) if len(probes) else None
        return pd.DataFrame({
            "label": pdf.label.iloc[:1], "dim": pdf.dim.iloc[:1], "shard": pdf.shard.iloc[:1], "blocks": pdf.blocks.iloc[:1],
            "ef": audited(graph, MIN_COSINE - _SLACK, probes=others), "reps": [pdf.rep.to_numpy(np.int64).tobytes()],
            "copies": [pdf.copies.to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()], "graph": [graph.to_bytes()],
        })

    return keyed.groupBy("label", "dim", "shard").applyInPandas(
        run, "label int, dim int, shard int, blocks int, ef int, reps binary, copies binary, vectors binary, graph binary"
    )


class _Shard:
    """A shard's index in a task, and the forest of the links found with it."""

    def __init__(self, row: dict, kind: np.dtype) -> None:
        x = np.frombuffer(row["vectors"], kind).reshape(-1, row["dim"])
        self.unit, self.ef = _unit(x), int(row["ef"])
        self.graph = Hnsw.from_bytes(row["graph"], self.unit)
        self.node, self.copies = np.frombuffer(row["reps"], np.int64), np.frombuffer(row["copies"], np.int64)
        self.tree = _Forest()

    def search(self, query: np.ndarray, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query ids, links of each); single precision finds, double precision decides."""
        q, n = _unit(x), np.zeros(len(query), np.int64)
        for i, j in self.graph.near(q.astype(np.float32), least - _SLACK, self.ef):
            for s in range(0, len(i), 65536):
                a, b = i[s : s + 65536], j[s : s + 65536]
                true = (np.einsum("kd,kd->k", q[a], self.unit[b]) >= least) & (query[a] != self.node[b])
                a, b = a[true], b[true]
                np.add.at(n, a, self.copies[b])
                self.tree.add(query[a], self.node[b])
        some = np.flatnonzero(n)
        return query[some], n[some]


def links(distinct: DataFrame, scratch: Scratch, least: float = MIN_COSINE, shard_vectors: int = SHARD_VECTORS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Rows (kind, a, b, n) from ``distinct(rep, embedding, label, copies)``.

    kind 0: n vectors (copies counted) link with the vector ``a`` in one shard;
    kind 1: an edge of a spanning forest.  Graphs are built once and written.
    A slot is a shard's graph and up to about ``query_rows`` of its label's
    vectors: in a task the graph comes first and the vectors stream past it, so
    an index is moved once for more bytes of queries than it has itself.
    """
    counts = distinct.groupBy("label", F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    shards = F.greatest(F.ceil(F.col("n") / shard_vectors), F.ceil(F.col("n") * F.col("dim") / (SHARD_BYTES // 8)))
    parts = counts.select(
        "label", "dim", shards.cast("int").alias("shards"), F.ceil(F.col("n") / query_rows).cast("int").alias("blocks"),
        F.ceil(F.col("n") / AUDIT_QUERIES).alias("every"),
    )
    h = F.xxhash64("rep")
    keyed = distinct.withColumn("dim", F.size("embedding")).join(parts, ["label", "dim"]).select(
        F.col("label").cast("int"), "dim", "rep", "embedding", "copies", "shards", "blocks",
        F.pmod(h, F.col("shards").cast("long")).cast("int").alias("shard"),
        F.pmod(F.shiftrightunsigned(h, 20), F.col("blocks").cast("long")).cast("int").alias("block"),
        (F.pmod(F.shiftrightunsigned(h, 36), F.col("every")) == 0).alias("sampled"),
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["label", "dim", "rep", "embedding", "copies", "blocks"]
    probes = keyed.where("sampled AND shards > 1").withColumn("own", F.col("shard")).select(*cols, every("shards").alias("shard"), "own")
    probes = probes.where("shard <> own").drop("own").withColumn("probe", F.lit(True))
    built = scratch.write(graphs(keyed.select(*cols, "shard", F.lit(False).alias("probe")).unionByName(probes)), "graphs", "none")
    queries = keyed.select("label", "dim", "rep", "embedding", "block", every("shards").alias("shard"))
    indexes = built.withColumn("block", every("blocks")).drop("blocks")
    slot = ["label", "dim", "shard", "block"]
    dealt = queries.unionByName(indexes, allowMissingColumns=True).withColumn("side", F.col("graph").isNull())
    dealt = dealt.repartition(*slot).sortWithinPartitions(*slot, "side")
    kind = np.dtype({"float": np.float32, "double": np.float64}[distinct.schema["embedding"].dataType.elementType.simpleString()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind_, a, b, n):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (np.full(len(a), kind_), a, b, n)], names=["kind", "a", "b", "n"])

        def forest(shard):
            edges = np.array(shard.tree.edges, np.int64).reshape(-1, 2)
            return out(1, edges[:, 0], edges[:, 1], np.zeros(len(edges)))

        at, shard = None, None
        for batch in batches:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            keys = np.stack([col[c].to_numpy(zero_copy_only=False) for c in slot], axis=1)
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                key = tuple(keys[s].tolist())
                if key != at:
                    if shard is not None:
                        yield forest(shard)
                    # a slot's index is its first row; without one no vector of the label is in this shard
                    at, shard = key, None
                    if col["graph"][s].is_valid:
                        shard = _Shard({c: col[c][s].as_py() for c in ("dim", "ef", "reps", "copies", "vectors", "graph")}, kind)
                        s += 1
                if shard is not None and s < e:
                    query = col["rep"].slice(s, e - s).to_numpy(zero_copy_only=False).astype(np.int64)
                    x = col["embedding"].slice(s, e - s).flatten().to_numpy(zero_copy_only=False).reshape(e - s, -1)
                    a, n = shard.search(query, x, least)
                    yield out(0, a, a, n)
        if shard is not None:
            yield forest(shard)

    return dealt.mapInArrow(run, "kind long, a long, b long, n long")


def near_duplicates(
    vectors: DataFrame, least: float = MIN_COSINE, shard_vectors: int = SHARD_VECTORS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for ``vectors(vec_id, embedding, label)``."""
    scratch = Scratch(vectors.sparkSession, "op8")
    can = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    rows = scratch.write(
        vectors.select("vec_id", "label", "embedding", can.alias("can"), F.xxhash64("embedding").alias("h")), "rows"
    )
    # equal vectors of a label stand for each other; the smallest id names them
    good = rows.where("can")
    distinct = scratch.write(
        good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "distinct"
    )
    found = scratch.write(links(distinct, scratch, least, shard_vectors, query_rows), "found")
    comp = components(found.where("kind = 1").select("a", "b"), scratch)
    direct = found.where("kind = 0").groupBy("a").agg(F.sum("n").alias("others"))
    reps = (
        distinct.select("label", "embedding", "rep", "copies")
        .join(direct, F.col("rep") == F.col("a"), "left").drop("a")
        .join(comp, F.col("rep") == F.col("node"), "left").drop("node")
        .select(
            F.col("label").alias("l"), F.col("embedding").alias("e"),
            (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    both = good.join(reps, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e"))).select(
        "vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id")
    )
    alone = rows.where("NOT can").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = both.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
