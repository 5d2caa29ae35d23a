"""Approximate nearest neighbours: a robust-pruned directed graph for each shard, searched with a beam.

Equal vectors become one entry with its smallest ids (as many as a result can need), so large groups of copies
neither crowd the graph nor lose ids. Entries are dealt by hash to shards of MOST_ROWS rows and SHARD_BYTES of vectors at most, and to no
fewer shards than there are cores if that leaves each LEAST_ROWS. A shard's beam grows with its rows (``beam_of``): recall was
measured at that size, and the test holds it to 0.9 there. In a shard the
graph starts at random; greedy searches for every node propose neighbours, and pruning keeps the nearest candidate
and drops those that are ``alpha`` times nearer to it than to the node, first with alpha 1, then relaxed. Every
query runs through every shard with a beam, block by block as its rows stream in, and the shards' nearest are merged.

Memory: one shard and one block of queries in a task. All rows are indexed; recall against brute force is tested.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, as
queries or candidates; vectors of different lengths are never compared; ties go to the smaller id; repeated rows of an id
count once; of an id with different vectors each is a candidate, the id comes once, at its nearest, and asks by the
smallest; an empty table gives no rows; other columns are not read. Ids are integers. Vectors may be of any finite
magnitude: the graph works on them scaled by a power of two, distances are taken on the originals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, written

SHARD_BYTES, MOST_ROWS, LEAST_ROWS, DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 64 << 20, 32_768, 8192, 32, 64, 128, 1.2
_BLOCK = 1024


def beam_of(rows: int) -> int:
    """Beam of a search in so many rows: SEARCH_BEAM up to 16,384 of them, then in proportion."""
    return SEARCH_BEAM * max(rows, 16_384) // 16_384


class Graph:
    """Vectors of one shard, at most DEGREE neighbours for each, and the entry point."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 11) -> None:
        self.exact = vectors
        self.scale = 2.0 ** np.frexp(np.abs(vectors).max(initial=0))[1].clip(-1000, 1000)
        self.x = (vectors / self.scale).astype(np.float32)
        self.norm = (self.x**2).sum(axis=1)
        n, rng = len(vectors), np.random.default_rng(seed)
        self.degree = min(degree, max(1, n - 1))
        self.start = int(((self.x - self.x.mean(axis=0)) ** 2).sum(axis=1).argmin())
        self.out = np.full((n, self.degree), -1, np.int64)
        if n > 1:
            self.out[:] = (np.arange(n)[:, None] + rng.integers(1, n, (n, self.degree))) % n
            for relaxed in (1.0, alpha):
                order = rng.permutation(n)
                for at in range(0, n, _BLOCK):
                    self._insert(order[at : at + _BLOCK], beam, relaxed)

    def _distances(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its own row of ids; infinite at -1."""
        d = self.norm[ids] - 2 * np.matmul(self.x[ids], q[:, :, None])[:, :, 0] + (q**2).sum(axis=1)[:, None]
        return np.where(ids < 0, np.inf, np.maximum(d, 0))

    def nearest(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances) of the beam after greedy search, nearest first; -1 where there are fewer."""
        b = len(q)
        ids, done = np.full((b, beam), -1, np.int64), np.ones((b, beam), bool)
        far = np.full((b, beam), np.inf, np.float32)
        ids[:, 0], done[:, 0] = self.start, False
        far[:, 0] = self._distances(q, ids[:, :1])[:, 0]
        seen = np.zeros((b, len(self.x)), bool)
        seen[:, self.start] = True
        active = np.arange(b)
        while len(active):
            best = np.where(done[active], np.inf, far[active]).argmin(axis=1)
            open_ = ~done[active, best]
            active, best = active[open_], best[open_]
            if not len(active):
                break
            at = ids[active, best]
            done[active, best] = True
            new = self.out[at]
            rows = active[:, None]
            fresh = (new >= 0) & ~seen[rows, new]
            seen[np.broadcast_to(rows, new.shape)[fresh], new[fresh]] = True
            new = np.where(fresh, new, -1)
            d = self._distances(q[active], new).astype(np.float32)
            both = np.concatenate([far[active], d], axis=1)
            keep = np.argsort(both, axis=1, kind="stable")[:, :beam]
            far[active] = np.take_along_axis(both, keep, axis=1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], new], axis=1), keep, axis=1)
            done[active] = np.take_along_axis(np.concatenate([done[active], new < 0], axis=1), keep, axis=1)
        return ids, far

    def _pruned(self, nodes: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
        """Robust pruning of each node's candidates (-1: none) to at most ``degree`` of them."""
        c = np.where(candidates == nodes[:, None], -1, candidates)
        c = np.sort(c, axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        d = self._distances(self.x[nodes], c)
        order = np.argsort(d, axis=1, kind="stable")
        c, d = np.take_along_axis(c, order, axis=1), np.take_along_axis(d, order, axis=1)
        v = self.x[c]
        between = self.norm[c][:, :, None] + self.norm[c][:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        alive = c >= 0
        out, rows = np.full((len(nodes), self.degree), -1, np.int64), np.arange(len(nodes))
        for k in range(self.degree):
            if not alive.any():
                break
            pick = alive.argmax(axis=1)
            some = alive[rows, pick]
            out[some, k] = c[rows, pick][some]
            alive &= alpha * alpha * between[rows, pick] > d
            alive[rows, pick] = False
            alive[~some] = False
        return out

    def _insert(self, nodes: np.ndarray, beam: int, alpha: float) -> None:
        found, _ = self.nearest(self.x[nodes], beam)
        self.out[nodes] = self._pruned(nodes, np.concatenate([found, self.out[nodes]], axis=1), alpha)
        source, target = np.repeat(nodes, self.degree), self.out[nodes].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        ends, first, n = np.unique(target, return_index=True, return_counts=True)
        back = np.full((len(ends), int(n.max())), -1, np.int64)
        back[np.repeat(np.arange(len(ends)), n), np.arange(len(target)) - np.repeat(first, n)] = source
        for at in range(0, len(ends), _BLOCK):
            e = ends[at : at + _BLOCK]
            some = back[at : at + _BLOCK]
            some = some[:, : max(1, int((some >= 0).sum(axis=1).max()))]
            self.out[e] = self._pruned(e, np.concatenate([self.out[e], some], axis=1), alpha)

    def search(self, q: np.ndarray, k: int, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest found, by distances in double precision on the original vectors."""
        beam = beam or beam_of(len(self.x))
        ids, _ = self.nearest(np.clip(q / self.scale, -1e15, 1e15).astype(np.float32), max(beam, k))
        far = max(self.scale, 2.0 ** int(np.frexp(np.abs(q).max(initial=0))[1].clip(-1000, 1000)))
        far = 1.0 if 1e-100 < far < 1e150 else far  # else squares would be zero or infinite
        d = far * np.sqrt(((self.exact[ids] / far - q[:, None, :] / far) ** 2).sum(axis=2))
        d[ids < 0] = np.inf
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(d, order, axis=1)


def _usable(v: Column) -> Column:
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & whole & F.exists(v, lambda x: x != 0)


def entries(vectors: DataFrame, keep: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(entry long, ids array, v array<double>): distinct vectors with their ``keep`` smallest ids."""
    rows = only(vectors, id=vec_id, v=embedding).withColumn("v", F.col("v").cast("array<double>"))
    rows = rows.filter(F.col("id").isNotNull() & _usable(F.col("v")))
    ranked = rows.withColumn("k", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("k") <= keep)
    return ranked.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].cast("long").alias("entry"), "ids", "v")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int | None = None, beam: int | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found among all other rows, nearest first."""
    index = written(entries(vectors, k + 1, vec_id, embedding), "entries")
    n, width = index.agg(F.count("*"), F.max(F.size("v"))).first()
    most = shard_rows or max(1, min(MOST_ROWS, SHARD_BYTES // (8 * (width or 1))))
    shards = max(1, -(-n // most), 0 if shard_rows else min(vectors.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS))
    asked = only(queries, id=vec_id, v=embedding).withColumn("v", F.col("v").cast("array<double>"))
    asked = asked.filter(F.col("id").isNotNull() & _usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), F.col("id").cast("long").alias("id"), F.array().cast("array<bigint>").alias("ids"), "v")
    stored = index.select(F.pmod(F.xxhash64("entry"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), F.col("entry").alias("id"), F.col("ids").cast("array<bigint>").alias("ids"), "v")
    rows = stored.unionAll(asked).withColumn("dim", F.size("v"))
    dealt = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "dim", "kind", "id")
    schema = "query_id long, ids array<bigint>, score double"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ids, graph = None, [], [], None
        for part in parts:
            head = np.stack([part.column(i).to_numpy() for i in (0, 5, 1)], axis=1)  # shard, dim, kind
            edges = np.flatnonzero((head[1:] != head[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(head)], strict=True):
                if hi == lo:
                    continue
                some = part.slice(lo, hi - lo)
                if tuple(head[lo, :2]) != key:
                    key, held, ids, graph = tuple(head[lo, :2]), [], [], None
                if head[lo, 2] == 0:
                    held.append(_matrix(some.column(4)))
                    ids += some.column(3).to_pylist()
                    continue
                if not held:
                    continue  # no stored vector of this length here
                if graph is None:
                    graph = Graph(np.concatenate(held))
                for at in range(0, some.num_rows, _BLOCK):
                    block = some.slice(at, _BLOCK)
                    got, score = graph.search(_matrix(block.column(4)), k + 1, beam)
                    q = np.repeat(block.column(2).to_numpy(), got.shape[1])
                    real = np.isfinite(score.ravel())
                    yield pa.RecordBatch.from_arrays([pa.array(q[real]), pa.array([ids[i] for i in got.ravel()[real]], pa.list_(pa.int64())), pa.array(score.ravel()[real])], names=["query_id", "ids", "score"])

    found = dealt.mapInArrow(run, schema)
    each = found.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    each = each.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
