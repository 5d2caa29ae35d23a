"""SimHash near-dedup by anchor points: a covering code's words are anchors, and fingerprints meet at anchors.

A fingerprint's bit is set where over half of its shingles' XXH64 have it. Fingerprints of at most ``distance``
differing bits are linked. They are found by segments of the bits: if two fingerprints differ in at most
``distance`` bits, some segment differs in at most ``t = distance // segments``. For each segment the anchors are the words of a
covering code of radius R (for t = 1: the perfect Hamming code on 15 bits times all values of the other bits,
R = 1; for t = 0: all values, R = 0). A fingerprint's home is the anchor that covers it; it is replicated to every
anchor within R + t. A pair within t of each other in a segment therefore meets at the home of either, where the
whole fingerprints are compared. Equal fingerprints are one node beforehand.

Anchors are streamed in sorted order and compared in blocks of bounded size; an anchor gives a spanning forest of
its links, not all pairs. Components are found by star contraction on those links, cut by checkpoints.

Groups by a lower similarity, beyond any distance that a covering can afford, are exact as well, by a join of the
shingle sets themselves; see ``similar_groups``.

Defined results: null and empty texts have no words and fingerprint zero, linked like any other; a text with fewer
words than a shingle is one shingle; repeated rows each get a row; an empty table gives an empty result. Ids are integers (others
raise Spark's cast error); a text may be of any length and is read whole, one at a time; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_rows, only, unused, without, written

SHINGLE, SEED, DISTANCE = 4, 42, 4
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_COLUMN = (np.arange(8) * 256)[None, :]
PAIRS = 2_000_000  # pairs compared at once


def _mixed(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th word's hashes: the shingle hash itself, or a mix of it."""
    if j == 0:
        return h
    x = h ^ np.uint64((0x9E3779B97F4A7C15 * j) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def fingerprint(text: bytes | None, shingle: int = SHINGLE, words: int = 1, seed: int = SEED) -> list[int]:
    """``words`` signed 64-bit integers."""
    parts = (text or b"").lower().split()
    if not parts:
        return [0] * words
    ones, n = np.zeros((words, 64), np.int64), max(1, len(parts) - shingle + 1)
    for at in range(0, n, 1 << 16):
        some = parts[at : at + (1 << 16) + shingle - 1]
        k = max(1, len(some) - shingle + 1)
        whole = map(b" ".join, zip(*(some[i:] for i in range(shingle)))) if len(some) >= shingle else [b" ".join(some)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, whole, repeat(seed)), np.uint64, k)
        for j in range(words):
            cells = np.bincount((_mixed(h, j).view(np.uint8).reshape(k, 8) + _COLUMN).ravel(), minlength=2048)
            ones[j] += (cells.reshape(8, 256) @ _BITS).ravel()
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<i8").ravel().tolist()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, words: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id long, w0 .. long): each row's fingerprint."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for owner, body in rows:
            yield (owner, *fingerprint(body, shingle, words))

    names = [f"w{j}" for j in range(words)]
    return map_rows(only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long")), run, "doc_id long, " + ", ".join(f"{n} long" for n in names), pa.schema([(n, pa.int64()) for n in ("doc_id", *names)]))


class Segment:
    """Some bits of a fingerprint, and the anchors near a value of them."""

    def __init__(self, bits: np.ndarray, t: int) -> None:
        if t not in (0, 1):
            raise ValueError("segments differ in 0 or 1 bits: take more segments")
        self.bits, self.t = bits, t
        self.raw = [1 << i for i in range(15, len(bits))]

    def values(self, unpacked: np.ndarray) -> np.ndarray:
        return unpacked[:, self.bits] @ (np.int64(1) << np.arange(len(self.bits), dtype=np.int64))

    def anchors(self, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(rows, anchors, home) of all anchors within the covering radius plus t of each value."""
        every = np.arange(len(v))
        if self.t == 0:
            yield every, v, True
            return
        syndrome = np.zeros(len(v), np.int64)
        for i in range(15):
            syndrome ^= ((v >> i) & 1) * (i + 1)
        off = syndrome > 0
        home = v ^ np.where(off, np.int64(1) << np.maximum(syndrome - 1, 0), 0)
        yield every, home, True  # at distance 0 or 1
        for i, x in enumerate(self.raw):  # one bit outside the code's
            yield every, home ^ x, False
            for y in self.raw[:i]:
                yield every[~off], home[~off] ^ x ^ y, False
        for a in range(1, 16):  # at distance 2 inside the code's bits: a ^ b is the syndrome
            b = syndrome ^ a
            which = off & (b > a)
            yield every[which], v[which] ^ (1 << (a - 1)) ^ (np.int64(1) << (b[which] - 1)), False


def exact_segments(distance: int, bits: int = 64) -> list[Segment]:
    """Segments by which every pair of at most ``distance`` differing bits meets."""
    n = distance // 2 + 1  # then one of them differs in at most one bit
    t = distance // n
    if t and bits // n < 15:
        n, t = distance + 1, 0
    return [Segment(part, t) for part in np.array_split(np.arange(bits), n)]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that connect what the links (a, b) connect."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the links (a, b) themselves, that connect what all of them connect."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    root, taken = np.arange(len(nodes)), []
    while True:
        open_ = np.flatnonzero(root[x] != root[y])
        if not len(open_):
            break
        high, low = np.maximum(root[x[open_]], root[y[open_]]), np.minimum(root[x[open_]], root[y[open_]])
        order = np.lexsort((low, high))
        first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
        taken.append(open_[first])
        root[high[first]] = low[first]  # each root joins one smaller root, so no circles
        while (root != root[root]).any():
            root = root[root]
    chosen = np.concatenate(taken) if taken else np.zeros(0, np.int64)
    return a[chosen], b[chosen]


def _compared(start: np.ndarray, size: np.ndarray, home: np.ndarray, node: np.ndarray, words: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (home, other) of whole anchors, a bounded number of comparisons at a time."""
    at = 0
    while at < len(home):
        n = np.cumsum(size[at : at + PAIRS])
        k = max(1, int(np.searchsorted(n, PAIRS, side="right")))
        h, s, z = home[at : at + k], start[at : at + k], size[at : at + k]
        at += k
        for lo in range(0, int(z.max()), PAIRS):  # one home with very many others
            part = np.clip(z - lo, 0, PAIRS) if len(z) == 1 else z
            left = np.repeat(h, part)
            right = np.arange(int(part.sum())) - np.repeat(np.cumsum(part) - part, part) + np.repeat(s + lo * (len(z) == 1), part)
            away = np.zeros(len(left), np.int64)
            for w in words:
                away += np.bitwise_count(w[left] ^ w[right])
            near = (away <= distance) & (node[left] != node[right])
            if near.any():
                yield node[left[near]], node[right[near]]
            if len(z) > 1:
                break


def links(nodes: DataFrame, segments: list[Segment], distance: int, words: int = 1, real: bool = False) -> DataFrame:
    """(a long, b long): links that connect what all pairs of at most ``distance`` differing bits connect.

    ``nodes``: node (long, unique), w0.. (long). Every anchor's rows are streamed; memory holds one anchor's rows.
    With ``real`` each link is a pair within the distance; else it may lead to another node of the same component.
    """
    names = [f"w{j}" for j in range(words)]
    connect = _spanning if real else _forest

    def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 4096):
                some = part.slice(at, 4096)
                node, w = some.column("node").to_numpy(), [np.ascontiguousarray(some.column(n).to_numpy()) for n in names]
                unpacked = np.unpackbits(np.stack(w, axis=1).view(np.uint8).reshape(len(node), -1), axis=1, bitorder="little").astype(np.int64)
                for i, seg in enumerate(segments):
                    got = list(seg.anchors(seg.values(unpacked)))
                    rows = np.concatenate([r for r, _, _ in got])
                    anchor = np.concatenate([a for _, a, _ in got]) | np.int64(i << 40)
                    home = np.repeat([h for _, _, h in got], [len(r) for r, _, _ in got])
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(home), pa.array(node[rows]), *[pa.array(x[rows]) for x in w]], names=["anchor", "home", "node", *names])

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            anchor = cols[0]
            keep = len(anchor) if last else int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            held = [[c[keep:] for c in cols]] if keep < len(anchor) else []
            size = len(anchor) - keep
            if not keep:
                return
            anchor, home, node, w = anchor[:keep], cols[1][:keep], cols[2][:keep], [c[:keep].view(np.uint64) for c in cols[3:]]
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            length = np.diff(np.append(first, keep))
            group = np.repeat(np.arange(len(first)), length)
            homes = np.flatnonzero(home & (length[group] > 1))
            some_a, some_b, n = [], [], 0
            for a, b in _compared(first[group[homes]], length[group[homes]], homes, node, w, distance):
                some_a.append(a)
                some_b.append(b)
                n += len(a)
                if n > 4_000_000:
                    a, b = connect(np.concatenate(some_a), np.concatenate(some_b))
                    some_a, some_b, n = [a], [b], len(a)
            if n:
                a, b = connect(np.concatenate(some_a), np.concatenate(some_b))
                for at in range(0, len(a), 65536):
                    yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 65536]), pa.array(b[at : at + 65536])], names=["a", "b"])

        for part in parts:
            if not part.num_rows:
                continue
            held.append([part.column(i).to_numpy(zero_copy_only=False) for i in range(part.num_columns)])
            size += part.num_rows
            if size >= 400_000 and held[0][0][0] != held[-1][0][-1]:
                yield from settle(False)
        if held:
            yield from settle(True)

    rows = nodes.mapInArrow(spread, "anchor long, home boolean, node long, " + ", ".join(f"{n} long" for n in names))
    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(meet, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of an edge with the smallest node of its component; large and small stars by turns.

    Each step is written, so that both sides of a join are plain exchanges: a star's centre with very many links is split.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "lows")
        large = written(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "lows")
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = written(small.filter("a <> b").distinct(), "small")


#: Documents of one fingerprint from which they are dealt out, such fingerprints at most, and parts of each.
HOT, COMMON, SALTS = 64, 10_000, 64


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest id that links of ``distance`` bits or fewer reach."""
    prints = written(fingerprints(docs, shingle, 1, text, doc_id), "fingerprints")
    distinct = prints.groupBy("w0").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct.select(F.col("w0").alias("node"), "w0"), exact_segments(distance), distance))
    joined = roots.join(distinct.select(F.col("w0").alias("node"), "first"), "node")
    own = distinct.select(F.col("w0").alias("root"), F.col("first").alias("of_root"))
    lowest = joined.groupBy("root").agg(F.min("first").alias("low")).join(own, "root").select("root", F.least("low", "of_root").alias("low"))
    others = roots.join(lowest, "root").select(F.col("node").alias("w0"), "low").unionAll(lowest.select(F.col("root").alias("w0"), "low"))
    counted = prints.groupBy("w0").agg(F.count("*").alias("n"))
    classes = written(distinct.join(others, "w0", "left").join(counted, "w0").select("w0", F.coalesce("low", "first").alias("component_id"), "n"), "classes")
    # A fingerprint of very many documents is dealt to SALTS parts. There are at most COMMON of them, as each has over a share 1 / COMMON of all rows.
    hot = F.col("n") > max(HOT, prints.count() // COMMON)
    common = F.broadcast(classes.filter(hot).select("w0", F.lit(True).alias("common")))
    rows = prints.join(common, "w0", "left").withColumn("salt", F.when(F.col("common"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0)))
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = classes.select("w0", "component_id", F.explode(salts.cast("array<bigint>")).alias("salt"))
    return rows.join(spread, ["w0", "salt"]).select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


#: Counters that order shingles by frequency (a fixed size: 8 MB broadcast), and what one task merges of them.
COUNTERS, COUNTERS_CHUNK = 1 << 22, 1 << 17


def shingle_set(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Sorted distinct XXH64 of a text's shingles; none of a text without words."""
    parts, found = (text or b"").lower().split(), [np.zeros(0, np.uint64)]
    for at in range(0, max(1, len(parts) - shingle + 1) if parts else 0, 1 << 16):
        some = parts[at : at + (1 << 16) + shingle - 1]
        whole = map(b" ".join, zip(*(some[i:] for i in range(shingle)))) if len(some) >= shingle else [b" ".join(some)]
        found.append(np.fromiter(map(xxhash.xxh64_intdigest, whole, repeat(seed)), np.uint64))
    return np.unique(np.concatenate(found))


def _node(own: np.ndarray) -> int:
    """A set's 64-bit name."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64))


def _counted(texts: DataFrame, shingle: int, size: int = COUNTERS) -> np.ndarray:
    """Counters of shingles by the low bits of their hashes, up to 65,535: no shingle is in more texts than its counter says, below that."""
    chunk = min(COUNTERS_CHUNK, size)

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        total, held, n = np.zeros(size, np.int64), [], 0
        for (body,) in rows:
            held.append(shingle_set(body, shingle) & np.uint64(size - 1))
            n += len(held[-1])
            if n > size:
                total += np.bincount(np.concatenate(held).view(np.int64), minlength=size)
                held, n = [], 0
        if n:
            total += np.bincount(np.concatenate(held).view(np.int64), minlength=size)
        for i in range(0, size, chunk):
            if total[i : i + chunk].any():
                yield i // chunk, zlib.compress(np.minimum(total[i : i + chunk], 65535).astype("<u2").tobytes(), 1)

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = np.zeros(chunk, np.int64), None
        for part in parts:
            for number, some in zip(*(c.to_pylist() for c in part.columns), strict=True):
                total += np.frombuffer(zlib.decompress(some), "<u2")
        if number is not None:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([number], pa.int32()), "counts": pa.array([zlib.compress(np.minimum(total, 65535).astype("<u2").tobytes(), 1)], pa.binary())})

    merge.__annotations__ = {"parts": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    sent = map_rows(texts, count, "chunk int, counts binary", pa.schema([("chunk", pa.int32()), ("counts", pa.binary())]))
    out = np.zeros(size, "<u2")
    for row in sent.groupBy("chunk").applyInArrow(merge, "chunk int, counts binary").collect():  # at most 2 * size bytes
        out[row.chunk * chunk : (row.chunk + 1) * chunk] = np.frombuffer(zlib.decompress(bytes(row.counts)), "<u2")
    return out


def _allowed(n: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sizes, and what is left from the shared shingle on, allow rows the similarity."""
    most = np.minimum(n[left] - at[left], n[right] - at[right])
    return most * (1 + similarity) >= similarity * (n[left] + n[right]) - 1e-9


def _stars(node: np.ndarray, n: np.ndarray, at: np.ndarray, root: np.ndarray, group: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each group's pairs with one of its rows, the one with the fewest rarer shingles of its own."""
    order = np.lexsort((node, n, at, group))
    node, n, at, group = node[order], n[order], at[order], group[order]
    first = np.concatenate([[True], group[1:] != group[:-1]])
    centre = np.flatnonzero(first)[np.cumsum(first) - 1]
    rest = np.flatnonzero(~first)
    rest = rest[_allowed(n, at, centre[rest], rest, similarity)]
    yield np.minimum(node[centre[rest]], node[rest]), np.maximum(node[centre[rest]], node[rest])


def _across(node: np.ndarray, n: np.ndarray, at: np.ndarray, root: np.ndarray, group: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group and different roots that the filters allow, a bounded number of comparisons at a time."""
    order = np.lexsort((n, group))
    node, n, at, root, group = node[order], n[order], at[order], root[order], group[order]
    # Sizes ascend in a group: a row's partners are the next ones, up to its own size / similarity.
    reach = group.astype(np.float64) * 2.0**32
    last = np.searchsorted(reach + n, reach + np.minimum(np.floor(n / similarity + 1e-9), 2.0**31), side="right")
    start, size, i = np.arange(1, len(n) + 1), last - np.arange(1, len(n) + 1), 0
    while i < len(n):
        k = max(1, int(np.searchsorted(np.cumsum(size[i : i + PAIRS]), PAIRS, side="right")))
        z, s = size[i : i + k], start[i : i + k]
        for lo in range(0, max(1, int(z[0])) if k == 1 else 1, PAIRS):  # one row with very many partners
            part = np.clip(z - lo, 0, PAIRS) if k == 1 else z
            left = np.repeat(np.arange(i, i + k), part)
            right = np.arange(len(left)) - np.repeat(np.cumsum(part) - part, part) + np.repeat(s + lo, part)
            ok = root[left] != root[right]
            left, right = left[ok], right[ok]
            ok = _allowed(n, at, left, right, similarity)
            if ok.any():
                yield np.minimum(node[left[ok]], node[right[ok]]), np.maximum(node[left[ok]], node[right[ok]])
        i += k


def prefix_rows(texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(shingle, node, n, at): the shingles of each set of which sets of the similarity must share one, n the set's size.

    Shingles have one common order, rarest first by counters. Sets of n and of similarity s or more share a shingle of the
    first n - ceil(s * n) + 1 of each (prefix filter). A shingle that no other text can have is left out.
    """
    shared = texts.sparkSession.sparkContext.broadcast(zlib.compress(_counted(texts, shingle).tobytes(), 1))

    def prefixes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.frombuffer(zlib.decompress(shared.value), "<u2"), set()
        for part in parts:
            for lo in range(0, part.num_rows, 512):
                cols: list[list[np.ndarray]] = [[], [], [], []]
                for body in as_bytes(part.column(0).slice(lo, 512)):
                    own = shingle_set(body, shingle)
                    node, n = _node(own), len(own)
                    if not n or node in seen:
                        continue
                    if len(seen) >= 1_000_000:
                        seen.clear()
                    seen.add(node)
                    often = counts[(own & np.uint64(len(counts) - 1)).astype(np.int64)]
                    first = np.lexsort((own, often))[: n - math.ceil(similarity * n - 1e-9) + 1]
                    at = np.flatnonzero(often[first] > 1)  # a counter of one: in no other text
                    for c, x in zip(cols, (own[first[at]].view(np.int64), np.full(len(at), node, np.int64), np.full(len(at), n, np.int32), at.astype(np.int32)), strict=True):
                        c.append(x)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["shingle", "node", "n", "at"])

    return texts.mapInArrow(prefixes, "shingle long, node long, n int, at int")


def shared_pairs(rows: DataFrame, similarity: float, stars: bool) -> DataFrame:
    """(a, b): distinct pairs of nodes that share a shingle of ``rows`` (shingle, node, n, at, root) and may have the similarity.

    With ``stars`` one row of each shingle is paired with its others, as many pairs as rows; else all pairs of different roots.
    """
    pairs = _stars if stars else _across

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            keep = len(cols[0]) if last else int(np.searchsorted(cols[0], cols[0][-1]))  # the last shingle may go on
            held = [[c[keep:] for c in cols]] if keep < len(cols[0]) else []
            size = len(cols[0]) - keep
            if not keep:
                return
            token, node = cols[0][:keep], cols[1][:keep]
            order = np.lexsort((node, token))
            token, node, n, at, root = (c[:keep][order] for c in cols)
            once = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])  # copies from several tasks
            token, node, n, at, root = token[once], node[once], n[once], at[once], root[once]
            group = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]]))
            some = np.bincount(group)[group] > 1
            for a, b in pairs(node[some], n[some].astype(np.int64), at[some].astype(np.int64), root[some], group[some], similarity):
                for lo in range(0, len(a), 65536):
                    yield pa.RecordBatch.from_arrays([pa.array(a[lo : lo + 65536]), pa.array(b[lo : lo + 65536])], names=["a", "b"])

        for part in parts:
            if not part.num_rows:
                continue
            held.append([part.column(i).to_numpy(zero_copy_only=False) for i in range(part.num_columns)])
            size += part.num_rows
            if size >= 1_000_000 and held[0][0][0] != held[-1][0][-1]:
                yield from settle(False)
        if held:
            yield from settle(True)

    dealt = rows.select("shingle", "node", "n", "at", "root").repartition("shingle").sortWithinPartitions("shingle")
    return dealt.mapInArrow(meet, "a long, b long").distinct()


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, component_id) by exact Jaccard similarity of shingle sets: texts of ``similarity`` or more are linked, no others.

    1. Anchors propose links: equal fingerprints, and those of at most DISTANCE bits. Sets of 0.8 differ in about a seventh of
       the bits, beyond what any covering can afford, so one row of each rare shingle's group proposes its others as well.
    2. Every proposal is decided on the whole sets; what holds makes components, a large group of near copies mostly one.
    3. A prefix-filtered join of the sets gives every other pair that may be similar, but only across components (those
       within one change nothing); each is decided, and components are found again. So no link is lost and none is false.

    Equal sets are one node beforehand; so are texts without words.
    """
    given = only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))

    def named(rows: Iterator[tuple]) -> Iterator[tuple]:
        for owner, body in rows:
            yield owner, _node(shingle_set(body, shingle)), fingerprint(body, shingle)[0]

    def whole(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (body,) in rows:
            own = shingle_set(body, shingle)
            yield _node(own), own.tobytes()

    def decided(rows: Iterator[tuple]) -> Iterator[tuple]:
        for a, b, x, y in rows:
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                yield a, b

    longs = lambda *names: pa.schema([(n, pa.int64()) for n in names])
    nodes = written(map_rows(given, named, "doc_id long, node long, w0 long", longs("doc_id", "node", "w0")), "set-names")
    distinct = written(nodes.filter("doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"), F.min("w0").alias("w0")), "set-distinct")

    def verified(pairs: DataFrame) -> DataFrame:
        # The sets of the nodes in pairs only; a repeated id may bring others, which meet no pair.
        asked = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct().join(distinct, "node").select(F.col("first").alias("_first")).distinct()
        texts = given.join(asked, F.col("doc_id") == F.col("_first"), "left_semi").select("text")
        sets = written(map_rows(texts, whole, "node long, own binary", pa.schema([("node", pa.int64()), ("own", pa.binary())])).dropDuplicates(["node"]), "sets")
        x, y = (sets.select(F.col("node").alias(c), F.col("own").alias(f"_{c}")) for c in "ab")
        return map_rows(pairs.join(x, "a").join(y, "b").select("a", "b", "_a", "_b"), decided, "a long, b long", longs("a", "b"))

    prints = written(distinct.groupBy("w0").agg(F.min("node").alias("node")), "set-prints")
    near = links(prints.select(F.col("w0").alias("node"), "w0"), exact_segments(DISTANCE), DISTANCE, real=True)
    x, y = (prints.select(F.col("w0").alias(c), F.col("node").alias(f"_{c}")) for c in "ab")
    near = near.join(x, "a").join(y, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    alike = distinct.join(prints.select("w0", F.col("node").alias("b")), "w0").select(F.col("node").alias("a"), "b").filter("a <> b")
    rows = written(prefix_rows(given.filter("doc_id IS NOT NULL").select("text"), similarity, shingle), "set-prefixes")
    proposed = near.unionAll(alike).unionAll(shared_pairs(rows.withColumn("root", F.col("node")), similarity, stars=True))
    proposed = written(proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "set-proposed")
    held = written(verified(proposed), "set-links")
    roots = written(components(held), "set-roots")
    rooted = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    others = written(shared_pairs(rooted, similarity, stars=False).join(proposed, ["a", "b"], "left_anti"), "set-pairs")
    if not others.isEmpty():
        roots = written(components(verified(others).unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "set-roots")
    every = roots.unionAll(roots.select("root", "root").distinct())
    lowest = every.join(distinct, "node").groupBy("root").agg(F.min("first").alias("low"))
    classes = written(distinct.join(every.join(lowest, "root").select("node", "low"), "node", "left").select("node", F.coalesce("low", "first").alias("component_id")), "set-classes")
    return nodes.join(classes, "node", "left").select("doc_id", "component_id")


def first_of_groups(docs: DataFrame, groups: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group, of its smallest id; rows without an id stay.

    An id of several rows goes if one of them is in a smaller id's group; else one of its rows stays (which, isn't defined).
    """
    left = without(docs, groups.filter("doc_id <> component_id").select("doc_id"), doc_id)
    again = written(groups.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return left
    name = unused(docs, "again")[0]
    twice = left.join(again.withColumnRenamed("doc_id", name), F.col(f"`{doc_id}`") == F.col(name), "left_semi")
    return without(left, again, doc_id).unionAll(twice.dropDuplicates([doc_id]))
