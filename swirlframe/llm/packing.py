"""Packing into sequences: exact complements first (single, pair and triple length sums), best fit for the rest.

Only lengths matter for packing, and there are at most ``capacity`` of them. The driver gets the histogram of
lengths (bounded by capacity, whatever the corpus), plans patterns of lengths with multiplicities on it, and
broadcasts the plan. Pieces are then dealt to the plan's places by their rank within their length; ranks come from
per-task counters plus offsets, so no length's pieces ever meet in one task. The offsets (a row for each length and
task) are broadcast only if they are counted to be few, else joined.

Defined results: a null or empty text has just the end id; every piece is placed exactly once; an empty table
gives no pieces; repeated rows are packed as often as they occur. Ids are integers (others raise Spark's cast error); a text may be of any
length, and one longer than a sequence is cut into several pieces; other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, only, written
from .tokens import default_path, ids_of

CAPACITY, END = 4096, 1
BROADCAST_ROWS = 1 << 16  # of offsets, of three numbers each


def plan_patterns(counts: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths) so that each length is used exactly ``counts[length]`` times and no pattern exceeds the capacity."""
    cap = len(counts) - 1
    left = counts.astype(np.int64).copy()
    out: list[tuple[int, tuple[int, ...]]] = []
    pairs, age = _pair_sums(left), 0

    def take(lengths: tuple[int, ...]) -> None:
        nonlocal age
        use = Counter(lengths)
        times = min(int(left[x]) // n for x, n in use.items())
        for x, n in use.items():
            left[x] -= times * n
        out.append((times, lengths))
        age += 1

    residual = np.zeros_like(left)
    for size in range(cap, 0, -1):
        while left[size] > 0:
            if age >= 512:
                pairs, age = _pair_sums(left), 0
            found = _fill(left, pairs, cap, size)
            if found is None:
                residual[size], left[size] = left[size], 0
            else:
                take((size, *found))
    return out + _best_fit(residual, cap)


def _pair_sums(left: np.ndarray) -> np.ndarray:
    """Whether a sum of two available lengths can be each number (availability only falls, so never too few)."""
    have = np.flatnonzero(left)
    sums = np.zeros(len(left), bool)
    for x in have:
        y = have[: np.searchsorted(have, len(left) - 1 - x, side="right")]
        sums[x + y] = True
    return sums


def _pair(left: np.ndarray, total: int, most: int) -> tuple[int, int] | None:
    """Available lengths b >= a with a + b == total and b <= most, b as large as can be."""
    b = np.arange(min(total - 1, most), (total - 1) // 2, -1)
    if not len(b):
        return None
    a = total - b
    ok = (left[b] > 0) & (left[a] > 0) & ((a != b) | (left[b] > 1))
    at = int(ok.argmax())
    return (int(b[at]), int(a[at])) if ok[at] else None


def _fill(left: np.ndarray, pairs: np.ndarray, cap: int, size: int) -> tuple[int, ...] | None:
    """Available lengths that exactly fill what ``size`` leaves: one, two or three of them; None if there are none."""
    gap = cap - size
    if gap == 0:
        return ()
    left[size] -= 1
    try:
        if gap <= size and left[gap] > 0:
            return (gap,)
        if pairs[gap] and (two := _pair(left, gap, size)):
            return two
        for c in np.flatnonzero(left[: min(gap - 2, size) + 1])[::-1]:
            if 3 * c < gap:
                break
            if pairs[gap - c]:
                left[c] -= 1
                two = _pair(left, gap - int(c), int(c))
                left[c] += 1
                if two:
                    return (int(c), *two)
        return None
    finally:
        left[size] += 1


def _best_fit(counts: np.ndarray, cap: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit, longest first, on lengths with multiplicities: sequences of equal contents are handled together."""
    open_: dict[int, list[list]] = {}  # gap -> [times, lengths]
    for size in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[size])
        while n:
            gap = min((g for g in open_ if g >= size), default=None)
            if gap is None:
                each = min(cap // size, n)
                times = n // each
                open_.setdefault(cap - each * size, []).append([times, (size,) * each])
                n -= times * each
                continue
            held = open_[gap][-1]
            times = min(held[0], n)
            held[0] -= times
            if not held[0]:
                open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
            open_.setdefault(gap - size, []).append([times, (*held[1], size)])
            n -= times
    return [(times, lengths) for some in open_.values() for times, lengths in some]


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """For runs of ranks of a length: key (length << 44 | first rank), the first rank's sequence, and the offset in it."""
    used: Counter = Counter()
    key, first, offset, sequence = [], [], [], 0
    for times, lengths in patterns:
        at = 0
        for x in lengths:
            key.append((x << 44) | used[x])
            first.append(sequence)
            offset.append(at)
            used[x] += times
            at += x
        sequence += times
    order = np.argsort(np.array(key, np.int64), kind="stable")
    return {k: np.array(v, np.int64)[order] for k, v in (("key", key), ("first", first), ("offset", offset))}


def _groups(rows: Iterator[tuple], most: int = 128, size: int = 1 << 19) -> Iterator[list[tuple]]:
    """Rows in groups of bounded number and bytes (a longer text is a group of its own)."""
    held, n = [], 0
    for row in rows:
        if held and (len(held) >= most or n + len(row[1] or b"") > size):
            yield held
            held, n = [], 0
        held.append(row)
        n += len(row[1] or b"")
    if held:
        yield held


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, text: str = "text", doc_id: str = "doc_id", group: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank): each document's pieces; rank counts a length within a task."""

    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        ids, part, ranks = ids_of(path), TaskContext.get().partitionId(), Counter()
        tail, step = np.array([end], "<u4").tobytes(), 4 * capacity
        for some in _groups(rows):
            for owner, own in zip([r[0] for r in some], ids.of_many([(r[1] or b"").decode() for r in some]), strict=True):
                data = own + tail
                for i, at in enumerate(range(0, len(data), step)):
                    piece = data[at : at + step]
                    n = len(piece) // 4
                    yield owner, i, at // 4, n, zlib.crc32(piece), part, ranks[n]
                    ranks[n] += 1

    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())]
    return map_rows(only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long")), cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long", pa.schema(fields))


def pack(pieces: DataFrame, capacity: int = CAPACITY, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds sequence_id and offset (long) to rows with length, part and rank (unique within length and part)."""
    spark = pieces.sparkSession
    by_part = written(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    offsets = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = offsets.select("length", "part", F.coalesce("before", F.lit(0)).alias("before"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r.length] = r.n
    shared = spark.sparkContext.broadcast(places(plan_patterns(counts)))
    names = [c for c in pieces.columns if c not in ("part", "rank")]
    offsets = F.broadcast(offsets) if by_part.count() <= broadcast_rows else written(offsets, "offsets").hint("merge")
    ranked = pieces.join(offsets, ["length", "part"]).select(*names, (F.col("rank") + F.col("before")).alias("rank"))

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for part in parts:
            key = (part.column(names.index("length")).to_numpy().astype(np.int64) << 44) | part.column(len(names)).to_numpy()
            at = np.searchsorted(plan["key"], key, side="right") - 1
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(plan["first"][at] + key - plan["key"][at]), pa.array(plan["offset"][at])], names=[*names, "sequence_id", "offset"])

    from pyspark.sql import types as T

    schema = T.StructType([*[pieces.schema[n] for n in names], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(deal, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: all documents in sequences of at most ``capacity`` ids."""
    return pack(written(token_pieces(docs, path or default_path(), capacity, end, text, doc_id), "pieces"), capacity)
