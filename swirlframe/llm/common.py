"""What the operators of this subpackage share: folders, Arrow access to texts, bounded broadcasts.

Everything that has to outlive a stage is ``written`` to the folder that the session names in
``spark.checkpoint.dir``; it is the only place that driver and executors are known to share.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import written

#: A side is broadcast only below this many bytes of payload; beyond it operators join or work in blocks.
BROADCAST_BYTES = 16 << 20


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that ``df`` has no column of, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def row_key(owner: Column, text: Column) -> Column:
    """128 bits (binary) that tell rows of different ids or texts apart."""
    return F.unhex(F.md5(F.concat(F.coalesce(owner.cast("string"), F.lit("-")), F.lit("|"), F.coalesce(text, F.lit("")))))


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places in a filter of so many bits (a power of two) of each 64-bit hash, two columns."""
    mask = np.uint64(bits - 1)
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) & mask for i in range(2)], axis=1)


def note(field: np.ndarray, places: np.ndarray) -> None:
    """Sets bits of a filter (uint8)."""
    np.bitwise_or.at(field, places >> np.uint64(3), np.left_shift(np.uint8(1), (places & np.uint64(7)).astype(np.uint8)))


def noted(field: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a filter may have each hash; never false for one that it has."""
    at = probes(hashes, len(field) * 8)
    return ((field[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def filter_of(hashes: DataFrame, least: int = 1 << 20, most: int = 1 << 30, each: int = 16) -> bytes:
    """A compressed Bloom filter of a long column, of ``each`` bits a row between two bounds."""
    bits = min(most, max(least, 1 << (each * hashes.count()).bit_length()))
    chunk = min(1 << 17, bits // 8)

    def fill(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros(bits // 8, np.uint8)
        for part in parts:
            note(field, probes(part.column(0).to_numpy().view(np.uint64), bits).ravel())
        for i in range(0, bits // 8, chunk):
            if field[i : i + chunk].any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([i // chunk], pa.int32()), "field": pa.array([zlib.compress(field[i : i + chunk].tobytes(), 1)], pa.binary())})

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, number = np.zeros(chunk, np.uint8), None
        for part in parts:
            for number, some in zip(*(c.to_pylist() for c in part.columns), strict=True):
                field |= np.frombuffer(zlib.decompress(some), np.uint8)
        if number is not None:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([number], pa.int32()), "field": pa.array([zlib.compress(field.tobytes(), 1)], pa.binary())})

    merge.__annotations__ = {"parts": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    out = np.zeros(bits // 8, np.uint8)
    kind = "chunk int, field binary"
    for row in hashes.mapInArrow(fill, kind).groupBy("chunk").applyInArrow(merge, kind).collect():  # at most bits / 8 bytes
        out[row.chunk * chunk : (row.chunk + 1) * chunk] = np.frombuffer(zlib.decompress(bytes(row.field)), np.uint8)
    return zlib.compress(out.tobytes(), 1)


def making_room(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with its columns of these names under others (underscores before them), so that an operator can add its own."""
    for c in [c for c in df.columns if c.lower() in {n.lower() for n in names}]:
        df = df.withColumnRenamed(c, unused(df, c)[0])
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded length."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield record_batch(held, schema)
            held = []
    if held:
        yield record_batch(held, schema)


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def map_rows(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str, arrow: pa.Schema) -> DataFrame:
    """``rows`` over each partition: it gets the rows as tuples (strings as UTF-8 bytes) and yields tuples."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given() -> Iterator[tuple]:
            for part in parts:
                for at in range(0, part.num_rows, 512):  # long texts: never a whole batch as Python objects
                    some = part.slice(at, 512)
                    cols = [as_bytes(c) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c.to_pylist() for c in some.columns]
                    yield from zip(*cols, strict=True)

        yield from batches(rows(given()), arrow)

    return df.mapInArrow(run, schema)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns under fixed names; columns of other names can't clash with an operator's own."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def without(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` whose id isn't in the one column of ``ids``; a broadcast only where the ids are proven to be few. Null ids stay."""
    name = unused(docs, "gone")[0]
    gone = written(ids.select(ids[ids.columns[0]].alias(name)).na.drop().distinct(), "gone")
    if gone.count() * 16 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[doc_id] == gone[name], "left_anti")
