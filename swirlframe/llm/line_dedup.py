"""Line dedup with two Bloom filters: only lines suspected of repeating are shuffled for an exact count.

A line's key is the line without white space (``[\\x20\\x09-\\x0D]``) at its ends, A-Z lower-cased. One pass
puts each document's distinct keys in a filter of keys seen once and, on the second sight, in a filter of keys
seen twice; the per-task filters merge by OR (twice also gets the AND of two onces). A second pass sends only the
keys that the twice-filter holds to an exact count of documents. The filters have no false negatives, so nothing
is lost. Their size follows the number of lines (LINE_BITS each) between two fixed bounds; beyond the upper one
more lines are sent to the exact count, no more.

Defined results: a null or empty text is one empty line; an empty key never counts; repeated rows count as
documents of their own; an empty table gives an empty result; other columns pass through unread (those that are named
as the two added ones get an underscore before their names). Ids are integers; a text may be of any length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, making_room, map_rows, note, noted, only, probes, row_key, unused, written

#: Bits of each filter at least and at most (so what is broadcast is bounded at 128 MB), and bits for each line between them.
FILTER_BITS, MOST_BITS, LINE_BITS = 1 << 26, 1 << 30, 16
CHUNK = 1 << 17  # bytes of filter merged by one task


def line_keys(text: bytes | None) -> list[bytes]:
    return [line.strip(b" \t\n\x0b\x0c\r") for line in (text or b"").translate(_LOWER).split(b"\n")]


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _fold(once: np.ndarray, twice: np.ndarray, held: list[int], bits: int) -> None:
    """Adds the hashes of documents' distinct keys; a key is noted as seen twice when all its bits were set."""
    h = np.array(held, dtype=np.uint64)
    first, n = np.unique(h, return_counts=True)
    at = probes(first, bits)
    note(twice, at[(n > 1) | noted(once, first)].ravel())
    note(once, at.ravel())


def filter_bits(texts: DataFrame) -> int:
    """A power of two of at least LINE_BITS for each line, within the bounds."""
    n = texts.agg(F.sum(F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)) + 1)).first()[0] or 0
    return min(MOST_BITS, max(FILTER_BITS, 1 << (LINE_BITS * n).bit_length()))


def seen_twice(texts: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(chunk, twice): the merged filter of keys in two documents or more, in compressed chunks; absent chunks are zero."""
    chunk = min(CHUNK, bits // 8)

    def fill(rows: Iterator[tuple]) -> Iterator[tuple]:
        once, twice, held = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8), []
        for (text,) in rows:
            held += [xxhash.xxh3_64_intdigest(k) for k in set(line_keys(text)) if k]
            if len(held) > 200_000:
                _fold(once, twice, held, bits)
                held = []
        _fold(once, twice, held, bits)
        for i in range(0, bits // 8, chunk):
            if once[i : i + chunk].any():
                yield i // chunk, zlib.compress(once[i : i + chunk].tobytes(), 1), zlib.compress(twice[i : i + chunk].tobytes(), 1)

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, number = np.zeros(chunk, np.uint8), np.zeros(chunk, np.uint8), None
        for part in parts:
            for number, a, b in zip(*(c.to_pylist() for c in part.columns), strict=True):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                twice |= b | (once & a)
                once |= a
        if number is not None and twice.any():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([number], pa.int32()), "twice": pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())})

    merge.__annotations__ = {"parts": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    parts = map_rows(texts, fill, "chunk int, once binary, twice binary", pa.schema([("chunk", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))
    return parts.groupBy("chunk").applyInArrow(merge, "chunk int, twice binary")


def repeated_lines(docs: DataFrame, min_docs: int = 2, text: str = "text", doc_id: str = "doc_id", bits: int | None = None) -> DataFrame:
    """(key binary, n_docs long, first_doc long): keys in ``min_docs`` documents or more, with the first of those documents."""
    texts = only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    bits = bits or filter_bits(texts)
    field = np.zeros(bits // 8, np.uint8)
    chunk = min(CHUNK, bits // 8)
    for row in seen_twice(texts.select("text"), bits).collect():  # at most bits / 8 bytes
        field[row.chunk * chunk : (row.chunk + 1) * chunk] = np.frombuffer(zlib.decompress(bytes(row.twice)), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(field.tobytes(), 1))

    def suspects(rows: Iterator[tuple]) -> Iterator[tuple]:
        twice = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        found: dict[bytes, list] = {}

        def settle(keys: list[bytes], owners: list) -> None:
            for i in np.flatnonzero(noted(twice, np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64))):
                known = found.get(keys[i])
                if known is None:
                    found[keys[i]] = [1, owners[i]]
                else:
                    known[0] += 1
                    known[1] = owners[i] if known[1] is None else known[1] if owners[i] is None else min(known[1], owners[i])

        keys, owners, size = [], [], 0
        for owner, text in rows:
            own = [k for k in set(line_keys(text)) if k]
            keys += own
            owners += [owner] * len(own)
            if len(keys) > 50_000:
                settle(keys, owners)
                keys, owners = [], []
            size += len(own)
            if len(found) > 500_000:  # sent on and added up by the exact count
                yield from ((k, n, d) for k, (n, d) in found.items())
                found.clear()
        if keys:
            settle(keys, owners)
        yield from ((k, n, d) for k, (n, d) in found.items())

    sent = map_rows(texts, suspects, "key binary, n long, doc long", pa.schema([("key", pa.binary()), ("n", pa.int64()), ("doc", pa.int64())]))
    return sent.groupBy("key").agg(F.sum("n").alias("n_docs"), F.min("doc").alias("first_doc")).filter(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, min_docs: int = 2, keep: str = "first", text: str = "text", doc_id: str = "doc_id", bits: int | None = None, broadcast_bytes: int = BROADCAST_BYTES, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with ``text`` cleared of repeated lines, and the two columns of ``counts`` (long) added: lines before, and dropped.

    ``keep="first"`` leaves a repeated line at its first occurrence in the document of the smallest id that has
    it; ``keep="none"`` takes it from every document. The repeated keys are broadcast if they are proven to be
    small; else each document's suspected lines are joined with them, and the verdicts with the documents.
    """
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    spark = docs.sparkSession
    docs = making_room(docs, *counts)
    keys = written(repeated_lines(docs, min_docs, text, doc_id, bits), "repeated-lines")
    size = keys.agg(F.sum(F.length("key") + 60)).first()[0] or 0
    names = docs.columns

    def verdict(owner: int | None, found: list[bytes], first: dict) -> list[int]:
        out, kept = [], set()
        for i, k in enumerate(found):
            if k in first:
                if keep == "first" and first[k] == owner and k not in kept:
                    kept.add(k)
                else:
                    out.append(i)
        return out

    if size <= broadcast_bytes:
        shared = spark.sparkContext.broadcast({bytes(r.key): r.first_doc for r in keys.collect()})

        def rewrite(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = shared.value
            for part in parts:
                for at in range(0, part.num_rows, 1024):
                    some = part.slice(at, 1024)
                    yield _rewritten(some, names, text, counts, [verdict(d, line_keys(t), first) for d, t in _pairs(some, names, text, doc_id)])

        return docs.mapInArrow(rewrite, _schema(docs, text, counts))

    row, drops = unused(docs, "row", "drops")
    owner = F.col(f"`{doc_id}`").cast("long")
    rows = docs.withColumn(row, row_key(owner, F.col(f"`{text}`")))

    def suspects(given: Iterator[tuple]) -> Iterator[tuple]:
        for number, owner, body in given:
            for i, k in enumerate(line_keys(body)):
                if k:
                    yield number, owner, i, k

    lines = map_rows(rows.select(F.col(row).alias("row"), owner, F.col(f"`{text}`")).distinct(), suspects, "row binary, owner long, line int, key binary", pa.schema([("row", pa.binary()), ("owner", pa.int64()), ("line", pa.int32()), ("key", pa.binary())]))
    hit = lines.join(keys, "key").groupBy("row", "key").agg(F.sort_array(F.collect_list("line")).alias("at"), F.first(F.col("owner") == F.col("first_doc")).alias("own"))
    drop = F.when(F.lit(keep == "first") & F.col("own"), F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0)))).otherwise(F.col("at"))
    verdicts = hit.select("row", drop.alias("at")).groupBy("row").agg(F.flatten(F.collect_list("at")).alias(drops)).withColumnRenamed("row", row)
    joined = rows.join(verdicts, row, "left").select(*[F.col(f"`{n}`") for n in names], drops)

    def rewrite_joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 1024):
                some = part.slice(at, 1024)
                yield _rewritten(some, names, text, counts, [x or [] for x in some.column(len(names)).to_pylist()])

    return joined.mapInArrow(rewrite_joined, _schema(docs, text, counts))


def _schema(docs: DataFrame, text: str, counts: tuple[str, str]):
    from pyspark.sql import types as T

    fields = [T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in docs.schema.fields]
    return T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in counts]])


def _pairs(part: pa.RecordBatch, names: list[str], text: str, doc_id: str) -> Iterator[tuple]:
    return zip(part.column(names.index(doc_id)).to_pylist(), part.column(names.index(text)).cast(pa.binary()).to_pylist(), strict=True)


def _rewritten(part: pa.RecordBatch, names: list[str], text: str, counts: tuple[str, str], drops: list[list[int]]) -> pa.RecordBatch:
    bodies, sizes = part.column(names.index(text)).cast(pa.binary()).to_pylist(), []
    out = []
    for body, drop in zip(bodies, drops, strict=True):
        lines = (body or b"").split(b"\n")
        sizes.append((len(lines), len(drop)))
        gone = set(drop)
        out.append(body if not gone else b"\n".join(x for i, x in enumerate(lines) if i not in gone))
    cols = [pa.array(out, pa.binary()).cast(pa.string()) if n == text else part.column(i) for i, n in enumerate(names)]
    return pa.RecordBatch.from_arrays([*cols, pa.array([n for n, _ in sizes], pa.int64()), pa.array([n for _, n in sizes], pa.int64())], names=[*names, *counts])


def kept_digest(cleaned: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of what ``dedup_lines`` returns."""
    return cleaned.select(F.col(doc_id).alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("kept_sha256"))


def digest(text: bytes | None) -> str:
    return hashlib.sha256(text or b"").hexdigest()
