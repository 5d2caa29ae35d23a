"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs.

A paragraph is a non-empty line (split at \\n). It is hashed to a wide vector: EXACT lanes modulo 2^64 drawn from SHAKE-128
of the paragraph, and LIKE lanes modulo 2^32 that count, with a hashed sign in a hashed lane, each of its bytes with the
up to 15 before it. A text's fingerprint is the sum of its paragraphs' vectors. So it doesn't depend on their order,
texts of equal paragraphs have equal fingerprints, paragraphs come and go by addition and subtraction (``changed``), and groups
of documents add up (``added_up``). The exact lanes tell texts apart; the inner products of the others estimate those of
the counts (error about 1 / sqrt(LIKE) of the norms), so their cosine is a likeness from 0 to 1.

``edited`` chains documents by descending id without a global sort: a bounded sample of keys cuts the ids into ranges that
begin with known rows, texts are shuffled once to their range, and the row that a range begins with also goes to the end of the one before.

Defined results: null and empty texts have no paragraphs and a fingerprint of zeros, of likeness 1 to another of zeros and 0
to others; rows of one id follow each other by descending hash of the text, repeated rows likewise and each has its row; ids
are integers, null ones come last; a single row is followed by itself; an empty table gives no rows; texts may be of any length (they
are hashed a megabyte at a time, and one is held with the next); other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, map_rows, only, unused

#: Lanes of 64 and of 32 bits, and bytes of a window.
EXACT, LIKE, WINDOW = 32, 256, 16
#: Bytes of a fingerprint.
WIDTH = EXACT * 8 + LIKE * 4
#: Bytes of text in a range of ids, ranges at most, and sampled keys for each.
RANGE_BYTES, MOST_RANGES, SAMPLED = 32 << 20, 20_000, 64
_STEP = 1 << 20
_M1, _M2, _M3 = (np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))
_LOW = -(1 << 63)


def _like(text: bytes) -> np.ndarray:
    """Signed counts (int64) of the windows of a text's lines."""
    out = np.zeros(LIKE, np.int64)
    gap = b"\0" * WINDOW
    for at in range(0, len(text), _STEP):
        before = text[max(0, at - WINDOW + 1) : at]
        part = text[at : at + _STEP]
        joined = (before.rpartition(b"\n")[2] + part).replace(b"\n", b"\n" + gap)
        skip = len(before.rpartition(b"\n")[2])
        a = np.frombuffer(gap + joined + gap[:7], np.uint8)
        words = np.lib.stride_tricks.as_strided(a, (len(a) - 7, 8), (1, 1)).copy().view("<u8")[:, 0]
        h = words[WINDOW // 2 + 1 : WINDOW // 2 + 1 + len(joined)] * _M1 ^ (words[1 : 1 + len(joined)] + _M2) * _M3
        own = np.frombuffer(joined, np.uint8)
        h = h[skip:][(own[skip:] != 10) & (own[skip:] != 0)]
        h ^= h >> np.uint64(32)
        h *= _M3
        h ^= h >> np.uint64(29)
        h *= _M1
        out += np.bincount((h >> np.uint64(55)).astype(np.int64), minlength=2 * LIKE).reshape(LIKE, 2) @ np.array([1, -1])
    return out


def fingerprint(text: bytes | None) -> np.ndarray:
    """WIDTH bytes (uint8): exact lanes, then the others, little-endian."""
    text = text or b""
    exact = np.zeros(EXACT, np.uint64)
    for paragraph in text.split(b"\n"):
        if paragraph:
            exact += np.frombuffer(hashlib.shake_128(paragraph).digest(EXACT * 8), "<u8")
    return np.concatenate([exact.view(np.uint8), _like(text).astype(np.uint32).view(np.uint8)])


def combined(a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
    """The fingerprint of both multisets together, or (sign -1) of a without b."""
    parts = []
    for lo, hi, kind in ((0, EXACT * 8, np.uint64), (EXACT * 8, WIDTH, np.uint32)):
        x, y = a[lo:hi].view(kind), b[lo:hi].view(kind)
        parts.append((x + y if sign > 0 else x - y).view(np.uint8))
    return np.concatenate(parts)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints, else the cosine of their counts, from 0 to 1."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[EXACT * 8 :].view(np.int32).astype(float) for v in (a, b))
    size = np.sqrt((x @ x) * (y @ y))
    return float(min(1.0, max(0.0, x @ y / size))) if size else 0.0


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint binary: one pass, no shuffle."""
    rows = only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_rows(rows, lambda given: ((d, fingerprint(t).tobytes()) for d, t in given), "doc_id long, fingerprint binary", pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.binary())]))


def changed(df: DataFrame, removed: str, inserted: str, print_: str = "fingerprint") -> DataFrame:
    """``df`` with its fingerprints after the paragraphs of one text column went and those of another came, without the documents' texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = {n: part.schema.get_field_index(n) for n in (print_, removed, inserted)}
            new = []
            for p, r, i in zip(*(part.column(at[n]).to_pylist() for n in (print_, removed, inserted)), strict=True):
                v = np.frombuffer(p, np.uint8) if p is not None else fingerprint(None)
                for t, sign in ((r, -1), (i, 1)):
                    v = combined(v, fingerprint(t.encode()), sign) if t else v
                new.append(v.tobytes())
            yield part.set_column(at[print_], part.schema.field(at[print_]), pa.array(new, part.schema.field(at[print_]).type))

    return df.mapInArrow(run, df.schema)


def added_up(prints: DataFrame, by: str, print_: str = "fingerprint") -> DataFrame:
    """``by``, fingerprint: of all documents of a group together; each task adds up what it has before the shuffle."""
    schema = prints.select(by, F.col(print_).alias("fingerprint")).schema

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for part in parts:
            for k, p in zip(*(c.to_pylist() for c in part.columns), strict=True):
                v = np.frombuffer(p, np.uint8) if p is not None else fingerprint(None)
                held[k] = combined(held[k], v) if k in held else v
            if len(held) > 50_000:
                yield from put(held)
                held = {}
        yield from put(held)

    def put(held: dict) -> Iterator[pa.RecordBatch]:
        if held:
            kinds = part_types
            yield pa.RecordBatch.from_arrays([pa.array(list(held), kinds[0]), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=[by, "fingerprint"])

    from pyspark.sql.pandas.types import to_arrow_type

    part_types = [to_arrow_type(schema[0].dataType)]
    some = prints.select(by, F.col(print_).alias("fingerprint")).mapInArrow(sums, schema)
    return some.repartition(by).sortWithinPartitions(by).mapInArrow(sums, schema)


def _points(text: bytes) -> int:
    return len(text) if text.isascii() else int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def _first(text: bytes, n: int) -> bytes:
    """The first n code points (or all)."""
    if text.isascii():
        return text[:n]
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return text[: int(starts[n])] if n < len(starts) else text


def edit(text: bytes, following: bytes) -> bytes:
    """``text`` whose last half (rounded down, in code points) is replaced by as many of the following text's first ones."""
    n = _points(text)
    return _first(text, n - n // 2) + _first(following, n // 2)


def _order(doc_id: Column, text: Column) -> tuple[Column, Column]:
    return F.coalesce(doc_id, F.lit(_LOW)), F.xxhash64(text)


def ranges(keys: DataFrame, range_bytes: int = RANGE_BYTES) -> list[tuple[int, int]]:
    """First keys (o, h) of the ranges in descending order, all of them keys of rows; at most MOST_RANGES from a bounded sample."""
    n, size, o, h = keys.agg(F.count("*"), F.sum("size"), F.max_by("o", F.struct("o", "h")), F.max_by("h", F.struct("o", "h"))).first()
    if not n:
        return []
    count = int(min(n, MOST_RANGES, -(-(size or 0) // range_bytes) or 1))
    if count == 1:
        return [(o, h)]
    share = min(1.0, SAMPLED * count / n)
    some = keys.filter(F.pmod(F.xxhash64("o", "h", F.lit(5)), F.lit(1 << 20)) <= int(share * (1 << 20)))
    some = sorted(some.groupBy("o", "h").agg(F.max("size").alias("size")).collect(), reverse=True)  # about SAMPLED * count
    each = np.cumsum([r.size for r in some]) // (1 + sum(r.size for r in some) // count)  # ranges of like bytes
    return sorted({(o, h), *((r.o, r.h) for r, k, before in zip(some, each, [0, *each], strict=False) if k > before)}, reverse=True)


def edited(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (binary), near_edited, near_next of every row."""
    rows = only(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    o, h = _order(F.col("doc_id"), F.col("text"))
    rows = rows.select("doc_id", "text", o.alias("o"), h.alias("h"))
    heads = ranges(rows.select("o", "h", F.octet_length("text").alias("size")), range_bytes)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    if not heads:
        return rows.sparkSession.createDataFrame([], schema)
    shared, n = docs.sparkSession.sparkContext.broadcast(heads), len(heads)  # at most MOST_RANGES pairs of numbers

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.array(shared.value, dtype=[("o", np.int64), ("h", np.int64)])[::-1]  # ascending
        known, told = set(shared.value), set()
        for part in parts:
            key = np.empty(part.num_rows, first.dtype)
            key["o"], key["h"] = part.column(2).to_numpy(), part.column(3).to_numpy()
            range_ = n - np.searchsorted(first, key)  # the range whose first key is the least that isn't below
            range_ = np.minimum(range_ - 1, n - 1).astype(np.int32)
            again = [i for i, k in enumerate(zip(key["o"].tolist(), key["h"].tolist(), strict=True)) if k in known and k not in told and not told.add(k)]
            for rows_, which, extra in ((part, range_, False), (part.take(pa.array(again, pa.int64())), (range_[again] - 1) % n, True)):
                if rows_.num_rows:
                    yield pa.RecordBatch.from_arrays([*rows_.columns, pa.array(which.astype(np.int32)), pa.array([extra] * rows_.num_rows)], names=["doc_id", "text", "o", "h", "range", "extra"])

    arrow = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def chain(given: Iterator[tuple]) -> Iterator[tuple]:
        held, where = None, None  # the row before and its range; None after a range's end
        for owner, body, _, _, range_, extra in given:
            if extra and (held is None or where != range_):
                continue
            own = fingerprint(body)
            if held is not None and where == range_:
                d, t, p = held
                new = edit(t, body)
                q = fingerprint(new)
                yield d, _points(t), hashlib.sha256(new).hexdigest(), p.tobytes(), q.tobytes(), likeness(p, q), likeness(p, own)
            held, where = None if extra else (owner, body, own), range_

    dealt = rows.mapInArrow(deal, "doc_id long, text string, o long, h long, range int, extra boolean")
    dealt = dealt.repartitionById(n, "range").sortWithinPartitions("range", "extra", F.desc("o"), F.desc("h"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given() -> Iterator[tuple]:
            for part in parts:
                for at in range(0, part.num_rows, 512):
                    some = part.slice(at, 512)
                    text_ = some.column(1)
                    yield from zip(some.column(0).to_pylist(), text_.cast(pa.large_binary() if pa.types.is_large_string(text_.type) else pa.binary()).to_pylist(), *(some.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)

        yield from batches(chain(given()), arrow, 512)

    return dealt.mapInArrow(run, schema)


def fingerprint_digest(found: DataFrame) -> DataFrame:
    """The same with fingerprints as lowercase hex."""
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return found.select("doc_id", "n_chars", "edited_sha256", hexed("fingerprint"), hexed("edited_fingerprint"), "near_edited", "near_next")
