"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document has one feature for each distinct word (hashed), one for each structure statistic's interval, and one
for each given metadata column's interval. Its score is linear in the number of features: pairwise interactions of rank k
are ``0.5 * sum_f((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``. The machine is fitted with AdaGrad on a bounded sample
of labelled rows (TRAIN_ROWS ids, those of smallest hash, one row of each, and of a row at most TRAIN_WORDS distinct
words, those of smallest hash); scoring covers every word of every whole text.

Defined results: null and empty texts get the score of a text without words; without usable labels the score is
0.5 throughout; conflicting labels of an id are left out; of repeated rows of an id one (the smallest text) is fitted, and
all are scored each; an empty table gives no rows; other columns pass through (one that is named as the score gets an
underscore before its name). Ids may be of any type that casts to a string.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import making_room, map_rows, only

TRAIN_ROWS, TRAIN_WORDS, BUCKETS, RANK, STEPS, SEED = 6000, 8192, 1 << 16, 4, 500, 5
CELLS = 16
_CLASSES = np.zeros((256, 7), np.int64)
for _i, _set in enumerate((range(65, 91), range(97, 123), range(48, 58), b".,;:'\"()?-", b"!", b"#$%&*|@^~<>{}[]\\/_=+", b" \t\n\r")):
    _CLASSES[list(_set), _i] = 1
STATISTICS = ("length", "upper", "lower", "digit", "stop", "shout", "symbol", "space", "other", "word", "distinct", "longest", "line", "repeat", "symbol_word")


def statistics(text: bytes, words: list[bytes], distinct: int) -> list[float]:
    """Each statistic in [0, 1]."""
    n, lines = max(1, len(text)), text.split(b"\n")
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES
    share = count / n
    size = max(1, len(words))
    lead = sum(1 for w in words if not w[0:1].isalnum() and w[0] < 128)
    squash = lambda x, scale: x / (x + scale)
    return [squash(np.log1p(len(text)), 6), *share.tolist(), 1 - share.sum(), squash(len(text) / size, 6), distinct / size, squash(max(map(len, words), default=0), 20), squash(len(text) / len(lines), 200), 1 - len(set(lines)) / len(lines), lead / size]


class Features:
    """Feature numbers of a document: hashed words, then a cell for each statistic and metadata value."""

    def __init__(self, buckets: int = BUCKETS, metadata: int = 0) -> None:
        self.buckets, self.metadata, self.known = buckets, metadata, {}
        self.size = buckets + CELLS * (len(STATISTICS) + metadata)

    def of(self, text: bytes | None, metadata: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
        """(word features, cell features)"""
        text = text or b""
        words = text.lower().split()
        distinct, known = set(words), self.known
        if len(known) > 200_000:
            known.clear()
        ids = np.fromiter((known[w] if w in known else known.setdefault(w, zlib.crc32(w) % self.buckets) for w in distinct), np.int32, len(distinct))
        values = [*statistics(text, words, len(distinct)), *(1 - 1000 / (1000 + max(0.0, float(m or 0))) for m in metadata)]
        # Shares are mostly small, so cells are finer near zero.
        cells = [self.buckets + CELLS * i + min(CELLS - 1, int(np.sqrt(min(1.0, max(0.0, v))) * CELLS)) for i, v in enumerate(values)]
        return ids, np.array(cells, np.int32)


class Machine:
    """bias + sum_i w_i x_i + pairwise interactions of rank k; words share one unit of length, cells another."""

    def __init__(self, size: int, rank: int = RANK, seed: int = SEED) -> None:
        self.bias, self.w = 0.0, np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (size, rank))

    def raw(self, words: np.ndarray, cells: np.ndarray) -> float:
        a, b = 1 / np.sqrt(max(1, len(words))), 1 / np.sqrt(len(cells))
        vw, vc = self.v[words], self.v[cells]
        total = vw.sum(axis=0) * a + vc.sum(axis=0) * b
        own = (vw**2).sum() * a * a + (vc**2).sum() * b * b
        return float(self.bias + self.w[words].sum() * a + self.w[cells].sum() * b + 0.5 * ((total**2).sum() - own))

    def score(self, words: np.ndarray, cells: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(words, cells), -30, 30))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], steps: int = STEPS, batch: int = 64, rate: float = 0.1, decay: float = 1e-4, seed: int = SEED) -> Machine:
        """AdaGrad on the logistic loss."""
        rng, size, rank = np.random.default_rng(seed), len(self.w), self.v.shape[1]
        y = np.array([r[2] for r in rows], float)
        if not len(y) or y.min() == y.max():
            self.v[:] = 0
            return self
        self.bias = float(np.log(y.mean() / (1 - y.mean())))
        gw, gv, gb = np.full(size, 1e-6), np.full((size, rank), 1e-6), 1e-6
        for _ in range(steps):
            pick = rng.integers(0, len(rows), min(batch, len(rows)))
            ids = np.concatenate([np.concatenate(rows[i][:2]) for i in pick])
            n = np.array([len(rows[i][0]) + len(rows[i][1]) for i in pick])
            x = np.concatenate([np.concatenate([np.full(len(rows[i][0]), 1 / np.sqrt(max(1, len(rows[i][0])))), np.full(len(rows[i][1]), 1 / np.sqrt(len(rows[i][1])))]) for i in pick])
            row, first = np.repeat(np.arange(len(pick)), n), np.cumsum(n) - n
            vx = self.v[ids] * x[:, None]
            total = np.add.reduceat(vx, first, axis=0)
            z = self.bias + np.add.reduceat(self.w[ids] * x, first) + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), first))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            used, where = np.unique(ids, return_inverse=True)
            dw = np.bincount(where, g[row] * x) + decay * self.w[used]
            dv = (g[row] * x)[:, None] * (total[row] - vx)
            dv = np.stack([np.bincount(where, dv[:, f]) for f in range(rank)], axis=1) + decay * self.v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += g.sum() ** 2
            self.w[used] -= rate * dw / np.sqrt(gw[used])
            self.v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
            self.bias -= rate * g.sum() / np.sqrt(gb)
        return self


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id are for testing only."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = (), train_rows: int = TRAIN_ROWS, buckets: int = BUCKETS, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features and labels of at most ``train_rows`` labelled rows that aren't held out, those of smallest hash."""
    known = only(labels, id=doc_id, label=label).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other")
    known = known.orderBy(F.xxhash64("id"), "id").limit(train_rows).select("id", F.col("label").cast("int").alias("label"))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(metadata)])
    rows = rows.join(F.broadcast(known), "id")  # then one row of each id, so TRAIN_ROWS is a bound
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "text", *[f"m{i}" for i in range(len(metadata))])).alias("r")).select("r.*")

    def run(given: Iterator[tuple]) -> Iterator[tuple]:
        features = Features(buckets, len(metadata))
        for label, body, *meta in given:
            words, cells = features.of(body, tuple(meta))
            if len(words) > TRAIN_WORDS:
                words = words[np.argsort(words * np.uint32(2654435761), kind="stable")[:TRAIN_WORDS]]
            yield label, words.tobytes(), cells.tobytes()

    found = map_rows(rows, run, "label int, words binary, cells binary", pa.schema([("label", pa.int32()), ("words", pa.binary()), ("cells", pa.binary())]))
    got = sorted((bytes(r.words), bytes(r.cells), r.label) for r in found.toLocalIterator())  # in an order that doesn't depend on partitions
    return [(np.frombuffer(w, np.int32), np.frombuffer(c, np.int32), y) for w, c, y in got]


def scores(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = (), train_rows: int = TRAIN_ROWS, text: str = "text", doc_id: str = "doc_id", label: str = "quality", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``score`` (double, 0 to 1): likelier label 1 the higher."""
    docs = making_room(docs, score)
    machine = Machine(Features(BUCKETS, len(metadata)).size).fit(training_rows(docs, labels, metadata, train_rows, BUCKETS, text, doc_id, label))
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w.astype(np.float32), machine.v.astype(np.float32)))
    names = docs.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = Features(BUCKETS, len(metadata)), Machine.__new__(Machine)
        model.bias, model.w, model.v = shared.value
        for part in parts:
            for at in range(0, part.num_rows, 512):
                some = part.slice(at, 512)
                bodies = some.column(names.index(text)).cast(pa.binary()).to_pylist()
                meta = [some.column(names.index(m)).to_pylist() for m in metadata]
                got = [model.score(*features.of(b, tuple(m[i] for m in meta))) for i, b in enumerate(bodies)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(got, pa.float64())], names=[*names, score])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))
