"""A table that a stream upserts into and readers see whole: each batch makes a version, only changed buckets are written anew."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType, _parse_datatype_string


class LiveTable:
    """Rows by key in ``buckets`` folders of ``path``. A version is a small file that names, for each bucket, the batch that wrote it last.

    It is put in place by one rename after all its data is there, so a reader of a version never sees half of a batch. A batch that was
    put in place before changes nothing when it comes again; one that failed leaves files that no version names (``vacuum`` drops them).
    There is one writer at a time, as a streaming query is. Versions are numbered by batch, and those in between may be missing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: Sequence[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.schema = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
        self._versions = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        self._files = self._versions.getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._files.exists(self._versions):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._versions)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _manifest(self, version: int | None) -> dict[int, int]:
        known = self.versions()
        if version is None:
            version = known[-1] if known else None
        elif version not in known:
            raise ValueError(f"there is no version {version}")
        if version is None:
            return {}
        text = self.spark.read.text(f"{self.path}/versions/{version:012d}.json", wholetext=True).first()[0]
        return {int(k): v for k, v in json.loads(text).items()}

    def _folder(self, batch: int, bucket: int) -> str:
        return f"{self.path}/data/batch-{batch:012d}/b={bucket}"

    def _rows(self, parts: dict[int, int]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self._folder(v, k) for k, v in sorted(parts.items())])

    def read(self, version: int | None = None) -> DataFrame:
        """The latest version, or that one, as it was put in place."""
        return self._rows(self._manifest(version))

    def upsert(self, rows: DataFrame, batch: int, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> bool:
        """Takes a batch in; False if it had been before. ``merge(old, new)`` makes the rows of the changed buckets (the new ones in place of old, if None)."""
        if batch in self.versions():
            return False
        parts = self._manifest(None)
        b = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = rows.select(*self.schema.names)
        changed = [r.b for r in rows.select(b.alias("b")).distinct().collect()]  # at most ``buckets``
        old = self._rows({k: v for k, v in parts.items() if k in set(changed)})
        done = old.join(rows.select(*self.keys).distinct(), self.keys, "left_anti").unionByName(rows) if merge is None else merge(old, rows).select(*self.schema.names)
        if changed:
            done.withColumn("b", b).repartition("b").write.mode("overwrite").partitionBy("b").parquet(f"{self.path}/data/batch-{batch:012d}")
        there = {k for k in changed if self._files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(batch, k)))}
        self._put(batch, {k: v for k, v in parts.items() if k not in set(changed)} | dict.fromkeys(there, batch))
        return True

    def _put(self, version: int, parts: dict[int, int]) -> None:
        of = self.spark._jvm.org.apache.hadoop.fs.Path
        draft, final = of(f"{self.path}/versions/.{version:012d}.draft"), of(f"{self.path}/versions/{version:012d}.json")
        out = self._files.create(draft, True)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        if not self._files.rename(draft, final):
            raise RuntimeError(f"version {version} is there already")

    def vacuum(self, keep: int = 2) -> None:
        """Drops all versions but the last ``keep``, and data that none of those names. Readers of dropped ones fail."""
        known = self.versions()
        named = {(v, k) for version in known[-keep:] for k, v in self._manifest(version).items()}
        of = self.spark._jvm.org.apache.hadoop.fs.Path
        for version in known[:-keep]:
            self._files.delete(of(f"{self.path}/versions/{version:012d}.json"), False)
        data = of(f"{self.path}/data")
        for batch in self._files.listStatus(data) if self._files.exists(data) else []:
            for bucket in self._files.listStatus(batch.getPath()):
                name = bucket.getPath().getName()
                at = int(batch.getPath().getName().removeprefix("batch-")), int(name.removeprefix("b=")) if name.startswith("b=") else -1
                if at not in named:
                    self._files.delete(bucket.getPath(), True)

    def follow(self, stream: DataFrame, checkpoint: str, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None, trigger: dict | None = None) -> StreamingQuery:
        """A streaming query that upserts each batch (after ``prepare``), once however often it is tried."""

        def each(rows: DataFrame, batch: int) -> None:
            if batch not in self.versions():
                self.upsert((prepare(rows) if prepare else rows).persist(), batch, merge)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


PLANES = "job int, plane array<double>, n long"


def summed(planes: DataFrame) -> DataFrame:
    """PLANES: sums of equal jobs' planes (job, plane and, if there is one, n); a task adds up its own before the shuffle."""
    n = F.col("n") if "n" in planes.columns else F.lit(1)
    rows = planes.select(F.col("job").cast("int"), F.col("plane").cast("array<double>"), n.cast("long").alias("n"))

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for part in parts:
            for r, (job, count) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                plane = part.column(1)[r].values.to_numpy(zero_copy_only=False)
                if job in held:
                    held[job][0] += plane
                    held[job][1] += count
                else:
                    held[job] = [np.array(plane, float), count]
        for job, (plane, count) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([job], pa.int32()), pa.array([plane], pa.list_(pa.float64())), pa.array([count], pa.int64())], names=["job", "plane", "n"])

    return rows.mapInArrow(add, PLANES).repartition("job").sortWithinPartitions("job").mapInArrow(add, PLANES)


def live_ensemble_table(spark: SparkSession, path: str, buckets: int = 64) -> LiveTable:
    """A table of growing planes by job: ``grow(table, stream, checkpoint)`` adds batches to it."""
    return LiveTable(spark, path, PLANES, ["job"], buckets)


def grow(table: LiveTable, stream: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Adds every batch's planes to those of the same job; jobs that a batch doesn't touch stay where they are."""
    return table.follow(stream, checkpoint, merge=lambda old, new: summed(old.unionByName(new)), prepare=summed, trigger=trigger)
