"""Results as tables: an archive partitioned by pair, the exported table, and legacy VTK text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..folders import written
from ..operators.fields import physical
from ..params import PhysicalScale
from ..schema import RESULTS_FORMAT_VERSION, TABLE, TABLE_SCHEMA_VERSION


def save_results(vectors: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, one folder a pair, so that a pair can be added or read alone."""
    vectors.withColumn("format_version", F.lit(RESULTS_FORMAT_VERSION)).write.mode(mode).partitionBy("pair_id").parquet(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """Rows in order of pair and node."""
    got = spark.read.parquet(path)
    if "format_version" not in got.columns:
        raise ValueError("not an archive of results")
    return got.drop("format_version").orderBy("pair_id", *[c for c in ("gj", "gi") if c in got.columns])


def save_pairs(results: DataFrame, path: str, labels: tuple[str, ...] = (), key: str = "pair_id") -> DataFrame:
    """Writes each pair's results to a folder of its own and returns (key, path, n, labels) of what it wrote.

    A pair's rows go out by one task, and Spark's commit puts folders in place only when all tasks are done: a job that fails leaves no half
    pair. A pair that is there is replaced, others stay. ``labels`` (such as the frames' sources) are columns of the results.
    """
    spark = results.sparkSession
    rows = results.withColumn("format_version", F.lit(RESULTS_FORMAT_VERSION))
    order = [c for c in ("gj", "gi", "index_a") if c in rows.columns]
    out = rows.repartition(key).sortWithinPartitions(key, *order)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    got = spark.read.parquet(path).select(F.col(key), F.regexp_extract(F.input_file_name(), f"^(.*/{key}=[^/]*)/", 1).alias("path"), *labels)
    return got.groupBy(key, "path").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in labels])


def export_table(rows: DataFrame, result_type: str = "planar", scale: PhysicalScale | None = None, frame_id: str | None = None, source_a: str | None = None, source_b: str | None = None, key: str = "pair_id") -> DataFrame:
    """All columns of the exported table in order; nodes are numbered down columns. Unscaled units are px and frame."""
    if result_type not in ("planar", "stereo", "ptv"):
        raise ValueError("result_type is 'planar', 'stereo' or 'ptv'")
    r = physical(rows, scale) if scale else rows
    have = set(r.columns)
    order = ["gj", "gi"] if "gi" in have else ["index_a"]
    w = Window.partitionBy(key).orderBy(*order)
    own = {
        "schema_version": F.lit(TABLE_SCHEMA_VERSION), "result_type": F.lit(result_type), "frame_id": F.lit(frame_id) if frame_id else F.col(key).cast("string"),
        "source_a": F.lit(source_a) if source_a or "source_a" not in have else F.col("source_a"), "source_b": F.lit(source_b) if source_b or "source_b" not in have else F.col("source_b"),
        "point_id": F.row_number().over(w), "i": F.col("gi") if "gi" in have else F.lit(None), "j": F.col("gj") if "gj" in have else F.lit(None),
        "masked": F.coalesce("masked", F.lit(False)) if "masked" in have else F.lit(False),
        "length_unit": F.col("length_unit") if "length_unit" in have else F.lit("px"), "time_unit": F.col("time_unit") if "time_unit" in have else F.lit("frame"), "velocity_unit": F.col("velocity_unit") if "velocity_unit" in have else F.lit("px/frame"),
    }
    return r.select(*[own.get(n, F.col(n) if n in have else F.lit(None)).cast(kind).alias(n) for n, kind in TABLE])


def write_csv(table: DataFrame, path: str) -> None:
    """Strings always quoted with doubled quotes, booleans true and false, missing values empty."""
    quoted = [F.concat(F.lit('"'), F.replace(F.col(n), F.lit('"'), F.lit('""')), F.lit('"')) if kind == "string" else F.col(n).cast("string") for n, kind in table.dtypes]
    line = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in quoted])
    order = [c for c in ("frame_id", "point_id") if c in table.columns]
    body = table.select(*order, line.alias("value")).orderBy(*order).select("value")
    head = table.sparkSession.createDataFrame([(",".join(table.columns),)], "value string").coalesce(1)
    head.unionAll(body).write.mode("overwrite").text(path)


def vtk_text(rows: DataFrame, title: str = "vectors") -> DataFrame:
    """Lines (value) of a legacy structured grid for one result: points row by row, vectors, then scalar arrays. ``rows`` are evaluated once."""
    rows = written(rows, "vtk")
    shape = rows.agg(F.max("gj"), F.max("gi"), F.count("*")).first()
    nx, ny, n = shape
    spark = rows.sparkSession
    num = lambda c: F.when(F.isnan(c), F.lit("nan")).otherwise(F.col(c).cast("string")) if c else F.lit("0.0")
    have = rows.columns
    z, w = ("z" if "z" in have else None), ("w" if "w" in have else None)
    parts = [(f"# vtk DataFile Version 3.0\n{title}\nASCII\nDATASET STRUCTURED_GRID\nDIMENSIONS {nx} {ny} 1\nPOINTS {n} double", F.concat_ws(" ", num("x"), num("y"), num(z))), (f"POINT_DATA {n}\nVECTORS velocity double", F.concat_ws(" ", num("u"), num("v"), num(w)))]
    for c in ("peak_ratio", "correlation_moment", "uncertainty_u", "uncertainty_v", "uncertainty_w"):
        if c in have:
            parts.append((f"SCALARS {c} double 1\nLOOKUP_TABLE default", num(c)))
    for c in ("outlier", "masked"):
        if c in have:
            parts.append((f"SCALARS {c} int 1\nLOOKUP_TABLE default", F.col(c).cast("int").cast("string")))
    every = None
    for k, (head, value) in enumerate(parts):
        block = rows.select(F.lit(2 * k + 1).alias("part"), "gi", "gj", value.alias("value"))
        lines = spark.createDataFrame([(2 * k, i, 0, line) for i, line in enumerate(head.split("\n"))], "part int, gi int, gj int, value string")
        block = lines.unionAll(block)
        every = block if every is None else every.unionAll(block)
    return every.orderBy("part", "gi", "gj").select("value")


def write_vtk(rows: DataFrame, path: str, title: str = "vectors") -> None:
    vtk_text(rows, title).coalesce(1).write.mode("overwrite").text(path)
