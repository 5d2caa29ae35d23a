"""Exact order statistics of groups by distributed selection, and joins of rows with a row of their group.

A value's 64 bits, turned so that they order as the values do, are counted by their leading BITS in each group (summed on the map
side); the running counts tell which prefix holds a wanted rank, and the next turn counts the following bits of the values with that
prefix only. As soon as no prefix holds more than ``gather`` values they are gathered and sorted. So no task ever holds a group's
values, whatever its size, and there are at most 64 / BITS turns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..folders import written

BITS, GATHER = 16, 2048
#: What is broadcast at most, and the parts that a group is dealt to where its rows can't be sent to every task.
BROADCAST_BYTES, SALTS = 16 << 20, 32


def joined(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys are equal, as they are in groups."""
    own = {k: f"_r{i}" for i, k in enumerate(keys)}
    on = F.lit(True)
    for k, r in own.items():
        on = on & F.col(k).eqNullSafe(F.col(r))
    return a.join(b.withColumnsRenamed(own), on, how).drop(*own.values())


def beside(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left", row_bytes: int = 64) -> DataFrame:
    """``rows`` with the columns of their group's row of ``table`` (one a group); no group's rows meet in one task.

    The table goes to every task where it is counted to be small. Otherwise a group's rows are dealt to SALTS tasks and its row to all of them.
    """
    table = written(table, "groups")
    if not keys:
        return rows.join(F.broadcast(table), F.lit(True), how)  # one row
    if table.count() * row_bytes <= BROADCAST_BYTES:
        return joined(rows, F.broadcast(table), keys, how)
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return joined(rows.withColumn("_salt", salt), spread, [*keys, "_salt"], how).drop("_salt")


def _turned(bits: np.ndarray) -> np.ndarray:
    """Signed integers that order as the doubles of these bits; its own inverse."""
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _encoded(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(keys, _of, _b): a row for each value that is a number; _of is the place of its column."""
    kinds = dict(df.dtypes)
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "_of int, _b bigint"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(len(values)):
                column = part.column(len(keys) + i)
                fine = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                v = column.take(pa.array(fine)).to_numpy(zero_copy_only=False).astype(float)
                number = ~np.isnan(v)
                v, rows = v[number] + 0.0, pa.array(fine[number])
                own = [part.column(c).take(rows) for c in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(v), i, np.int32)), pa.array(_turned(v.view(np.int64)))], names=[*keys, "_of", "_b"])

    return df.select(*keys, *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)]).mapInArrow(run, schema)


def ranked(df: DataFrame, keys: Sequence[str], values: Sequence[str], ranks: Sequence[Column], gather: int = GATHER) -> DataFrame:
    """(keys, _of, _n, _rank, _at, _value): the values at the given ranks (from 0, columns over _n, the group's count of numbers), by their places."""
    group = [*keys, "_of"]
    bits = written(_encoded(df, keys, values), "bits")
    counts = written(bits.groupBy(*group).agg(F.count("*").alias("_n")), "counts")
    want = counts.select(*group, "_n", F.posexplode(F.array(*[r.cast("long") for r in ranks])).alias("_rank", "_at"))
    want = want.withColumn("_left", F.col("_at")).withColumn("_prefix", F.lit(0).cast("long"))
    most, depth, pool = counts.agg(F.max("_n")).first()[0] or 0, 0, bits.withColumn("_prefix", F.lit(0).cast("long"))
    on = [*group, "_prefix"]
    while most > gather and depth < 64:
        depth = min(64, depth + BITS)
        deeper = pool.select(*group, F.col("_prefix"), F.shiftright("_b", 64 - depth).alias("_next"))
        sums = deeper.groupBy(*on, "_next").agg(F.count("*").alias("_c"))
        run = Window.partitionBy(*on).orderBy("_next")  # at most 2^BITS rows
        sums = written(sums.withColumn("_before", F.sum("_c").over(run) - F.col("_c")), "prefixes")
        found = joined(want, sums, on).filter((F.col("_left") >= F.col("_before")) & (F.col("_left") < F.col("_before") + F.col("_c")))
        want = written(found.select(*group, "_n", "_rank", "_at", (F.col("_left") - F.col("_before")).alias("_left"), F.col("_next").alias("_prefix"), "_c"), "wanted")
        most = want.agg(F.max("_c")).first()[0] or 0
        kept = want.select(*on).distinct()
        pool = bits.withColumn("_prefix", F.shiftright("_b", 64 - depth))
        if depth < 64 and most > gather:
            pool = written(beside(pool, kept, on, "inner"), "pool")
        want = want.drop("_c")
    if depth == 64:
        done = want.withColumn("_b", F.col("_prefix"))
    else:
        some = beside(pool, want.select(*on).distinct(), on, "inner") if depth else pool
        lists = some.groupBy(*on).agg(F.array_sort(F.collect_list("_b")).alias("_s"))  # ``gather`` values at most
        done = joined(want, lists, on).withColumn("_b", F.get("_s", F.col("_left").cast("int")))
    kinds = "".join(f"`{k}` {dict(df.dtypes)[k]}, " for k in keys)

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            b = _turned(part.column(part.num_columns - 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(b.view(np.float64))], names=[*part.schema.names[:-1], "_value"])

    return done.select(*group, "_n", "_rank", "_at", "_b").mapInArrow(decode, kinds + "_of int, _n bigint, _rank int, _at bigint, _value double")


def quantiles(df: DataFrame, keys: Sequence[str], values: Sequence[str], q: float = 0.5, names: Sequence[str] | None = None, nearest_rank: bool = False, gather: int = GATHER) -> DataFrame:
    """(keys, a column for each of ``values`` and n_<name>): exact quantiles and counts of each group's numbers (null and NaN left out).

    Interpolated between the two nearest ranks, or the nearest rank's value; null where a group has no number (absent if in no column).
    """
    names = list(names or values)
    n = F.col("_n")
    place = q * (n - 1)
    ranks = [F.greatest(F.ceil(q * n) - 1, F.lit(0))] if nearest_rank else [F.floor(place), F.least(F.floor(place) + 1, n - 1)]
    got = ranked(df, keys, values, ranks, gather)
    lo, hi = (F.max(F.when(F.col("_rank") == r, F.col("_value"))) for r in (0, 1))
    each = got.groupBy(*keys, "_of", "_n").agg(lo.alias("_lo"), (lo if nearest_rank else hi).alias("_hi"))
    part = q * (F.col("_n") - 1) - F.floor(q * (F.col("_n") - 1))
    each = each.withColumn("_value", F.when((part == 0) | (F.col("_lo") == F.col("_hi")), F.col("_lo")).otherwise(F.col("_lo") * (1 - part) + F.col("_hi") * part))
    of = lambda c, i: F.max(F.when(F.col("_of") == i, F.col(c)))
    aggs = [of("_value", i).alias(name) for i, name in enumerate(names)] + [F.coalesce(of("_n", i), F.lit(0)).alias(f"n_{name}") for i, name in enumerate(names)]
    return each.groupBy(*keys).agg(*aggs) if keys else each.agg(*aggs)


def numbered(df: DataFrame, order: Sequence[str], name: str, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``name``: places from 1 in the given order (within ``keys``), without gaps and without a task that sees all rows.

    Rows are dealt by ranges of (keys, order) and written with their place in their range; the ranges' counts, added up, give the rest.
    """
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part_id, done = TaskContext.get().partitionId(), 0
        for part in parts:
            at = np.arange(done, done + part.num_rows)
            done += part.num_rows
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, part_id, np.int64)), pa.array(at)], names=[*part.schema.names, "_range", "_place"])

    rows = written(dealt.mapInArrow(place, f"{kinds}, _range bigint, _place bigint"), "numbered")
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_size"))  # a row a task
    offsets = {r["_range"]: r["_size"] for r in sizes.collect()}
    at, total = {}, 0
    for k in sorted(offsets):
        at[k] = total
        total += offsets[k]
    start = rows.sparkSession.createDataFrame(list(at.items()), "_range bigint, _offset bigint")
    whole = rows.join(F.broadcast(start), "_range").withColumn(name, F.col("_offset") + F.col("_place") + 1)
    if keys:
        whole = beside(whole, whole.groupBy(*keys).agg((F.min(name) - 1).alias("_first")), keys).withColumn(name, F.col(name) - F.col("_first")).drop("_first")
    return whole.select(*df.columns, name)
