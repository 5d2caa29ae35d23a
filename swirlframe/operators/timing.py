"""Joins along time and frame numbers without all pairs: spans that hold from a frame to a frame, and the nearest in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def span_join(rows: DataFrame, spans: DataFrame, at: str, first: str, last: str, keys: Sequence[str] = (), width: int = 256, how: str = "left") -> DataFrame:
    """``rows`` with the other columns of every span of equal keys that holds at their ``at`` (both ends included).

    A span stands in each block of ``width`` numbers that it touches, and a row in its own block, so a row meets the spans of one block.
    A span without a beginning or an end (null) reaches as far as the rows do.
    """
    block = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    ends = rows.agg(F.max(at).alias("hi"), F.min(at).alias("lo")).first()
    lo, hi = (F.lit(0), F.lit(0)) if ends.hi is None else (F.lit(ends.lo), F.lit(ends.hi))
    own = {k: f"_k{i}" for i, k in enumerate(keys)}
    s = spans.withColumns({"_hi": F.least(F.coalesce(F.col(last), hi), hi), "_lo": F.greatest(F.coalesce(F.col(first), lo), lo)}).filter(F.col("_lo") <= F.col("_hi"))
    s = s.withColumn("_block", F.explode(F.sequence(block("_lo"), block("_hi")))).withColumnsRenamed(own)
    on = F.col("_at_block") == F.col("_block")
    for k, r in own.items():
        on = on & (F.col(k) == F.col(r))
    on = on & (F.col(at) >= F.col("_lo")) & (F.col(at) <= F.col("_hi"))
    return rows.withColumn("_at_block", block(at)).join(s, on, how).drop("_at_block", "_block", "_lo", "_hi", *own.values())


def nearest_in_time(a: DataFrame, b: DataFrame, tolerance: float, ts: str = "ts", keys: Sequence[str] = (), block: float | None = None, how: str = "inner") -> DataFrame:
    """Rows of ``a`` with the row of ``b`` (columns with suffix _b) nearest in time within the tolerance; of two as near, the earlier.

    Time is cut into blocks of some tolerances; a row of ``b`` also stands in a neighbouring block if it is within the tolerance of it. In a
    block both sides are sorted together, and each row of ``a`` sees the last row of ``b`` before it and the first after it, nothing else.
    Several rows of ``b`` at one time: the one whose columns come first. Rows without a time are met by nobody.
    """
    width = float(block or max(64 * tolerance, 1e-9))
    if width < tolerance:
        raise ValueError("a block is as wide as the tolerance or wider")
    t = F.col(ts).cast("double")
    at = lambda x: F.floor(x / width).cast("long")
    left = a.withColumns({"_t": t, "_block": at(t), "_b": F.lit(None).cast(_row_type(b))})
    right = b.select(*keys, t.alias("_t"), F.struct(*[F.col(c) for c in b.columns]).alias("_b")).filter("_t IS NOT NULL")
    right = right.withColumn("_block", F.explode(F.array_distinct(F.array(at(F.col("_t") - tolerance), at(F.col("_t")), at(F.col("_t") + tolerance)))))
    both = left.select(*keys, "_block", "_t", "_b", F.struct(*[F.col(c) for c in a.columns]).alias("_a"), F.lit(1).alias("_side"))
    both = both.unionByName(right.withColumns({"_a": F.lit(None).cast(_row_type(a)), "_side": F.lit(0)}).select(*keys, "_block", "_t", "_b", "_a", "_side"))
    w = Window.partitionBy(*keys, "_block").orderBy("_t", "_side", "_b")
    mine = F.when(F.col("_side") == 0, F.struct("_t", "_b"))
    # A row before: the first of the latest time; so rows of b at one time are told apart by their order.
    lead = F.first(mine, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    lag = F.last(F.when((F.col("_side") == 0) & F.col("_new"), F.struct("_t", "_b")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    new = F.coalesce(F.lag("_t").over(w) < F.col("_t"), F.lit(True)) | (F.col("_side") == 1)
    near = both.withColumn("_new", new).withColumns({"_before": lag, "_after": lead}).filter("_side = 1")
    back, on = F.col("_t") - F.col("_before._t"), F.col("_after._t") - F.col("_t")
    fine = lambda d: F.coalesce(d <= tolerance, F.lit(False))
    pick = F.when(fine(back) & (~fine(on) | (back <= on)), F.col("_before._b")).when(fine(on), F.col("_after._b"))
    out = near.withColumn("_pick", pick)
    out = out.filter("_pick IS NOT NULL") if how == "inner" else out
    return out.select(*[F.col(f"_a.`{c}`").alias(c) for c in a.columns], *[F.col(f"_pick.`{c}`").alias(f"{c}_b") for c in b.columns])


def _row_type(df: DataFrame) -> str:
    return "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in df.schema.fields) + ">"


def synchronised(first: DataFrame, second: DataFrame, tolerance: float, ts: str = "ts", keys: Sequence[str] = (), strict: bool = True, dt_tolerance: float | None = None) -> DataFrame:
    """Frame pairs of two cameras that were taken together: columns of the first with its own names, of the second with suffix _b.

    ``strict`` refuses what stereo can't use: frames of either camera without a partner, one that is the partner of two, and (with
    ``dt_tolerance``) pairs whose column dt differs by more. The check is an error while the job runs, not an action before it.
    """
    pairs = nearest_in_time(first, second, tolerance, ts, keys, how="left")
    if not strict:
        return pairs.filter(F.col(f"{ts}_b").isNotNull())
    need = lambda ok, what: F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(what)))
    here = pairs.filter(need(F.col(f"{ts}_b").isNotNull(), "a frame of the first camera has no partner"))
    if dt_tolerance is not None:
        here = here.filter(need(F.abs(F.col("dt") - F.col("dt_b")) <= dt_tolerance, "the cameras' pairs have different times between frames"))
    used = Window.partitionBy(*[f"{k}_b" for k in keys], f"{ts}_b")
    here = here.withColumn("_used", F.count("*").over(used)).filter(need(F.col("_used") == 1, "a frame of the second camera is the partner of two")).drop("_used")
    counts = first.groupBy(*keys).agg(F.count("*").alias("_n1")), second.groupBy(*keys).agg(F.count("*").alias("_n2"))
    if keys:
        sizes = counts[0].join(counts[1], list(keys), "full")
        here = here.join(sizes, list(keys), "full")
    else:
        here = here.join(F.broadcast(counts[0].crossJoin(F.broadcast(counts[1]))), F.lit(True), "right")  # one row each
    same = F.coalesce(F.col("_n1") == F.col("_n2"), F.lit(False))
    return here.filter(need(same, "the cameras have different numbers of frames")).filter(F.col(ts).isNotNull()).drop("_n1", "_n2")
