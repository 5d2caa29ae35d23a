"""Queries of the library's operators on the driver's tables, each with its SQL twin where SQL can express it.

``events`` is read as a recording of vector fields (a day a frame, 8 x 8 nodes), ``embeddings`` as 8 x 8 images,
``part`` and ``lineitem`` as scattered points. Floats are rounded and NaN is null on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import functions as C
from . import streaming
from .kernels import correlation, geometry, synthetic
from .operators import calibration, fields, neighbors, recordings, timing, tracks
from .params import PhysicalScale, PIVParameters, PTVParameters, multipass_parameters
from .plans import images as prepared
from .plans import piv, ptv
from .sources import images, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, NaN and infinities null; minus zero is zero."""
    clean = lambda c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(None)).otherwise(F.round(F.col(c), digits) + F.lit(0.0))
    return df.select(*[clean(n).alias(n) if k == "double" else F.col(n) for n, k in df.dtypes])


def gf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector fields: frame, gi, gj, x, y, u, v, masked, outlier on a full grid."""
    e = _table(spark, sf_dir, "events").select(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("frame"), (F.floor(F.hour("ts") / 3) + 1).cast("int").alias("gi"), (F.col("user_id") % 8 + 1).cast("int").alias("gj"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"), (F.col("event_type") == "error").alias("bad"))
    g = e.groupBy("frame", "gi", "gj").agg((F.avg("value") / 47.3).alias("u"), (F.avg("k") / 9.7).alias("v"), (F.count_if("bad") >= 2).alias("outlier"))
    grid = e.select("frame").distinct().withColumn("gi", F.explode(F.sequence(F.lit(1), F.lit(8)))).withColumn("gj", F.explode(F.sequence(F.lit(1), F.lit(8))))
    nan = F.lit(float("nan"))
    return grid.join(g, ["frame", "gi", "gj"], "left").select("frame", "gi", "gj", (F.col("gj") * 16.0).alias("x"), (F.col("gi") * 16.0).alias("y"), F.coalesce("u", nan).alias("u"), F.coalesce("v", nan).alias("v"), F.col("u").isNull().alias("masked"), F.coalesce("outlier", F.lit(False)).alias("outlier"))


GF = """
e AS (SELECT date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS frame, CAST(hour(ts) // 3 + 1 AS INT) AS gi, CAST(user_id % 8 + 1 AS INT) AS gj, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type = 'error' AS bad FROM events),
g AS (SELECT frame, gi, gj, avg(value) / 47.3::DOUBLE AS u, avg(k) / 9.7::DOUBLE AS v, count(*) FILTER (bad) >= 2 AS outlier FROM e GROUP BY ALL),
gf AS (SELECT CAST(f.frame AS INT) AS frame, CAST(a.i AS INT) AS gi, CAST(b.j AS INT) AS gj, b.j * 16.0::DOUBLE AS x, a.i * 16.0::DOUBLE AS y, u, v, u IS NULL AS masked, coalesce(outlier, false) AS outlier
  FROM (SELECT DISTINCT frame FROM e) f CROSS JOIN (SELECT unnest(generate_series(1, 8)) AS i) a CROSS JOIN (SELECT unnest(generate_series(1, 8)) AS j) b LEFT JOIN g ON g.frame = f.frame AND g.gi = a.i AND g.gj = b.j),
ok AS (SELECT *, u IS NOT NULL AND NOT outlier AS good FROM gf)
"""
_R = lambda c, n=None: f"round({c}, 6) + 0.0 AS {n or c}"


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 images: frame_idx from 1, pixels array<double>."""
    e = _table(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64)
    return e.select((F.col("vec_id") + 1).alias("frame_idx"), F.lit(8).alias("n_rows"), F.lit(8).alias("n_cols"), F.col("embedding").cast("array<double>").alias("pixels"))


TILES = """
t AS (SELECT vec_id + 1 AS frame_idx, list_transform(embedding, lambda z: z::DOUBLE) AS pixels FROM embeddings WHERE len(embedding) = 64),
px AS (SELECT frame_idx, (k - 1) // 8 + 1 AS r, (k - 1) % 8 + 1 AS c, p FROM (SELECT frame_idx, unnest(pixels) AS p, generate_subscripts(pixels, 1) AS k FROM t))
"""

# --- pairing ---


@_query("SELECT row_number() OVER (ORDER BY a.vec_id)::INT AS pair_id, a.vec_id + 1 AS idx_a, b.vec_id + 1 AS idx_b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE len(a.embedding) = 64 AND len(b.embedding) = 64 AND a.vec_id % 2 = 0")
def pairing_paired(spark, sf_dir):
    return recordings.image_pairs(tiles(spark, sf_dir)).drop("dt")


@_query("WITH f AS (SELECT event_id + 1 AS i, epoch_us(ts) / 1000000.0 AS t FROM events) SELECT row_number() OVER (ORDER BY d, a.i)::INT AS pair_id, a.i AS idx_a, b.i AS idx_b, round(b.t - a.t, 3) + 0.0 AS dt FROM f a CROSS JOIN (VALUES (1), (3)) v(d) JOIN f b ON b.i = a.i + d WHERE a.i > 1 AND (a.i - 2) % 2 = 0")
def pairing_chained_multi_delta(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("frame_idx"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return rounded(recordings.image_pairs(e, "chained", 2, 1, (1, 3), ts="t"), 3)


# --- along time ---

_SPANS = "SELECT o_orderkey % 700 * 31 AS first, o_orderkey % 700 * 31 + o_custkey % 40 AS last, o_custkey AS mask FROM orders"


@_query(f"WITH s AS ({_SPANS}) SELECT e.event_id, count(s.mask) AS n, min(s.mask) AS lowest, max(s.mask) AS highest FROM events e LEFT JOIN s ON e.event_id BETWEEN s.first AND s.last GROUP BY e.event_id")
def mask_spans(spark, sf_dir):
    """Masks that hold from a frame to a frame, at every frame."""
    k = F.col("o_orderkey") % 700 * 31
    spans = _table(spark, sf_dir, "orders").select(k.alias("first"), (k + F.col("o_custkey") % 40).alias("last"), F.col("o_custkey").alias("mask"))
    held = timing.span_join(_table(spark, sf_dir, "events").select("event_id"), spans, "event_id", "first", "last")
    return held.groupBy("event_id").agg(F.count("mask").alias("n"), F.min("mask").alias("lowest"), F.max("mask").alias("highest"))


_TWO = "e AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0 AS t FROM events), a AS (SELECT * FROM e WHERE event_id % 3 = 0), b AS (SELECT user_id, t, min(event_id) AS event_id FROM e WHERE event_id % 3 <> 0 GROUP BY ALL)"


@_query(f"WITH {_TWO}, p AS (SELECT a.*, b.event_id AS before, a.t - b.t AS back FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND b.t <= a.t), q AS (SELECT p.*, b.event_id AS after, b.t - p.t AS ahead FROM p ASOF LEFT JOIN b ON p.user_id = b.user_id AND b.t >= p.t), r AS (SELECT event_id, user_id, CASE WHEN back <= 40000 AND (ahead IS NULL OR ahead > 40000 OR back <= ahead) THEN before WHEN ahead <= 40000 THEN after END AS event_id_b FROM q) SELECT event_id, user_id, event_id_b FROM r WHERE event_id_b IS NOT NULL")
def nearest_in_time(spark, sf_dir):
    """Frames of one camera with the nearest of another, by recording, within a tolerance."""
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return timing.nearest_in_time(e.filter("event_id % 3 = 0"), e.filter("event_id % 3 <> 0"), 40000.0, keys=("user_id",)).select("event_id", "user_id", "event_id_b")


@_query(f"WITH v AS (SELECT epoch_us(time_bucket(INTERVAL '6 hours', ts)) // 1000000 AS start, CAST(user_id % 8 + 1 AS INT) AS gi, CAST(event_id % 4 + 1 AS INT) AS gj, value / 47.3::DOUBLE AS u, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v, event_type <> 'error' AS ok FROM events) SELECT start::BIGINT AS start, gi, gj, count(*) FILTER (ok AND u IS NOT NULL AND v IS NOT NULL) AS count, " + ", ".join(f"round({f}({c}) FILTER (ok AND u IS NOT NULL AND v IS NOT NULL), 6) + 0.0 AS {n}_{c}" for c in "uv" for n, f in (("mean", "avg"), ("rms", "stddev_pop"))) + " FROM v GROUP BY start, gi, gj")
def time_windows(spark, sf_dir):
    """Statistics of valid vectors by node in windows of event time; the same call runs on a stream."""
    e = _table(spark, sf_dir, "events")
    v = e.select("ts", (F.col("user_id") % 8 + 1).cast("int").alias("gi"), (F.col("event_id") % 4 + 1).cast("int").alias("gj"), (F.col("value") / 47.3).alias("u"), F.get_json_object("props", "$.k").cast("double").alias("v"), (F.col("event_type") == "error").alias("outlier"))
    got = streaming.windowed_statistics(v, "6 hours")
    return rounded(got.select(F.floor(F.unix_micros(F.col("window.start").cast("timestamp")) / 1000000).alias("start"), *[c for c in got.columns if c != "window"]))


# --- images ---


def _image_query(name: str, column: Callable[[Column], Column], sql: str) -> None:
    def run(spark, sf_dir):
        done = tiles(spark, sf_dir).select("frame_idx", F.posexplode(column(F.col("pixels"))).alias("k", "p"))
        return rounded(done.select("frame_idx", (F.col("k") + 1).cast("int").alias("k"), "p"))

    run.__name__ = name
    _query(f"WITH {TILES} SELECT frame_idx, CAST((r - 1) * 8 + c AS INT) AS k, round({sql}, 6) + 0.0 AS p FROM px")(run)


_image_query("invert", C.invert_image, "min(p) OVER (PARTITION BY frame_idx) + max(p) OVER (PARTITION BY frame_idx) - p")
_image_query("percentile_stretch", C.percentile_stretch, "least(greatest((p - quantile_cont(p, 0.01) OVER (PARTITION BY frame_idx)) / (quantile_cont(p, 0.99) OVER (PARTITION BY frame_idx) - quantile_cont(p, 0.01) OVER (PARTITION BY frame_idx)), 0), 1)")
_image_query("intensity_cap", C.intensity_cap, "least(p, median(p) OVER (PARTITION BY frame_idx) + 2 * stddev_samp(p) OVER (PARTITION BY frame_idx))")


@_query(f"WITH {TILES}, b AS (SELECT r, c, min(p) AS lo, avg(p) AS mean FROM px GROUP BY r, c) SELECT frame_idx, CAST((px.r - 1) * 8 + px.c AS INT) AS k, round(greatest(p - mean, 0), 6) + 0.0 AS above_mean, round(greatest(p - lo, 0), 6) + 0.0 AS above_min FROM px JOIN b ON px.r = b.r AND px.c = b.c")
def background(spark, sf_dir):
    t = tiles(spark, sf_dir)
    lo, mean = (F.broadcast(recordings.compute_background(t, m).select(F.col("pixels").alias(m))) for m in ("min", "mean"))  # one row of 64 numbers each
    both = t.crossJoin(lo).crossJoin(mean).select("frame_idx", F.posexplode(F.arrays_zip(C.subtract_background("pixels", "mean").alias("a"), C.subtract_background("pixels", "min").alias("b"))).alias("k", "s"))
    return rounded(both.select("frame_idx", (F.col("k") + 1).cast("int").alias("k"), F.col("s.a").alias("above_mean"), F.col("s.b").alias("above_min")))


@_query(f"WITH {TILES} SELECT frame_idx, r::INT AS row, c::INT AS col, round(greatest(avg(q) - avg(m) * avg(m), 0), 6) + 0.0 AS variance FROM (SELECT a.frame_idx, a.r, a.c, b.p * b.p AS q, b.p AS m FROM px a JOIN px b ON a.frame_idx = b.frame_idx AND abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2) GROUP BY ALL")
def local_variance(spark, sf_dir):
    done = recordings.local_variance(tiles(spark, sf_dir), 2).select("frame_idx", F.posexplode("variance").alias("k", "variance"))
    return rounded(done.select("frame_idx", (F.floor(F.col("k") / 8) + 1).cast("int").alias("row"), (F.col("k") % 8 + 1).cast("int").alias("col"), "variance"))


@_query(f"WITH {TILES}, q AS (SELECT *, quantile_cont(p, 0.95) OVER (PARTITION BY frame_idx) AS t FROM px), m AS (SELECT frame_idx, r, c FROM q WHERE p >= t) SELECT DISTINCT m.frame_idx, CAST(m.r + a AS INT) AS row, CAST(m.c + b AS INT) AS col FROM m CROSS JOIN (SELECT unnest(generate_series(-2, 2)) AS a) CROSS JOIN (SELECT unnest(generate_series(-2, 2)) AS b) WHERE a * a + b * b <= 4 AND m.r + a BETWEEN 1 AND 8 AND m.c + b BETWEEN 1 AND 8")
def auto_mask_grown(spark, sf_dir):
    return recordings.bright_masks(tiles(spark, sf_dir), 0.95, 2, ("frame_idx",))


@_query(f"WITH {TILES}, s AS (SELECT *, min(p) OVER (PARTITION BY frame_idx) AS lo, max(p) OVER (PARTITION BY frame_idx) AS hi FROM px), h AS (SELECT frame_idx, lo, hi, least(floor((p - lo) / (hi - lo) * 256), 255) AS bin, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT *, lo + (bin + 0.5) * (hi - lo) / 256 AS c FROM h), w AS (SELECT *, sum(n) OVER a AS w, sum(n * c) OVER a AS m, sum(n) OVER b AS wa, sum(n * c) OVER b AS ma FROM k WINDOW a AS (PARTITION BY frame_idx ORDER BY bin), b AS (PARTITION BY frame_idx)), z AS (SELECT *, CASE WHEN wa > w THEN w * (wa - w) * (m / w - (ma - m) / (wa - w)) ** 2 ELSE -1 END AS gap FROM w) SELECT frame_idx, round(arg_max(c, gap), 6) + 0.0 AS threshold FROM z GROUP BY frame_idx")
def otsu_threshold(spark, sf_dir):
    return rounded(recordings.otsu_thresholds(tiles(spark, sf_dir)).select("frame_idx", "threshold"))


def mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 4 x 4 tiles: frame_idx from 1, 32 x 32 pixels; zero where there is no tile."""
    t = tiles(spark, sf_dir).select(F.floor((F.col("frame_idx") - 1) / 16).alias("m"), ((F.col("frame_idx") - 1) % 16).cast("int").alias("at"), "pixels")
    held = t.groupBy("m").agg(F.map_from_entries(F.collect_list(F.struct("at", "pixels"))).alias("tiles"))  # 16 at most
    div = lambda x, n: F.floor(x / n).cast("int")
    pixel = lambda k: F.coalesce(F.get(F.try_element_at("tiles", div(k, 256) * 4 + div(k % 32, 8)), div(k, 32) % 8 * 8 + k % 8), F.lit(0.0))
    return held.select((F.col("m") + 1).alias("frame_idx"), F.lit(32).alias("n_rows"), F.lit(32).alias("n_cols"), F.transform(F.sequence(F.lit(0), F.lit(1023)), pixel).alias("pixels"))


@_query("SELECT frame_idx, gi::INT AS gi, gj::INT AS gj, row_start::INT AS row_start, col_start::INT AS col_start, (col_start + 5.5)::DOUBLE AS x, (row_start + 3.5)::DOUBLE AS y FROM (SELECT DISTINCT vec_id // 16 + 1 AS frame_idx FROM embeddings WHERE len(embedding) = 64) CROSS JOIN (SELECT unnest(generate_series(1, 25, 4)) AS row_start, unnest(generate_series(1, 7)) AS gi) CROSS JOIN (SELECT unnest(generate_series(1, 21, 5)) AS col_start, unnest(generate_series(1, 5)) AS gj)")
def window_grid(spark, sf_dir):
    """Windows of every mosaic."""
    return recordings.windows(mosaics(spark, sf_dir), (8, 12), (4, 7)).select("frame_idx", "gi", "gj", "row_start", "col_start", "x", "y")


# --- correlation of tiles ---

XCORR = f"""
WITH {TILES},
d AS (SELECT frame_idx, r - 1 AS r, c - 1 AS c, p - avg(p) OVER (PARTITION BY frame_idx) AS p FROM px),
l AS (SELECT unnest(generate_series(0, 7)) AS i), pairs AS (SELECT DISTINCT frame_idx AS a FROM d WHERE frame_idx % 2 = 1),
plane AS (SELECT a.frame_idx AS idx_a, (i.i + 4) % 8 AS pr, (j.i + 4) % 8 AS pc, abs(sum(a.p * b.p)) AS s FROM d a CROSS JOIN l i CROSS JOIN l j JOIN d b ON b.frame_idx = a.frame_idx + 1 AND b.r = (a.r + i.i) % 8 AND b.c = (a.c + j.i) % 8 WHERE a.frame_idx % 2 = 1 GROUP BY 1, 2, 3)
"""
TOPS = """
, tops AS (SELECT p.idx_a, p.pr, p.pc, p.s FROM plane p WHERE NOT EXISTS (SELECT 1 FROM plane q WHERE q.idx_a = p.idx_a AND abs(q.pr - p.pr) <= 1 AND abs(q.pc - p.pc) <= 1 AND (q.pr <> p.pr OR q.pc <> p.pc) AND (q.s > p.s OR (q.s = p.s AND (q.pc, q.pr) > (p.pc, p.pr)))))
, ranked AS (SELECT *, row_number() OVER (PARTITION BY idx_a ORDER BY s DESC, pc, pr) AS rank FROM tops)
"""


SUB = ", top AS (SELECT * FROM ranked WHERE rank = 1), off AS (SELECT t.idx_a, t.pr, t.pc, t.s, u.s AS up, d.s AS dn, l.s AS lf, r.s AS rt FROM top t LEFT JOIN plane u ON u.idx_a = t.idx_a AND u.pr = t.pr - 1 AND u.pc = t.pc LEFT JOIN plane d ON d.idx_a = t.idx_a AND d.pr = t.pr + 1 AND d.pc = t.pc LEFT JOIN plane l ON l.idx_a = t.idx_a AND l.pr = t.pr AND l.pc = t.pc - 1 LEFT JOIN plane r ON r.idx_a = t.idx_a AND r.pr = t.pr AND r.pc = t.pc + 1), sub AS (SELECT *, coalesce((ln(nullif(lf, 0)) - ln(nullif(rt, 0))) / (2 * (ln(nullif(lf, 0)) - 2 * ln(s) + ln(nullif(rt, 0)))), 0) AS dx, coalesce((ln(nullif(up, 0)) - ln(nullif(dn, 0))) / (2 * (ln(nullif(up, 0)) - 2 * ln(s) + ln(nullif(dn, 0)))), 0) AS dy FROM off)"
MOMENT = SUB + ", mom AS (SELECT sub.idx_a, sqrt(sum(greatest(p.s, 0) * ((p.pr - sub.pr - dy) ** 2 + (p.pc - sub.pc - dx) ** 2)) / sum(greatest(p.s, 0))) AS moment FROM sub JOIN plane p ON p.idx_a = sub.idx_a AND abs(p.pr - round_even(sub.pr + dy, 0)) <= 1 AND abs(p.pc - round_even(sub.pc + dx, 0)) <= 1 GROUP BY sub.idx_a)"
ALL = " SELECT sub.idx_a, round(sub.pc - {o} + dx, 4) + 0.0 AS du, round(sub.pr - {o} + dy, 4) + 0.0 AS dv, round(sub.s / r2.s, 4) + 0.0 AS peak_ratio, round(moment, 4) + 0.0 AS correlation_moment FROM sub JOIN mom USING (idx_a) LEFT JOIN ranked r2 ON r2.idx_a = sub.idx_a AND r2.rank = 2 AND r2.s > 0"
TILE = PIVParameters((8, 8), overlap=(0, 0), uod_enable=False)


def tile_peaks(spark: SparkSession, sf_dir: str, p: PIVParameters = TILE) -> DataFrame:
    """Peaks of paired tiles by the library's window correlation; a pair's first frame (idx_a) names it."""
    t = tiles(spark, sf_dir)
    pairs = recordings.image_pairs(t).select(F.col("idx_a").alias("pair_id"), "idx_a", "idx_b")
    return piv.correlation_peaks(pairs, t, p).withColumnRenamed("pair_id", "idx_a")


_LAGS = ("lag_v AS dv", "lag_u AS du")


def _first(peaks: DataFrame, *columns: str) -> DataFrame:
    return rounded(peaks.filter("rank = 1").select("idx_a", *columns), 4)


@_query(XCORR + TOPS + ", top AS (SELECT * FROM ranked WHERE rank = 1), off AS (SELECT t.idx_a, t.pr, t.pc, t.s, u.s AS up, d.s AS dn, l.s AS lf, r.s AS rt FROM top t LEFT JOIN plane u ON u.idx_a = t.idx_a AND u.pr = t.pr - 1 AND u.pc = t.pc LEFT JOIN plane d ON d.idx_a = t.idx_a AND d.pr = t.pr + 1 AND d.pc = t.pc LEFT JOIN plane l ON l.idx_a = t.idx_a AND l.pr = t.pr AND l.pc = t.pc - 1 LEFT JOIN plane r ON r.idx_a = t.idx_a AND r.pr = t.pr AND r.pc = t.pc + 1), sub AS (SELECT *, coalesce((ln(lf) - ln(rt)) / (2 * (ln(lf) - 2 * ln(s) + ln(rt))), 0) AS dx, coalesce((ln(up) - ln(dn)) / (2 * (ln(up) - 2 * ln(s) + ln(dn))), 0) AS dy FROM off) SELECT sub.idx_a, round(sub.pc - 4 + dx, 4) + 0.0 AS du, round(sub.pr - 4 + dy, 4) + 0.0 AS dv, round(sub.s / r2.s, 4) + 0.0 AS peak_ratio FROM sub LEFT JOIN ranked r2 ON r2.idx_a = sub.idx_a AND r2.rank = 2")
def tile_xcorr(spark, sf_dir):
    return _first(tile_peaks(spark, sf_dir), "du", "dv", "peak_ratio")


@_query(XCORR + TOPS + " SELECT idx_a, rank::INT AS rank, CAST(pr - 4 AS INT) AS dv, CAST(pc - 4 AS INT) AS du, round(s, 6) + 0.0 AS s FROM ranked WHERE rank <= 3")
def tile_peaks_topk(spark, sf_dir):
    return rounded(tile_peaks(spark, sf_dir, replace(TILE, subpixel_method="none", n_peaks=3)).selectExpr("idx_a", "rank", *_LAGS, "value AS s"))


@_query(XCORR + TOPS + MOMENT + " SELECT CAST((sub.idx_a + 1) // 2 AS BIGINT) AS pair_id, round(sub.pc - 4 + dx, 4) + 0.0 AS u, round(sub.pr - 4 + dy, 4) + 0.0 AS v, round(sub.s / r2.s, 4) + 0.0 AS peak_ratio, round(moment, 4) + 0.0 AS correlation_moment FROM sub JOIN mom USING (idx_a) LEFT JOIN ranked r2 ON r2.idx_a = sub.idx_a AND r2.rank = 2")
def tile_piv(spark, sf_dir):
    """The same correlation by the whole analysis of a pair: a row a pair."""
    t = tiles(spark, sf_dir)
    got = piv.run_piv_sequence(recordings.image_pairs(t).select(F.col("pair_id").cast("long"), "idx_a", "idx_b"), t, TILE)
    return rounded(got.select("pair_id", "u", "v", "peak_ratio", "correlation_moment"), 4)


@_query(XCORR + ", e1 AS (SELECT *, row_number() OVER (PARTITION BY idx_a ORDER BY s DESC, pc, pr) AS k FROM plane), t1 AS (SELECT * FROM e1 WHERE k = 1), e2 AS (SELECT p.*, row_number() OVER (PARTITION BY p.idx_a ORDER BY p.s DESC, p.pc, p.pr) AS k FROM plane p JOIN t1 ON t1.idx_a = p.idx_a AND greatest(abs(p.pr - t1.pr), abs(p.pc - t1.pc)) > 2 WHERE p.s > 0) SELECT idx_a, 1 AS rank, CAST(pr - 4 AS INT) AS dv, CAST(pc - 4 AS INT) AS du, round(s, 6) + 0.0 AS s FROM t1 UNION ALL SELECT idx_a, 2, CAST(pr - 4 AS INT), CAST(pc - 4 AS INT), round(s, 6) + 0.0 FROM e2 WHERE k = 1")
def tile_peaks_exclusion(spark, sf_dir):
    p = replace(TILE, subpixel_method="none", n_peaks=2, peak_finder="exclusion")
    return rounded(tile_peaks(spark, sf_dir, p).selectExpr("idx_a", "rank", *_LAGS, "value AS s"))


_G9 = ", b9 AS (SELECT sub.idx_a, any_value(sub.pr) AS pr, any_value(sub.pc) AS pc, any_value(dx) AS dx, any_value(dy) AS dy, any_value(sub.pr) BETWEEN 1 AND 6 AND any_value(sub.pc) BETWEEN 1 AND 6 AND min(p.s) > 0 AS inside, sum(ln(p.s) * (p.pc - sub.pc)) / 6 AS a1, sum(ln(p.s) * (p.pr - sub.pr)) / 6 AS a2, sum(ln(p.s) * (p.pc - sub.pc) ** 2) / 2 - sum(ln(p.s)) / 3 AS a3, sum(ln(p.s) * (p.pc - sub.pc) * (p.pr - sub.pr)) / 4 AS a4, sum(ln(p.s) * (p.pr - sub.pr) ** 2) / 2 - sum(ln(p.s)) / 3 AS a5 FROM sub JOIN plane p ON p.idx_a = sub.idx_a AND abs(p.pr - sub.pr) <= 1 AND abs(p.pc - sub.pc) <= 1 AND p.s > 0 GROUP BY sub.idx_a), f9 AS (SELECT *, 4 * a3 * a5 - a4 ** 2 AS det FROM b9), s9 AS (SELECT *, (a4 * a2 - 2 * a5 * a1) / nullif(det, 0) AS fx, (a4 * a1 - 2 * a3 * a2) / nullif(det, 0) AS fy FROM f9)"


@_query(XCORR + TOPS + SUB + _G9 + " SELECT idx_a, round(pc - 4 + CASE WHEN inside AND a3 < 0 AND det > 0 AND abs(fx) <= 1 AND abs(fy) <= 1 THEN fx ELSE dx END, 4) + 0.0 AS du, round(pr - 4 + CASE WHEN inside AND a3 < 0 AND det > 0 AND abs(fx) <= 1 AND abs(fy) <= 1 THEN fy ELSE dy END, 4) + 0.0 AS dv FROM s9")
def tile_gauss9(spark, sf_dir):
    return _first(tile_peaks(spark, sf_dir, replace(TILE, subpixel_method="gauss9")), "du", "dv")


_PADDED = f"""
WITH {TILES}, wt AS (SELECT k, exp(-((k - 3.5) ** 2) / 8) AS w FROM (SELECT unnest(generate_series(0, 7)) AS k)),
d AS (SELECT frame_idx, r - 1 AS r, c - 1 AS c, (p - avg(p) OVER (PARTITION BY frame_idx)) * x.w * y.w AS p FROM px JOIN wt x ON x.k = r - 1 JOIN wt y ON y.k = c - 1),
l AS (SELECT unnest(generate_series(-7, 7)) AS i), sh AS (SELECT l.i, sum(a.w * b.w) AS a FROM l JOIN wt a ON true JOIN wt b ON b.k = a.k + l.i GROUP BY l.i), top0 AS (SELECT max(a) ** 2 AS m FROM sh),
gain AS (SELECT x.i, y.i AS j, CASE WHEN x.a * y.a >= m / 2 THEN m / (x.a * y.a) ELSE 0 END AS g FROM sh x CROSS JOIN sh y CROSS JOIN top0),
held AS (SELECT a.frame_idx AS idx_a, i.i + 8 AS pr, j.i + 8 AS pc, abs(sum(a.p * b.p)) AS s FROM d a CROSS JOIN l i CROSS JOIN l j JOIN d b ON b.frame_idx = a.frame_idx + 1 AND b.r = a.r + i.i AND b.c = a.c + j.i WHERE a.frame_idx % 2 = 1 GROUP BY 1, 2, 3),
plane AS (SELECT q.idx_a, cast(x.k AS BIGINT) AS pr, cast(y.k AS BIGINT) AS pc, coalesce(s * g, 0) AS s FROM (SELECT DISTINCT idx_a FROM held) q CROSS JOIN (SELECT unnest(generate_series(0, 15)) AS k) x CROSS JOIN (SELECT unnest(generate_series(0, 15)) AS k) y LEFT JOIN held ON held.idx_a = q.idx_a AND held.pr = x.k AND held.pc = y.k LEFT JOIN gain ON gain.i = x.k - 8 AND gain.j = y.k - 8)
"""


@_query(_PADDED + TOPS + MOMENT + ALL.format(o=8))
def tile_padded_gauss(spark, sf_dir):
    """Windows weighted and padded, the plane corrected for the overlap."""
    return _first(tile_peaks(spark, sf_dir, replace(TILE, padding=True, apodization="gauss")), "du", "dv", "peak_ratio", "correlation_moment")


_AREA = f"""
WITH {TILES}, d AS (SELECT frame_idx, r - 1 AS r, c - 1 AS c, p - avg(p) OVER (PARTITION BY frame_idx) AS p FROM px),
w AS (SELECT frame_idx, r - 1 AS r, c - 1 AS c, p - avg(p) OVER (PARTITION BY frame_idx) AS p FROM px WHERE r BETWEEN 3 AND 6 AND c BETWEEN 3 AND 6), l AS (SELECT unnest(generate_series(-2, 2)) AS i),
held AS (SELECT a.frame_idx AS idx_a, i.i + 4 AS pr, j.i + 4 AS pc, abs(sum(a.p * b.p)) AS s FROM w a CROSS JOIN l i CROSS JOIN l j JOIN d b ON b.frame_idx = a.frame_idx + 1 AND b.r = a.r + i.i AND b.c = a.c + j.i WHERE a.frame_idx % 2 = 1 GROUP BY 1, 2, 3),
plane AS (SELECT q.idx_a, cast(x.k AS BIGINT) AS pr, cast(y.k AS BIGINT) AS pc, coalesce(s, 0) AS s FROM (SELECT DISTINCT idx_a FROM held) q CROSS JOIN (SELECT unnest(generate_series(0, 7)) AS k) x CROSS JOIN (SELECT unnest(generate_series(0, 7)) AS k) y LEFT JOIN held ON held.idx_a = q.idx_a AND held.pr = x.k AND held.pc = y.k)
"""


@_query(_AREA + TOPS + " SELECT idx_a, CAST(pr - 4 AS INT) AS dv, CAST(pc - 4 AS INT) AS du, round(s, 6) + 0.0 AS s FROM ranked WHERE rank = 1")
def tile_search_area(spark, sf_dir):
    """A window of 4 in a search area of 8: lags are restricted to the margin."""
    p = replace(TILE, window_size=(4, 4), search_area_size=(8, 8), subpixel_method="none")
    return rounded(tile_peaks(spark, sf_dir, p).filter("rank = 1").selectExpr("idx_a", *_LAGS, "value AS s"))


_PHASE = f"""
WITH {TILES}, d AS (SELECT frame_idx, r - 1 AS r, c - 1 AS c, p - avg(p) OVER (PARTITION BY frame_idx) AS p FROM px), l AS (SELECT unnest(generate_series(0, 7)) AS i),
ft AS (SELECT frame_idx, k.i AS k, l.i AS l, sum(p * cos(2 * pi() * (k.i * r + l.i * c) / 8)) AS re, -sum(p * sin(2 * pi() * (k.i * r + l.i * c) / 8)) AS im FROM d CROSS JOIN l k CROSS JOIN l GROUP BY 1, 2, 3),
sp AS (SELECT a.frame_idx AS idx_a, a.k, a.l, a.re * b.re + a.im * b.im AS re, a.re * b.im - a.im * b.re AS im, exp(-((CASE WHEN a.k < 4 THEN a.k ELSE a.k - 8 END) ** 2 + (CASE WHEN a.l < 4 THEN a.l ELSE a.l - 8 END) ** 2) / 2.0) AS g FROM ft a JOIN ft b ON b.frame_idx = a.frame_idx + 1 AND b.k = a.k AND b.l = a.l WHERE a.frame_idx % 2 = 1),
ph AS (SELECT idx_a, k, l, g * re / (sqrt(re * re + im * im) + 2.220446049250313e-16) AS re, g * im / (sqrt(re * re + im * im) + 2.220446049250313e-16) AS im FROM sp),
plane AS (SELECT idx_a, (x.i + 4) % 8 AS pr, (y.i + 4) % 8 AS pc, abs(sum(re * cos(2 * pi() * (k * x.i + ph.l * y.i) / 8) - im * sin(2 * pi() * (k * x.i + ph.l * y.i) / 8))) / 64 AS s FROM ph CROSS JOIN l x CROSS JOIN l y GROUP BY 1, 2, 3)
"""


@_query(_PHASE + TOPS + MOMENT + ALL.format(o=4))
def tile_phase(spark, sf_dir):
    """Phase correlation."""
    return _first(tile_peaks(spark, sf_dir, replace(TILE, correlation_method="phase")), "du", "dv", "peak_ratio", "correlation_moment")


@_query(XCORR.replace("plane AS", "each AS") + ", plane AS (SELECT 0 AS idx_a, pr, pc, sum(s) AS s FROM each GROUP BY pr, pc)" + TOPS + MOMENT + ALL.format(o=4))
def tile_ensemble(spark, sf_dir):
    """One plane of all pairs."""
    t = tiles(spark, sf_dir)
    pairs = recordings.with_pixels(recordings.image_pairs(t), t)
    return _first(piv.ensemble_peaks(pairs, TILE).withColumn("idx_a", F.col("pair_id").cast("int")), "du", "dv", "peak_ratio", "correlation_moment")


# Windows of 4 x 4 pixels, half overlapping; a window's number goes with its pair's.
_WINDOWS = f"""
WITH {TILES}, g AS (SELECT unnest(generate_series(0, 2)) AS k), l AS (SELECT unnest(generate_series(0, 3)) AS i),
dark AS (SELECT a.frame_idx, a.r, a.c, a.p > 0.15 OR b.p > 0.15 AS m FROM px a JOIN px b ON a.r = b.r AND a.c = b.c AND b.frame_idx = a.frame_idx + 1 WHERE a.frame_idx % 2 = 1),
w AS (SELECT px.frame_idx, x.k AS wi, y.k AS wj, px.r - 1 - 2 * x.k AS r, px.c - 1 - 2 * y.k AS c, p, {{masked}} AS m FROM px JOIN g x ON px.r - 1 - 2 * x.k BETWEEN 0 AND 3 JOIN g y ON px.c - 1 - 2 * y.k BETWEEN 0 AND 3 LEFT JOIN dark ON dark.frame_idx = px.frame_idx - 1 + px.frame_idx % 2 AND dark.r = px.r AND dark.c = px.c),
d AS (SELECT frame_idx, wi, wj, r, c, CASE WHEN m THEN 0 ELSE p - avg(p) FILTER (NOT m) OVER v END AS p, count(*) FILTER (m) OVER v AS dark FROM w WINDOW v AS (PARTITION BY frame_idx, wi, wj)),
plane AS (SELECT a.frame_idx * 9 + a.wi * 3 + a.wj AS idx_a, (i.i + 2) % 4 AS pr, (j.i + 2) % 4 AS pc, abs(sum(a.p * b.p)) AS s FROM d a CROSS JOIN l i CROSS JOIN l j JOIN d b ON b.frame_idx = a.frame_idx + 1 AND b.wi = a.wi AND b.wj = a.wj AND b.r = (a.r + i.i) % 4 AND b.c = (a.c + j.i) % 4 WHERE a.frame_idx % 2 = 1 AND a.dark < 8 GROUP BY 1, 2, 3)
"""
_OF_WINDOW = "idx_a // 9 AS idx_a, CAST(idx_a % 9 // 3 + 1 AS INT) AS gi, CAST(idx_a % 3 + 1 AS INT) AS gj"
_SMALL = replace(TILE, window_size=(4, 4), search_area_size=(4, 4), overlap=(2, 2), subpixel_method="none")


def window_peaks(spark: SparkSession, sf_dir: str, p: PIVParameters, masked: bool = False) -> DataFrame:
    t = tiles(spark, sf_dir)
    pairs = recordings.with_pixels(recordings.image_pairs(t).select(F.col("idx_a").alias("pair_id"), "idx_a", "idx_b"), t)
    if masked:
        pairs = pairs.withColumn("mask", F.zip_with("pixels_a", "pixels_b", lambda a, b: (a > 0.15) | (b > 0.15)))
    return piv.correlation_peaks(pairs, p=p).withColumnRenamed("pair_id", "idx_a")


@_query(_WINDOWS.format(masked="false") + TOPS + f" SELECT {_OF_WINDOW}, rank::INT AS rank, CAST(pr - 2 AS INT) AS dv, CAST(pc - 2 AS INT) AS du, round(s, 6) + 0.0 AS s FROM ranked WHERE rank <= 2")
def tile_windows(spark, sf_dir):
    """The two best peaks of nine overlapping windows a tile."""
    got = window_peaks(spark, sf_dir, replace(_SMALL, n_peaks=2)).filter("value > 0")
    return rounded(got.selectExpr("idx_a", "gi", "gj", "rank", *_LAGS, "value AS s"))


@_query(_WINDOWS.format(masked="coalesce(dark.m, false)") + TOPS + f" SELECT {_OF_WINDOW}, CAST(pr - 2 AS INT) AS dv, CAST(pc - 2 AS INT) AS du, round(s, 6) + 0.0 AS s FROM ranked WHERE rank = 1 AND s > 1e-9")
def tile_windows_masked(spark, sf_dir):
    """Bright pixels of either image are masked: left out of the mean, zero in the plane; windows with half of them so have no vector."""
    got = window_peaks(spark, sf_dir, _SMALL, True).filter("rank = 1 AND value > 1e-9")
    return rounded(got.selectExpr("idx_a", "gi", "gj", *_LAGS, "value AS s"))


@_query(_WINDOWS.format(masked="false") + TOPS + MOMENT + f" SELECT {_OF_WINDOW.replace('idx_a', 'sub.idx_a').replace('AS sub.idx_a', 'AS idx_a')}, round(moment, 4) + 0.0 AS correlation_moment, round(sub.s / r2.s, 4) + 0.0 AS peak_ratio FROM sub JOIN mom USING (idx_a) LEFT JOIN ranked r2 ON r2.idx_a = sub.idx_a AND r2.rank = 2 AND r2.s > 0")
def tile_window_quality(spark, sf_dir):
    """Peak ratio and moment of overlapping windows."""
    return _first_of(window_peaks(spark, sf_dir, replace(_SMALL, subpixel_method="gauss3")), "correlation_moment", "peak_ratio")


def _first_of(peaks: DataFrame, *columns: str) -> DataFrame:
    return rounded(peaks.filter("rank = 1").select("idx_a", "gi", "gj", *columns), 4)


def _unlike(a: np.ndarray, b: np.ndarray, plan) -> np.ndarray:
    """A correlator of one's own: how little windows differ at each lag, round the edges."""
    k, n, m = a.shape
    out = np.empty((k, n, m))
    for i in range(n):
        for j in range(m):
            moved = np.roll(b, (-i, -j), axis=(1, 2))
            out[:, (i + n // 2) % n, (j + m // 2) % m] = 1 / (1 + ((a - moved) ** 2).sum(axis=(1, 2)))
    return out


@_query(XCORR.replace("abs(sum(a.p * b.p))", "1 / (1 + sum((a.p - b.p) ** 2))") + TOPS + SUB + " SELECT sub.idx_a, round(sub.pc - 4 + dx, 4) + 0.0 AS du, round(sub.pr - 4 + dy, 4) + 0.0 AS dv, round(sub.s / r2.s, 4) + 0.0 AS peak_ratio FROM sub LEFT JOIN ranked r2 ON r2.idx_a = sub.idx_a AND r2.rank = 2 AND r2.s > 0")
def tile_own_correlator(spark, sf_dir):
    """Windows matched by least squares: a registered correlator, which goes along with the plan."""
    correlation.register_correlator("least_squares", _unlike)
    return _first(tile_peaks(spark, sf_dir, replace(TILE, correlation_method="least_squares")), "du", "dv", "peak_ratio")


_SPOTS = f"""
WITH {TILES}, g AS (SELECT *, median(p) OVER f AS ground FROM px WINDOW f AS (PARTITION BY frame_idx)), h AS (SELECT *, 1.4826 * median(abs(p - ground)) OVER (PARTITION BY frame_idx) AS spread FROM g),
j AS (SELECT frame_idx, r, c, p, p - ground AS j, ground + spread AS least FROM h),
m AS (SELECT a.* FROM j a WHERE a.r BETWEEN 2 AND 7 AND a.c BETWEEN 2 AND 7 AND a.p > a.least AND NOT EXISTS (SELECT 1 FROM j b WHERE b.frame_idx = a.frame_idx AND abs(b.r - a.r) <= 1 AND abs(b.c - a.c) <= 1 AND (b.r <> a.r OR b.c <> a.c) AND (b.p > a.p OR (b.p = a.p AND (b.c, b.r) > (a.c, a.r))))),
n AS (SELECT m.frame_idx, m.r, m.c, any_value(m.j) AS j, max(CASE WHEN b.r = m.r AND b.c = m.c - 1 THEN b.j END) AS lf, max(CASE WHEN b.r = m.r AND b.c = m.c + 1 THEN b.j END) AS rt, max(CASE WHEN b.c = m.c AND b.r = m.r - 1 THEN b.j END) AS up, max(CASE WHEN b.c = m.c AND b.r = m.r + 1 THEN b.j END) AS dn, sum(greatest(b.j, 0)) AS total, sum(greatest(b.j, 0) * (b.c - m.c)) AS mx, sum(greatest(b.j, 0) * (b.r - m.r)) AS my FROM m JOIN j b ON b.frame_idx = m.frame_idx AND abs(b.r - m.r) <= 1 AND abs(b.c - m.c) <= 1 GROUP BY m.frame_idx, m.r, m.c),
q AS (SELECT *, CASE WHEN lf > 0 AND j > 0 AND rt > 0 THEN ln(lf) + ln(rt) - 2 * ln(j) END AS kx, CASE WHEN up > 0 AND j > 0 AND dn > 0 THEN ln(up) + ln(dn) - 2 * ln(j) END AS ky FROM n),
o AS (SELECT *, CASE WHEN kx < 0 AND abs((ln(lf) - ln(rt)) / (2 * kx)) < 1 THEN (ln(lf) - ln(rt)) / (2 * kx) END AS ox, CASE WHEN ky < 0 AND abs((ln(up) - ln(dn)) / (2 * ky)) < 1 THEN (ln(up) - ln(dn)) / (2 * ky) END AS oy FROM q),
z AS (SELECT *, CASE WHEN ox IS NOT NULL THEN sqrt(-1 / kx) END AS zx, CASE WHEN oy IS NOT NULL THEN sqrt(-1 / ky) END AS zy FROM o),
found AS (SELECT frame_idx, r, c, c + coalesce(ox, CASE WHEN total > 0 THEN mx / total ELSE 0 END) AS x, r + coalesce(oy, CASE WHEN total > 0 THEN my / total ELSE 0 END) AS y, j AS intensity, CASE WHEN zx IS NOT NULL OR zy IS NOT NULL THEN 4 * (coalesce(zx, 0) + coalesce(zy, 0)) / ((zx IS NOT NULL)::INT + (zy IS NOT NULL)::INT) END AS diameter FROM z)
"""


@_query(_SPOTS + "SELECT frame_idx, row_number() OVER (PARTITION BY frame_idx ORDER BY intensity DESC, c, r)::INT AS particle_id, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y, round(intensity, 5) + 0.0 AS intensity, round(diameter, 5) + 0.0 AS diameter FROM found WHERE diameter IS NULL OR diameter BETWEEN 1 AND 12")
def tile_particles(spark, sf_dir):
    """Detected particles of every tile."""
    p = PTVParameters(threshold_k=1.0, min_separation=0.01)
    return rounded(ptv.detect_particles(tiles(spark, sf_dir), p).select("frame_idx", "particle_id", "x", "y", "intensity", "diameter"), 5)


_MATCHED = ", spots AS (SELECT frame_idx, x, y, row_number() OVER (PARTITION BY frame_idx ORDER BY intensity DESC, c, r)::INT AS id FROM found WHERE diameter IS NULL OR diameter BETWEEN 1 AND 12), near AS (SELECT (a.frame_idx + 1) // 2 AS pair_id, a.id AS index_a, b.id AS index_b, a.x, a.y, b.x - a.x AS u, b.y - a.y AS v, (b.x - a.x - ((a.frame_idx + 1) // 2 % 3 - 1) * 0.5 - 0.3 * (a.x - 1) / 7) ** 2 + (b.y - a.y - (a.frame_idx + 1) // 2 % 2 * 0.2 * (a.y - 1) / 7) ** 2 AS d2 FROM spots a JOIN spots b ON b.frame_idx = a.frame_idx + 1 WHERE a.frame_idx % 2 = 1), best AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY d2, index_a, index_b) AS k FROM near WHERE d2 <= 9)"


@_query(_SPOTS + _MATCHED + " SELECT pair_id, index_a, index_b, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(u, 4) + 0.0 AS u, round(v, 4) + 0.0 AS v, round(sqrt(d2), 4) + 0.0 AS match_residual FROM best WHERE k = 1")
def tile_matches(spark, sf_dir):
    """The best match of the particles of every pair of tiles, by a field of predictions that comes as a table."""
    t = tiles(spark, sf_dir)
    pairs = recordings.image_pairs(t).select(F.col("pair_id").cast("long"), "idx_a", "idx_b")
    nodes = pairs.select("pair_id", F.explode(F.array(*[F.struct(F.lit(i).alias("gi"), F.lit(j).alias("gj")) for i in (1, 2) for j in (1, 2)])).alias("n")).select("pair_id", "n.gi", "n.gj")
    at = lambda c: (F.col(c) - 1) * 7.0 + 1
    fields_ = nodes.select("*", at("gj").alias("x"), at("gi").alias("y"), ((F.col("pair_id") % 3 - 1) * 0.5 + 0.3 * (F.col("gj") - 1)).alias("u"), (F.col("pair_id") % 2 * 0.2 * (F.col("gi") - 1)).alias("v"))
    p = PTVParameters(threshold_k=1.0, min_separation=0.01, search_radius=3.0, uod_enable=False)
    got = ptv.run_ptv_sequence(pairs, t, p, fields_, smoothing=False)
    first = F.min_by(F.struct(*[c for c in got.columns if c not in ("pair_id", "outlier")]), F.struct("match_residual", "index_a", "index_b")).alias("m")
    return rounded(got.groupBy("pair_id").agg(first).select("pair_id", "m.*"), 4)


_BLUR = f"""
WITH {TILES}, k AS (SELECT o, exp(-(o * o) / 2.0) / sum(exp(-(o * o) / 2.0)) OVER () AS w FROM (SELECT unnest(generate_series(-3, 3)) AS o)),
rep AS (SELECT a.frame_idx, a.r, a.c, a.p, sum(b.p * x.w * y.w) AS mean, sum(b.p * b.p * x.w * y.w) AS sq FROM px a CROSS JOIN k x CROSS JOIN k y JOIN px b ON b.frame_idx = a.frame_idx AND b.r = least(greatest(a.r + x.o, 1), 8) AND b.c = least(greatest(a.c + y.o, 1), 8) GROUP BY ALL)
SELECT frame_idx, CAST((r - 1) * 8 + c AS INT) AS k, """


def _steps(name: str, steps: list, sql: str) -> None:
    def run(spark, sf_dir):
        done = prepared.preprocess(tiles(spark, sf_dir), steps)
        return rounded(done.select("frame_idx", F.posexplode("pixels").alias("k", "p")).select("frame_idx", (F.col("k") + 1).cast("int").alias("k"), "p"))

    run.__name__ = name
    _query(_BLUR + f"round({sql}, 6) + 0.0 AS p FROM rep")(run)


_steps("gaussian_blur", [("gaussian_blur", {"sigma": 1.0})], "mean")
_steps("highpass", [("invert_image", {"enabled": False}), ("highpass_filter", {"sigma": 1.0})], "greatest(p - mean, 0)")
_steps("local_variance_normalize", [("local_variance_normalize", {"sigma": 1.0})], "(p - mean) / sqrt(greatest(sq - mean * mean, 0) + 1e-6)")


# --- statistics of fields ---


@_query(f"WITH {GF} SELECT gi, gj, count(*) FILTER (good) AS count, {_R('avg(u) FILTER (good)', 'mean_u')}, {_R('stddev_pop(u) FILTER (good)', 'rms_u')}, {_R('covar_pop(u, v) FILTER (good)', 'uv')}, {_R('avg(v) FILTER (good)', 'mean_v')}, {_R('stddev_pop(v) FILTER (good)', 'rms_v')} FROM ok GROUP BY gi, gj")
def field_statistics(spark, sf_dir):
    return rounded(fields.field_statistics(gf(spark, sf_dir)))


@_query(f"WITH {GF}, w AS (SELECT *, u - v AS w FROM ok) SELECT gi, gj, count(*) FILTER (good) AS count, " + ", ".join(_R(f"{f}({a}) FILTER (good)", f"{n}_{a}") for a in "uvw" for n, f in (("mean", "avg"), ("rms", "stddev_pop"))) + ", " + ", ".join(_R(f"covar_pop({a}, {b}) FILTER (good)", f"{a}{b}") for a, b in ("uu", "uv", "uw", "vv", "vw", "ww")) + " FROM w GROUP BY gi, gj")
def stereo_statistics(spark, sf_dir):
    return rounded(fields.field_statistics(gf(spark, sf_dir).withColumn("w", F.col("u") - F.col("v"))))


@_query(f"WITH {GF}, m AS (SELECT *, median(CASE WHEN good THEN u END) OVER n AS mu, median(CASE WHEN good THEN v END) OVER n AS mv, count(*) FILTER (good) OVER n AS c FROM ok WINDOW n AS (PARTITION BY gi, gj)), d AS (SELECT *, median(CASE WHEN good THEN abs(u - mu) END) OVER n AS du, median(CASE WHEN good THEN abs(v - mv) END) OVER n AS dv FROM m WINDOW n AS (PARTITION BY gi, gj)) SELECT frame, gi, gj, outlier OR (good AND c >= 3 AND (abs(u - mu) / (du + 0.1) > 3 OR abs(v - mv) / (dv + 0.1) > 3)) AS outlier FROM d")
def temporal_median_test(spark, sf_dir):
    return fields.validate_temporal(gf(spark, sf_dir)).select("frame", "gi", "gj", "outlier")


@_query(f"WITH {GF}, n AS (SELECT a.frame, a.gi, a.gj, a.u, a.v, b.u AS nu, b.v AS nv FROM gf a JOIN gf b ON a.frame = b.frame AND abs(a.gi - b.gi) <= 2 AND abs(a.gj - b.gj) <= 2 AND (a.gi <> b.gi OR a.gj <> b.gj) WHERE NOT a.masked AND NOT b.masked), m AS (SELECT *, median(nu) OVER w AS mu, median(nv) OVER w AS mv FROM n WINDOW w AS (PARTITION BY frame, gi, gj)), f AS (SELECT frame, gi, gj, abs(any_value(u) - any_value(mu)) / (median(abs(nu - mu)) + 0.1) > 2 OR abs(any_value(v) - any_value(mv)) / (median(abs(nv - mv)) + 0.1) > 2 AS flag FROM m GROUP BY frame, gi, gj) SELECT gf.frame, gf.gi, gf.gj, coalesce(flag, false) AS flag FROM gf LEFT JOIN f ON gf.frame = f.frame AND gf.gi = f.gi AND gf.gj = f.gj")
def uod_5x5(spark, sf_dir):
    return fields.outliers(gf(spark, sf_dir)).select("frame", "gi", "gj", "flag")


@_query(f"WITH {GF}, r AS (SELECT a.frame, a.gi, a.gj, b.u, b.v, greatest(abs(a.gi - b.gi), abs(a.gj - b.gj)) AS r FROM gf a JOIN ok b ON a.frame = b.frame AND b.good WHERE a.outlier AND NOT a.masked), k AS (SELECT *, row_number() OVER (PARTITION BY frame, gi, gj ORDER BY r) AS n FROM r), t AS (SELECT frame, gi, gj, min(r) AS reach FROM k WHERE n = 3 GROUP BY ALL), m AS (SELECT r.frame, r.gi, r.gj, median(u) AS mu, median(v) AS mv FROM r JOIN t USING (frame, gi, gj) WHERE r <= reach GROUP BY ALL) SELECT gf.frame, gf.gi, gf.gj, {_R('coalesce(mu, u)', 'u')}, {_R('coalesce(mv, v)', 'v')} FROM gf LEFT JOIN m ON gf.frame = m.frame AND gf.gi = m.gi AND gf.gj = m.gj")
def replaced(spark, sf_dir):
    return rounded(fields.replace_outliers(gf(spark, sf_dir)).select("frame", "gi", "gj", "u", "v"))


# Every 1200 orders are a grid of 40 x 30 nodes, with a hole of 25 x 25 outliers.
_HOLE = "k AS (SELECT o_orderkey // 1200 AS frame, o_orderkey % 1200 AS k, o_totalprice / 1e4 AS u, o_custkey / 1e2::DOUBLE AS v FROM orders), f AS (SELECT frame, CAST(k // 30 + 1 AS INT) AS gi, CAST(k % 30 + 1 AS INT) AS gj, u, v, k // 30 + 1 BETWEEN 6 AND 30 AND k % 30 + 1 BETWEEN 3 AND 27 AS outlier FROM k)"


@_query(f"WITH {_HOLE}, r AS (SELECT a.frame, a.gi, a.gj, b.u, b.v, greatest(abs(a.gi - b.gi), abs(a.gj - b.gj)) AS r FROM f a JOIN f b ON a.frame = b.frame AND a.outlier AND NOT b.outlier), t AS (SELECT frame, gi, gj, list_sort(list(r))[3] AS reach FROM r GROUP BY ALL), m AS (SELECT r.frame, r.gi, r.gj, median(u) AS mu, median(v) AS mv FROM r JOIN t USING (frame, gi, gj) WHERE r <= reach GROUP BY ALL) SELECT f.frame, f.gi, f.gj, round(coalesce(mu, u), 6) + 0.0 AS u, round(coalesce(mv, v), 6) + 0.0 AS v FROM f LEFT JOIN m ON f.frame = m.frame AND f.gi = m.gi AND f.gj = m.gj")
def replaced_wide_hole(spark, sf_dir):
    """Replacement however large the hole, in every frame."""
    k = F.col("o_orderkey") % 1200
    gi, gj = (F.floor(k / 30) + 1).cast("int"), (k % 30 + 1).cast("int")
    f = _table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 1200).alias("frame"), gi.alias("gi"), gj.alias("gj"), (F.col("o_totalprice") / 1e4).alias("u"), (F.col("o_custkey") / 1e2).alias("v"), F.lit(False).alias("masked"), (gi.between(6, 30) & gj.between(3, 27)).alias("outlier"))
    return rounded(fields.replace_outliers(f).select("frame", "gi", "gj", "u", "v"))


@_query(f"WITH {GF}, z AS (SELECT frame, gi, gj, coalesce(u, 0) AS u FROM gf), a AS (SELECT *, (coalesce(lag(u) OVER w, u) + 2 * u + coalesce(lead(u) OVER w, u)) / 4 AS s FROM z WINDOW w AS (PARTITION BY frame, gj ORDER BY gi)) SELECT frame, gi, gj, round((coalesce(lag(s) OVER w, s) + 2 * s + coalesce(lead(s) OVER w, s)) / 4, 6) + 0.0 AS u FROM a WINDOW w AS (PARTITION BY frame, gi ORDER BY gj)")
def smooth_binomial(spark, sf_dir):
    z = gf(spark, sf_dir).select("frame", "gi", "gj", F.nanvl("u", F.lit(0.0)).alias("u"))
    return rounded(fields.smooth(z, ("u",)))


def _slope(n: str, axis: str, along: str, over: str) -> str:
    w = f"OVER (PARTITION BY frame, {over} ORDER BY {along})"
    b, a = f"coalesce(lag(good) {w}, false)", f"coalesce(lead(good) {w}, false)"
    return f"CASE WHEN good THEN CASE WHEN {b} AND {a} THEN (lead({n}) {w} - lag({n}) {w}) / 32.0 WHEN {a} THEN (lead({n}) {w} - {n}) / 16.0 WHEN {b} THEN ({n} - lag({n}) {w}) / 16.0 END END AS d{n}d{axis}"


SLOPES = f"{GF}, s AS (SELECT *, " + ", ".join(_slope(n, *a) for n in "uv" for a in (("x", "gj", "gi"), ("y", "gi", "gj"))) + " FROM ok)"


@_query(f"WITH {SLOPES} SELECT frame, gi, gj, " + ", ".join(_R(f"d{n}d{a}") for n in "uv" for a in "xy") + " FROM s")
def flow_derivatives(spark, sf_dir):
    return rounded(fields.flow_derivatives(gf(spark, sf_dir)).select("frame", "gi", "gj", "dudx", "dudy", "dvdx", "dvdy"))


@_query(f"WITH {SLOPES} SELECT frame, gi, gj, {_R('dvdx - dudy', 'vorticity')}, {_R('dudx + dvdy', 'divergence')}, {_R('dudx', 'strain_xx')}, {_R('dvdy', 'strain_yy')}, {_R('(dudy + dvdx) / 2', 'strain_xy')}, {_R('sqrt(2 * (dudx * dudx + dvdy * dvdy + 2 * ((dudy + dvdx) / 2) * ((dudy + dvdx) / 2)))', 'strain_magnitude')}, {_R('CASE WHEN dudx + dudy + dvdx + dvdy IS NOT NULL THEN sqrt(greatest(dudx * dvdy - dudy * dvdx - ((dudx + dvdy) / 2) * ((dudx + dvdy) / 2), 0)) END', 'swirling_strength')}, {_R('-(dudx * dudx + 2 * dudy * dvdx + dvdy * dvdy) / 2', 'q_criterion')} FROM s")
def derived_quantities(spark, sf_dir):
    d = fields.derived(fields.flow_derivatives(gf(spark, sf_dir)))
    return rounded(d.select("frame", "gi", "gj", "vorticity", "divergence", "strain_xx", "strain_yy", "strain_xy", "strain_magnitude", "swirling_strength", "q_criterion"))


@_query(f"WITH {SLOPES} SELECT frame, {_R('sum((dvdx - dudy) * 256)', 'circulation')} FROM s GROUP BY frame")
def circulation_area(spark, sf_dir):
    return rounded(fields.circulation_area(gf(spark, sf_dir)))


@_query(f"WITH {GF} SELECT frame, gi, gj, {_R('u')}, {_R('v')} FROM ok WHERE good AND x BETWEEN 32 AND 96 AND y BETWEEN 16 AND 80")
def region_rectangle(spark, sf_dir):
    return rounded(fields.extract_region(gf(spark, sf_dir), (32, 96, 16, 80)).select("frame", "gi", "gj", "u", "v"))


@_query(f"WITH {GF} SELECT frame, gi, gj, {_R('u')} FROM ok WHERE good AND y > 20 AND y < 120 AND x >= 10 + (y - 20) * 0.5 AND x < 110 - (y - 20) * 0.5")
def region_polygon(spark, sf_dir):
    return rounded(fields.extract_region(gf(spark, sf_dir), [(10, 20), (110, 20), (60, 120)]).select("frame", "gi", "gj", "u"))


@_query(f"WITH {GF}, c AS (SELECT frame, max(CASE WHEN good AND gi = 2 AND gj = 2 THEN u END) AS a, max(CASE WHEN good AND gi = 2 AND gj = 3 THEN u END) AS b, max(CASE WHEN good AND gi = 3 AND gj = 2 THEN u END) AS c, max(CASE WHEN good AND gi = 3 AND gj = 3 THEN u END) AS d FROM ok GROUP BY frame), k AS (SELECT unnest(generate_series(1, 5)) AS sample) SELECT frame, sample::INT AS sample, round((32 + (sample - 1) * 3.0)::DOUBLE, 6) + 0.0 AS x, round((1 - 0.25) * ((1 - q) * a + q * b) + 0.25 * ((1 - q) * c + q * d), 6) + 0.0 AS u FROM (SELECT *, (sample - 1) * 3.0 / 16 AS q FROM c CROSS JOIN k)")
def profile(spark, sf_dir):
    return rounded(fields.extract_profile(gf(spark, sf_dir), [(32.0, 36.0), (44.0, 36.0)], 5).select("frame", "sample", "x", "u"))


_CONTOUR = "(VALUES (0, 20.0, 20.0, 100.0, 20.0), (1, 100.0, 20.0, 100.0, 100.0), (2, 100.0, 100.0, 20.0, 100.0), (3, 20.0, 100.0, 20.0, 20.0)) v(e, xa, ya, xb, yb)"


@_query(f"WITH {GF}, s AS (SELECT e, k, (xa + (xb - xa) * k / 19)::DOUBLE AS x, (ya + (yb - ya) * k / 19)::DOUBLE AS y, (xb - xa)::DOUBLE * CASE WHEN k IN (0, 19) THEN 0.5 ELSE 1 END / 19 AS dx, (yb - ya)::DOUBLE * CASE WHEN k IN (0, 19) THEN 0.5 ELSE 1 END / 19 AS dy FROM {_CONTOUR} CROSS JOIN (SELECT unnest(generate_series(0, 19)) AS k)), c AS (SELECT *, least(floor((x - 16) / 16), 6)::INT AS j, least(floor((y - 16) / 16), 6)::INT AS i FROM s), n AS (SELECT c.e, c.k, c.dx, c.dy, gf.frame, count(gf.u) AS have, sum(gf.u * (CASE WHEN gf.gj = j + 1 THEN 1 - ((c.x - 16) / 16 - j) ELSE (c.x - 16) / 16 - j END) * (CASE WHEN gf.gi = i + 1 THEN 1 - ((c.y - 16) / 16 - i) ELSE (c.y - 16) / 16 - i END)) AS u, sum(gf.v * (CASE WHEN gf.gj = j + 1 THEN 1 - ((c.x - 16) / 16 - j) ELSE (c.x - 16) / 16 - j END) * (CASE WHEN gf.gi = i + 1 THEN 1 - ((c.y - 16) / 16 - i) ELSE (c.y - 16) / 16 - i END)) AS v FROM c JOIN gf ON gf.gj BETWEEN j + 1 AND j + 2 AND gf.gi BETWEEN i + 1 AND i + 2 GROUP BY ALL) SELECT frame, round(CASE WHEN min(have) = 4 THEN sum(u * dx + v * dy) END, 6) + 0.0 AS circulation FROM n GROUP BY frame")
def circulation_contour(spark, sf_dir):
    return rounded(fields.circulation_contour(gf(spark, sf_dir), [(20.0, 20.0), (100.0, 20.0), (100.0, 100.0), (20.0, 100.0)], include_invalid=True))


@_query(f"WITH {GF}, er AS (SELECT u - (0.5 + x / 100) AS eu, v - 2 * y / 100 AS ev FROM ok WHERE good) SELECT count(*) AS n, {_R('avg(eu)', 'bias_u')}, {_R('sqrt(avg(eu * eu))', 'rms_u')}, {_R('avg(ev)', 'bias_v')}, {_R('sqrt(avg(ev * ev))', 'rms_v')} FROM er")
def error_statistics(spark, sf_dir):
    return rounded(fields.error_statistics(gf(spark, sf_dir), 0.5 + F.col("x") / 100, 2 * F.col("y") / 100))


@_query("WITH f AS (SELECT CASE WHEN l_extendedprice / 7 - round_even(l_extendedprice / 7, 0) = 0.5 THEN -0.5 ELSE l_extendedprice / 7 - round_even(l_extendedprice / 7, 0) END AS f FROM lineitem), b AS (SELECT least(greatest(floor((f + 0.5) * 21) + 1, 1), 21)::INT AS bin, count(*) AS n, count(*) FILTER (abs(f) <= 0.1) AS c, count(*) FILTER (abs(f) >= 0.4) AS e FROM f GROUP BY 1), g AS (SELECT unnest(generate_series(1, 21)) AS bin) SELECT g.bin::INT AS bin, round(-0.5 + (g.bin - 0.5) / 21, 6) + 0.0 AS centre, coalesce(n, 0) AS n, round((sum(c) OVER () - sum(e) OVER ()) / (sum(c) OVER () + sum(e) OVER ()), 6) + 0.0 AS locking_index FROM g LEFT JOIN b ON g.bin = b.bin")
def peak_locking(spark, sf_dir):
    return rounded(fields.peak_locking(_table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 7).alias("d")), "d"))


@_query(f"WITH {GF}, s AS (SELECT gi, gj, frame, u, row_number() OVER n - 1 AS t, count(*) OVER p AS n, coalesce(u, avg(u) OVER p) AS x FROM gf WINDOW n AS (PARTITION BY gi, gj ORDER BY frame), p AS (PARTITION BY gi, gj)), m AS (SELECT *, x - avg(x) OVER (PARTITION BY gi, gj) AS z, 0.5 * (1 - cos(2 * pi() * t / (n - 1))) AS w FROM s), k AS (SELECT gi, gj, n, k, sum(z * w * cos(2 * pi() * k * t / n)) AS a, sum(z * w * sin(2 * pi() * k * t / n)) AS b, sum(w * w) AS ww FROM m, LATERAL (SELECT unnest(generate_series(0, n // 2)) AS k) GROUP BY ALL) SELECT gi, gj, k::INT AS k, round(k / n::DOUBLE, 6) + 0.0 AS frequency, round((a * a + b * b) * 2 / ww * CASE WHEN k = 0 OR k * 2 = n THEN 0.5 ELSE 1 END, 6) + 0.0 AS psd FROM k")
def power_spectrum(spark, sf_dir):
    """Of every node."""
    return rounded(fields.result_spectrum(gf(spark, sf_dir).withColumn("outlier", F.lit(False)), "u"))


@_query(f"WITH {GF}, s AS (SELECT gi, gj, frame, u, row_number() OVER (PARTITION BY gi, gj ORDER BY frame) AS k FROM gf), f AS (SELECT *, last_value(u IGNORE NULLS) OVER b AS lo, last_value(CASE WHEN u IS NOT NULL THEN k END IGNORE NULLS) OVER b AS la, first_value(u IGNORE NULLS) OVER a AS hi, first_value(CASE WHEN u IS NOT NULL THEN k END IGNORE NULLS) OVER a AS ha FROM s WINDOW b AS (PARTITION BY gi, gj ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY gi, gj ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT gi, gj, frame, round(coalesce(u, lo + (hi - lo) * (k - la) / (ha - la), lo, hi), 6) + 0.0 AS u FROM f")
def gap_filling(spark, sf_dir):
    return rounded(fields.filled_series(gf(spark, sf_dir), ("gi", "gj"), "frame", "u", "linear").select("gi", "gj", "frame", "u"))


@_query(f"WITH {GF} SELECT frame, gi, gj, NOT masked AND (outlier OR coalesce(NOT (sqrt(u * u + v * v) BETWEEN 1 AND 6), true) OR coalesce(NOT (abs(u) / 2 >= 0.25), true)) AS outlier FROM gf")
def validators(spark, sf_dir):
    f = gf(spark, sf_dir).withColumn("peak_ratio", F.abs("u") / 2)
    return fields.validate(f, [("velocity_magnitude", {"min": 1, "max": 6}), ("peak_ratio", 0.25)]).select("frame", "gi", "gj", "outlier")


_SCALED = "WITH {gf}, k AS (SELECT *, CASE frame % 3 WHEN 0 THEN 0.02::DOUBLE WHEN 1 THEN 0.5::DOUBLE END AS size, CASE frame % 3 WHEN 0 THEN 0.005::DOUBLE WHEN 1 THEN 2.0::DOUBLE END AS dt FROM gf)"


@_query(_SCALED.format(gf=GF) + f" SELECT frame, gi, gj, {_R('x * coalesce(size, 1)', 'x')}, {_R('y * coalesce(size, 1)', 'y')}, {_R('u * coalesce(size / dt, 1)', 'u')}, {_R('v * coalesce(size / dt, 1)', 'v')}, CASE frame % 3 WHEN 0 THEN 'mm' WHEN 1 THEN 'um' ELSE 'px' END AS length_unit, CASE frame % 3 WHEN 0 THEN 'mm/s' WHEN 1 THEN 'um/ms' ELSE 'px/frame' END AS velocity_unit FROM k")
def physical_units(spark, sf_dir):
    """Frames of two scales and of none; each row goes by its own, and only once."""
    g = gf(spark, sf_dir)
    of = lambda k, scale: fields.with_scale(g.filter(F.col("frame") % 3 == k), scale)
    both = of(0, PhysicalScale(0.02, 0.005, "mm", "s")).unionByName(of(1, PhysicalScale(0.5, 2.0, "um", "ms"))).unionByName(of(2, None), allowMissingColumns=True)
    return rounded(fields.physical(fields.physical(both)).select("frame", "gi", "gj", "x", "y", "u", "v", "length_unit", "velocity_unit"))


@_query(f"WITH {GF} SELECT 'planar' AS result_type, frame::VARCHAR AS frame_id, row_number() OVER (PARTITION BY frame ORDER BY gj, gi)::INT AS point_id, gi AS i, gj AS j, {_R('x')}, {_R('y')}, {_R('u')}, {_R('v')}, masked, outlier, 'px' AS length_unit, 'frame' AS time_unit, 'px/frame' AS velocity_unit FROM gf")
def table_export(spark, sf_dir):
    t = sinks.export_table(gf(spark, sf_dir), key="frame")
    return rounded(t.select("result_type", "frame_id", "point_id", "i", "j", "x", "y", "u", "v", "masked", "outlier", "length_unit", "time_unit", "velocity_unit"))


@_query(f"WITH {GF} SELECT frame, gi, gj, {_R('0.8 * x - 0.6 * y + 5', 'x')}, {_R('0.6 * x + 0.8 * y - 3', 'y')}, {_R('0.8 * u - 0.6 * v', 'u')}, {_R('0.6 * u + 0.8 * v', 'v')} FROM gf")
def transform_field(spark, sf_dir):
    return rounded(fields.transform_field(gf(spark, sf_dir), ((0.8, -0.6), (0.6, 0.8)), (5.0, -3.0)).select("frame", "gi", "gj", "x", "y", "u", "v"))


@_query(f"WITH {GF} SELECT round(CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END, 6) + 0.0 AS lo, round(CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END, 6) + 0.0 AS hi, round(length, 6) + 0.0 AS length FROM (SELECT quantile_disc(u, 0.02) AS lo, quantile_disc(u, 0.98) AS hi, quantile_cont(sqrt(u * u + v * v), 0.99) AS length FROM ok WHERE good)")
def color_limits(spark, sf_dir):
    g = gf(spark, sf_dir)
    return rounded(fields.color_limits(g, "u").crossJoin(F.broadcast(fields.arrow_scale(g))))  # one row each


# --- scattered points ---


@_query("WITH p AS (SELECT l_linenumber AS frame, l_quantity * 4 AS x, l_discount * 1000 AS y, l_extendedprice / 9973 AS u, l_tax * 100 AS v FROM lineitem), b AS (SELECT frame, least(greatest(round_even((y - 8) / 16, 0) + 1, 1), 6)::INT AS gi, least(greatest(round_even((x - 8) / 16, 0) + 1, 1), 12)::INT AS gj, median(u) AS u, median(v) AS v, count(*) AS n FROM p GROUP BY ALL), g AS (SELECT f.frame, i.i AS gi, j.j AS gj FROM (SELECT DISTINCT frame FROM p) f CROSS JOIN (SELECT unnest(generate_series(1, 6)) AS i) i CROSS JOIN (SELECT unnest(generate_series(1, 12)) AS j) j) SELECT g.frame, g.gi::INT AS gi, g.gj::INT AS gj, (8.0 + (g.gj - 1) * 16)::DOUBLE AS x, (8.0 + (g.gi - 1) * 16)::DOUBLE AS y, round(CASE WHEN n >= 3 THEN u END, 6) + 0.0 AS u, round(CASE WHEN n >= 3 THEN v END, 6) + 0.0 AS v, coalesce(n, 0) AS n, coalesce(n, 0) < 3 AS masked FROM g LEFT JOIN b ON g.frame = b.frame AND g.gi = b.gi AND g.gj = b.gj")
def bin_to_grid_median(spark, sf_dir):
    p = _table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("frame"), (F.col("l_quantity") * 4).alias("x"), (F.col("l_discount") * 1000).alias("y"), (F.col("l_extendedprice") / 9973).alias("u"), (F.col("l_tax") * 100).alias("v"))
    return rounded(fields.bin_to_grid(p, 12, 6, 8.0, 8.0, 16.0))


def scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 5).alias("x"), ((F.col("p_partkey") * 37) % 211).cast("double").alias("y"), (F.col("p_size") / 10.0).alias("u"), ((F.col("p_partkey") % 17) / 4.0).alias("v"))


PTS = "p AS (SELECT p_partkey AS id, p_retailprice / 5 AS x, ((p_partkey * 37) % 211)::DOUBLE AS y, p_size / 10.0::DOUBLE AS u, (p_partkey % 17) / 4.0::DOUBLE AS v FROM part), q AS (SELECT a.id AS id_a, b.id AS id_b, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS d2, a.u AS ua, b.u AS ub, a.v AS va, b.v AS vb FROM p a JOIN p b ON a.id <> b.id), k AS (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY d2, id_b) AS rank FROM q)"


@_query(f"WITH {PTS} SELECT id_a, id_b, round(d2, 4) + 0.0 AS d2 FROM q WHERE d2 <= 81")
def range_join(spark, sf_dir):
    p = scattered(spark, sf_dir)
    near = neighbors.range_join(p, p, 9.0).filter("id_a <> id_b")
    return near.select("id_a", "id_b", (F.floor(F.col("d2") * 1e4 + 0.5) / 1e4).alias("d2"))  # 0 to 81, rounded as SQL does; F.round goes by decimal text, most of the time


@_query(f"WITH {PTS} SELECT id_a, id_b, rank::INT AS rank FROM k WHERE rank <= 4")
def knn_join(spark, sf_dir):
    """The four nearest however far."""
    return neighbors.knn(scattered(spark, sf_dir), 4).select("id_a", "id_b", "rank")


@_query(f"WITH {PTS}, e AS (SELECT *, median(ub) OVER w AS mu, median(vb) OVER w AS mv, count(*) OVER w AS n FROM k WHERE rank <= 8 WINDOW w AS (PARTITION BY id_a)), d AS (SELECT id_a, any_value(n) AS n, abs(any_value(ua) - any_value(mu)) / (median(abs(ub - mu)) + 0.1) > 2 OR abs(any_value(va) - any_value(mv)) / (median(abs(vb - mv)) + 0.1) > 2 AS flag FROM e GROUP BY id_a) SELECT id, coalesce(n >= 3 AND flag, false) AS flag FROM p LEFT JOIN d ON id = id_a")
def scattered_outliers(spark, sf_dir):
    return neighbors.scattered_outliers(scattered(spark, sf_dir)).select("id", "flag")


# --- tracks ---


def user_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("track_id"), F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("frame"))
    return e.agg(F.avg("value").alias("x"), F.max("value").alias("y"))


TRACKS = "t AS (SELECT user_id AS track_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))::INT AS frame, avg(value) AS x, max(value) AS y FROM events GROUP BY ALL)"


@_query(f"WITH {TRACKS}, w AS (SELECT *, coalesce(lag(x) OVER o, x) AS xa, coalesce(lead(x) OVER o, x) AS xb, coalesce(lag(y) OVER o, y) AS ya, coalesce(lead(y) OVER o, y) AS yb, coalesce(lag(frame) OVER o, frame) AS fa, coalesce(lead(frame) OVER o, frame) AS fb FROM t WINDOW o AS (PARTITION BY track_id ORDER BY frame)) SELECT track_id, frame, round(CASE WHEN fb > fa THEN (xb - xa) / (fb - fa) * 4 END, 6) + 0.0 AS u, round(CASE WHEN fb > fa THEN (yb - ya) / (fb - fa) * 4 END, 6) + 0.0 AS v FROM w")
def trajectory_velocities(spark, sf_dir):
    return rounded(tracks.trajectory_velocities(user_tracks(spark, sf_dir), PhysicalScale(0.02, 0.005)).select("track_id", "frame", "u", "v"))


@_query(f"WITH {TRACKS}, w AS (SELECT *, sqrt((x - lag(x) OVER o) ** 2 + (y - lag(y) OVER o) ** 2) AS d, frame - lag(frame) OVER o AS g FROM t WINDOW o AS (PARTITION BY track_id ORDER BY frame)) SELECT track_id, min(frame) AS start_frame, count(*) AS n, coalesce(sum(g - 1), 0)::BIGINT AS gaps, round(sum(d) / sum(g), 6) + 0.0 AS mean_speed FROM w GROUP BY track_id")
def track_summary(spark, sf_dir):
    return rounded(tracks.track_summary(user_tracks(spark, sf_dir)))


# --- geometry ---

_P = ((900.0, 12.0, -30.0, 400.0), (-8.0, 880.0, 25.0, 300.0), (0.001, 0.002, -0.01, 5.0))


@_query("WITH w AS (SELECT s_suppkey % 9 - 4.0 AS x, s_suppkey % 7 - 3.0 AS y, s_suppkey % 3 - 1.0 AS z, s_acctbal / 1e4 AS e, s_nationkey AS camera FROM supplier), p AS (SELECT *, (900 * x + 12 * y - 30 * z + 400) / (0.001 * x + 0.002 * y - 0.01 * z + 5) AS px, (-8 * x + 880 * y + 25 * z + 300) / (0.001 * x + 0.002 * y - 0.01 * z + 5) AS py FROM w), r AS (SELECT camera, sqrt((px - (px + e)) ** 2 + (py - (py - e / 2)) ** 2) AS d FROM p) SELECT camera, round(sqrt(avg(d * d)), 6) + 0.0 AS rms, round(max(d), 6) + 0.0 AS largest, count(*) AS n FROM r GROUP BY camera")
def reprojection_quality(spark, sf_dir):
    w = _table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 9 - 4.0).alias("x"), (F.col("s_suppkey") % 7 - 3.0).alias("y"), (F.col("s_suppkey") % 3 - 1.0).alias("z"), (F.col("s_acctbal") / 1e4).alias("e"), F.col("s_nationkey").alias("camera"))
    px, py = C.pinhole(_P, "x", "y", "z")
    seen = w.select("camera", F.col("x").alias("X"), F.col("y").alias("Y"), F.col("z").alias("Z"), (px + F.col("e")).alias("px"), (py - F.col("e") / 2).alias("py"))
    cameras = w.select("camera").distinct().select("camera", F.lit("pinhole").alias("model"), F.array(*[F.lit(v) for row in _P for v in row]).alias("params"))
    return rounded(calibration.calibration_quality(calibration.reprojection_errors(seen, cameras), "camera"))


@_query("WITH p AS (SELECT (o_orderkey % 100)::DOUBLE AS x, (o_custkey % 90)::DOUBLE AS y, o_totalprice / 1e5 AS z FROM orders), s AS (SELECT covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM p), t AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS b, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS c FROM s) SELECT round(mz - b * mx - c * my, 5) + 0.0 AS a, round(b, 5) + 0.0 AS b, round(c, 5) + 0.0 AS c FROM t")
def sheet_plane_fit(spark, sf_dir):
    p = _table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100).cast("double").alias("x"), (F.col("o_custkey") % 90).cast("double").alias("y"), (F.col("o_totalprice") / 1e5).alias("z"))
    return rounded(calibration.fit_sheet_plane(p), 5)


@_query("SELECT c_custkey, round(((c_custkey % 50) * 0.8 + 0.6 * (c_nationkey - 2) - 0.8)::DOUBLE, 6) + 0.0 AS x, round((-0.6 * (c_custkey % 50 - 1) + 0.8 * (c_nationkey - 2))::DOUBLE, 6) + 0.0 AS y FROM customer")
def planar_calibration(spark, sf_dir):
    t = geometry.planar_calibration((1, 2), (5, 5), 5.0)
    x, y = C.planar_point(t, F.col("c_custkey") % 50, F.col("c_nationkey"))
    return rounded(_table(spark, sf_dir, "customer").select("c_custkey", x.alias("x"), y.alias("y")))


# --- whole analyses ---


def recording(spark: SparkSession, n: int = 4, size: int = 128, flow=None, density: float = 0.03) -> DataFrame:
    """FRAMES of particles carried by a flow, made on the driver from a fixed seed."""
    rng = np.random.default_rng(7)
    p = synthetic.particle_field((size + 32, size + 32), density, rng)
    p = p | {"x": p["x"] - 16, "y": p["y"] - 16}
    flow = flow or synthetic.linear_flow(1.5, -0.8)
    out = []
    for k in range(n):
        out.append(synthetic.render(p, (size, size), lambda z: synthetic.laser_intensity(z, 0, 8), 0.01, rng=rng))
        p = synthetic.displaced(p, flow)
    return images.frames_of(spark, out, timestamps=[0.1 * k for k in range(n)])


@_query(None)
def run_piv_mosaics(spark, sf_dir):
    """Two passes over every pair of mosaics, with uncertainties."""
    f = mosaics(spark, sf_dir)
    pairs = recordings.image_pairs(f, "chained").select(F.col("pair_id").cast("long"), "idx_a", "idx_b")
    return piv.run_piv_sequence(pairs, f, multipass_parameters([16, 8], padding=True, apodization="gauss", final={"uncertainty": True}))


@_query(None)
def ensemble_mosaics(spark, sf_dir):
    """One field of all pairs of mosaics."""
    f = mosaics(spark, sf_dir)
    got = piv.run_piv_ensemble(recordings.with_pixels(recordings.image_pairs(f, "chained"), f), [PIVParameters((16, 16), overlap=(8, 8), padding=True)])
    rows = [(int(i + 1), int(j + 1), float(got.u[i, j]), float(got.v[i, j])) for i in range(len(got.y)) for j in range(len(got.x))]
    return spark.createDataFrame(rows, "gi int, gj int, u double, v double")


@_query(None)
def ptv_mosaics(spark, sf_dir):
    f = mosaics(spark, sf_dir)
    return ptv.run_ptv_sequence(recordings.image_pairs(f, "chained"), f, PTVParameters(threshold_k=1.0, search_radius=3), None)


@_query(None)
def tracking_mosaics(spark, sf_dir):
    """Tracks within every sixteen mosaics."""
    f = mosaics(spark, sf_dir).withColumn("recording", F.floor((F.col("frame_idx") - 1) / 16))
    found = ptv.detect_particles(f, PTVParameters(threshold_k=1.0), keys=("recording",))
    return tracks.exploded(ptv.track_particles(found, PTVParameters(search_radius=3), max_gap=1))


_FLOW = "WITH p AS (SELECT p_partkey AS id, p_retailprice / 10 AS x, (p_partkey * 37 % 211)::DOUBLE AS y, p_size / 50.0::DOUBLE - 0.5 AS z FROM part), q AS (SELECT *, sqrt((x - 128) ** 2 + (y - 100) ** 2) AS r FROM p)"


@_query(_FLOW + " SELECT id, round(x + CASE WHEN r > 0 THEN -2 * (y - 100) / r ELSE 0 END, 6) + 0.0 AS x_b, round(y + CASE WHEN r > 0 THEN 2 * (x - 128) / r ELSE 0 END, 6) + 0.0 AS y_b, round(exp(-(z * z) / (2 * (1 / 2.3548200450309493) ** 2)), 6) + 0.0 AS light FROM q")
def particle_field(spark, sf_dir):
    """Particles carried by a vortex through a light sheet."""
    t = _table(spark, sf_dir, "part")
    p = t.select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 10).alias("x"), (F.col("p_partkey") * 37 % 211).cast("double").alias("y"), (F.col("p_size") / 50 - 0.5).alias("z"))
    u, v, _ = C.vortex_flow(128.0, 100.0, 2.0)(F.col("x"), F.col("y"), F.col("z"), 0.0)
    return rounded(p.select("id", (F.col("x") + u).alias("x_b"), (F.col("y") + v).alias("y_b"), C.laser_intensity("z").alias("light")))
