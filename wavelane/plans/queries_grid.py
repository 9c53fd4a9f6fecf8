"""Queries on the window grid, the crossfade and resuming."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.signal import to_i16
from ..operators import overlap
from .grid import Grid
from .registry import ASSIGNED, GRID, SCHEDULE, events_signal, query, r6

W = "WITH "
KEYS = ["track"]


def tracks(spark, sf_dir):
    return events_signal(spark, sf_dir).select("track", "total").distinct()


@query(W + SCHEDULE + " SELECT track, total, win_id, start, take, next_start, is_first, is_last FROM sched")
def chunk_schedule(spark, sf_dir):
    """The windows of each track."""
    s = GRID.schedule(tracks(spark, sf_dir), "total", "track")
    return s.select("track", "total", F.col("win_id").cast("long").alias("win_id"), "start", F.col("take").cast("long").alias("take"), "next_start", "is_first", "is_last")


CASES = [(0, 1000, 375), (1, 1000, 375), (999, 1000, 375), (1000, 1000, 375), (1001, 1000, 375), (1625, 1000, 375), (2250, 1000, 375), (5000, 800, 250), (5050, 800, 250), (5060, 800, 400), (3000, 500, 0)]


@query("""
WITH cases(total, win, overlap) AS (VALUES (0,1000,375),(1,1000,375),(999,1000,375),(1000,1000,375),(1001,1000,375),(1625,1000,375),(2250,1000,375),(5000,800,250),(5050,800,250),(5060,800,400),(3000,500,0))
SELECT CAST(total AS BIGINT) AS total, CAST(win AS BIGINT) AS win, CAST(overlap AS BIGINT) AS overlap,
       CAST(unnest(CASE WHEN total <= win THEN [0] ELSE list_concat(range(0, total - win + 1, win - overlap),
       CASE WHEN (total - win) % (win - overlap) <> 0 THEN [total - win] ELSE [] END) END) AS BIGINT) AS start
FROM cases""")
def schedule_cases(spark, sf_dir):
    """G1 on the boundary cases of the grid."""
    out = None
    for win, ov in sorted({(w, o) for _, w, o in CASES}):
        totals = spark.createDataFrame([(t,) for t, w, o in CASES if (w, o) == (win, ov)], "total long")
        s = Grid(win, ov).schedule(totals).select("total", F.lit(win).cast("long").alias("win"), F.lit(ov).cast("long").alias("overlap"), "start")
        out = s if out is None else out.union(s)
    return out


@query(W + ASSIGNED + " SELECT track, win_id, start, count(*) AS frames, min(pos) AS first_pos, max(pos) AS last_pos FROM assigned GROUP BY ALL")
def window_assignment(spark, sf_dir):
    """Frames of each window, by arithmetic instead of a range join."""
    a = GRID.assign(events_signal(spark, sf_dir))
    return a.groupBy("track", "win_id", "start").agg(F.count("*").alias("frames"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query(W + ASSIGNED + """
SELECT track, n AS contributors, count(*) AS frames, round(max(s), 6) + 0.0 AS top_weight FROM (SELECT track, pos, count(*) AS n, sum(w) AS s FROM assigned GROUP BY ALL) GROUP BY ALL""")
def contributors(spark, sf_dir):
    """how many windows a frame has, and the largest weight sum."""
    a = GRID.assign(events_signal(spark, sf_dir)).withColumn("w", GRID.fade(F.col("k"), F.col("is_first"), F.col("is_last")))
    per = a.groupBy("track", "pos").agg(F.count("*").alias("contributors"), F.sum("w").alias("s"))
    return per.groupBy("track", "contributors").agg(F.count("*").alias("frames"), r6(F.max("s")).alias("top_weight"))


@query(W + SCHEDULE + " SELECT track, count(*) AS windows, sum(take)::BIGINT AS frames_read, round(sum(take) / max(total)::DOUBLE, 6) + 0.0 AS factor FROM sched GROUP BY track")
def reread_factor(spark, sf_dir):
    """frames read over frames there are."""
    s = GRID.schedule(tracks(spark, sf_dir), "total", "track")
    return s.groupBy("track").agg(F.count("*").alias("windows"), F.sum("take").alias("frames_read"), r6(F.sum("take") / F.max("total").cast("double")).alias("factor"))


@query(W + SCHEDULE + """, kept AS (SELECT DISTINCT track, total, unnest([0, 1, 624, 625, 700, total // 2, total - 1000, total - 1, total]) AS frames FROM tracks),
spot AS (SELECT k.track, k.total, k.frames, coalesce(max(win_id) FILTER (start <= frames), 0) AS j, count(*) AS n FROM kept k JOIN sched s ON k.track = s.track GROUP BY ALL),
keep AS (SELECT a.*, s.start AS keep FROM spot a JOIN sched s ON a.track = s.track AND s.win_id = j),
prime AS (SELECT k.track, k.frames, count(*) FILTER (s.win_id < j AND s.start + s.take <= keep) AS p FROM keep k JOIN sched s ON k.track = s.track GROUP BY k.track, k.frames)
SELECT k.track, k.frames, CAST(CASE WHEN k.frames >= total THEN n ELSE j END AS BIGINT) AS first, CAST(CASE WHEN k.frames >= total THEN n ELSE p END AS BIGINT) AS prime_from,
       CAST(CASE WHEN k.frames >= total THEN total ELSE keep END AS BIGINT) AS keep_frames
FROM keep k JOIN prime p ON k.track = p.track AND k.frames = p.frames""")
def resume_plan(spark, sf_dir):
    """Where a run goes on that has some frames written."""
    t = tracks(spark, sf_dir)
    n = F.col("total")
    some = F.array(*[F.lit(x).cast("long") for x in (0, 1, 624, 625, 700)], F.floor(n / 2), n - 1000, n - 1, n)
    rows = t.select("track", "total", F.explode(F.array_distinct(some)).alias("frames"))
    plan = rows.select("track", "frames", GRID.resume(n, F.col("frames")).alias("p"))
    return plan.select("track", "frames", "p.*")


@query(W + SCHEDULE + " SELECT track, win_id, start + least(total - start, 1000) > total // 2 AS reaches_past FROM sched")
def reaches_past(spark, sf_dir):
    """Whether a window covers frames from half of the track on."""
    s = GRID.schedule(tracks(spark, sf_dir), "total", "track")
    return s.select("track", F.col("win_id").cast("long").alias("win_id"), (F.col("start") + F.col("take") > F.floor(F.col("total") / 2)).alias("reaches_past"))


@query("""
WITH k AS (SELECT unnest(range(0, 1000)) AS k), e AS (SELECT * FROM (VALUES (true, true), (true, false), (false, true), (false, false)) t(is_first, is_last))
SELECT CAST(k AS BIGINT) AS k, is_first, is_last, round(CASE WHEN NOT is_last AND k >= 625 THEN (999 - k) / 374.0::DOUBLE WHEN NOT is_first AND k < 375 THEN k / 374.0::DOUBLE ELSE 1.0::DOUBLE END, 6) + 0.0 AS w FROM k, e""")
def fade_weights(spark, sf_dir):
    """The crossfade of a window, for each kind of edge."""
    edges = spark.createDataFrame([(a, b) for a in (True, False) for b in (True, False)], "is_first boolean, is_last boolean")
    k = edges.select("is_first", "is_last", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(GRID.win - 1).cast("long"))).alias("k"))
    return k.select("k", "is_first", "is_last", r6(GRID.fade(F.col("k"), F.col("is_first"), F.col("is_last"))).alias("w"))


STEMS = ASSIGNED + """, merged AS (
  SELECT track, pos, sum(w) AS w_sum, sum(l * 0.25::DOUBLE * w) AS voc_l, sum(r * 0.25::DOUBLE * w) AS voc_r,
         sum((l - l * 0.25::DOUBLE) * w) AS bg_l, sum((r - r * 0.25::DOUBLE) * w) AS bg_r FROM assigned GROUP BY track, pos),
stems AS (SELECT track, pos, CASE WHEN w_sum > 1e-8 THEN voc_l / w_sum ELSE 0 END AS voc_l, CASE WHEN w_sum > 1e-8 THEN voc_r / w_sum ELSE 0 END AS voc_r,
         CASE WHEN w_sum > 1e-8 THEN bg_l / w_sum ELSE 0 END AS bg_l, CASE WHEN w_sum > 1e-8 THEN bg_r / w_sum ELSE 0 END AS bg_r FROM merged)"""
PARTS = overlap.PARTS


def stems(spark, sf_dir):
    return overlap.stems_by_row(events_signal(spark, sf_dir), GRID, lambda x: x * 0.25, KEYS)


@query(W + STEMS + " SELECT track, pos, " + ", ".join(f"round({p}, 6) + 0.0 AS {p}" for p in PARTS) + " FROM stems")
def overlap_add(spark, sf_dir):
    """Crossfaded stems of each track."""
    return stems(spark, sf_dir).select("track", "pos", *[r6(F.col(p)).alias(p) for p in PARTS])


def quantised(parts):
    # Rounded first, so that both engines cut the same number towards zero.
    return [to_i16(F.round(F.col(p), 9)).alias(p) for p in parts]


@query(W + STEMS + " SELECT track, pos, " + ", ".join(f"CAST(trunc(greatest(least(round({p}, 9), 1.0), -1.0) * 32767) AS SMALLINT) AS {p}" for p in PARTS) + " FROM stems")
def stems_quantised(spark, sf_dir):
    """The flagship: scan, windows, separation, crossfade, 16-bit stems."""
    return stems(spark, sf_dir).select("track", "pos", *quantised(PARTS))


@query(W + STEMS + " SELECT track, pos, " + ", ".join(f"round({p}, 6) + 0.0 AS {p}" for p in PARTS) + " FROM stems")
def stems_by_model(spark, sf_dir):
    """M1, K13 in shape: windows go whole through a separator in Python."""
    out = overlap.stems(events_signal(spark, sf_dir), GRID, lambda: overlap.ScaledMix(GRID.win, dtype=np.float64), KEYS)
    return out.select("track", "pos", *[r6(F.col(p)).alias(p) for p in PARTS])


@query(W + STEMS + """, keep AS (SELECT track, total, max(start) FILTER (start <= total // 2) AS keep FROM sched GROUP BY ALL)
SELECT track, pos, round(voc_l, 6) + 0.0 AS voc_l FROM stems JOIN keep USING (track) WHERE pos >= keep""")
def resumed_tail(spark, sf_dir):
    """Windows from prime_from on give the same frames from the seam on as a whole run."""
    frames = events_signal(spark, sf_dir)
    plan = frames.select("track", "total").distinct().select("track", GRID.resume(F.col("total"), F.floor(F.col("total") / 2)).alias("plan"))  # one a track
    rows = GRID.assign(frames.join(plan, "track")).filter(F.col("win_id") >= F.col("plan.prime_from"))
    w = GRID.fade(F.col("k"), F.col("is_first"), F.col("is_last"))
    parts = rows.select("track", "pos", "plan", (F.col("l") * 0.25).alias("voc_l"), *[F.lit(0.0).alias(p) for p in PARTS[1:]], w.alias("w")).filter(F.col("pos") >= F.col("plan.keep_frames"))
    return overlap.crossfade(parts, ["track", "pos"]).select("track", "pos", r6(F.col("voc_l")).alias("voc_l"))


@query(W + STEMS + """, every AS (SELECT track, unnest(range(0, total + 5)) AS pos FROM tracks)
SELECT track, pos, round(coalesce(voc_l, 0.0), 6) + 0.0 AS voc_l FROM every LEFT JOIN stems USING (track, pos)""")
def zero_filled(spark, sf_dir):
    """Positions without output are silence."""
    longer = tracks(spark, sf_dir).withColumn("total", F.col("total") + 5)
    return overlap.filled(stems(spark, sf_dir), longer, KEYS, ("voc_l",)).select("track", "pos", r6(F.col("voc_l")).alias("voc_l"))


@query(W + ASSIGNED + " SELECT track, pos, list_reduce(list(l::FLOAT * w::FLOAT ORDER BY win_id), lambda a, b: a + b)::DOUBLE AS sum FROM assigned GROUP BY track, pos")
def single_precision_sum(spark, sf_dir):
    """F1 bit for bit in single precision: parts are added in window order."""
    rows = GRID.assign(events_signal(spark, sf_dir))
    w = GRID.fade(F.col("k"), F.col("is_first"), F.col("is_last")).cast("float")
    sums = overlap.ordered_sum(rows.select("track", "pos", "win_id", (F.col("l").cast("float") * w).cast("float").alias("c")), ["track", "pos"])
    return sums.withColumn("sum", F.col("sum").cast("double"))


@query(W + STEMS + """, ends AS (SELECT track, next_start, win_id FROM sched), n AS (SELECT s.track, pos, min(win_id) AS win_id FROM stems s JOIN ends e ON s.track = e.track AND pos < next_start GROUP BY ALL)
SELECT track, win_id, count(*) AS frames, min(pos) AS first_pos FROM n GROUP BY ALL""")
def flushed_by_window(spark, sf_dir):
    """Frames that become final with each window."""
    s = GRID.schedule(tracks(spark, sf_dir), "total", "track")
    return s.select("track", F.col("win_id").cast("long").alias("win_id"), (F.col("next_start") - F.col("start")).alias("frames"), F.col("start").alias("first_pos"))
