"""Queries by name, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grid import Grid, positions

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query function under its own name."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


#: The reference ratios of window and overlap, scaled to the test tables.
GRID = Grid(1000, 375)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, pos, total, l, r: the events of a type in time order, as a stereo signal."""
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("track"), "ts", "event_id", (F.col("value") / 997).alias("l"), (-F.col("value") / 1999).alias("r"))
    return positions(e, ["track"], ["ts", "event_id"], F.date_trunc("day", "ts")).select("track", "pos", "total", "l", "r")


def r6(c) -> F.Column:
    """Rounded for comparison, never a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


# SQL of the signal, its tracks, its windows by a plain range join, and the fade.
SIGNAL = """sig AS (
  SELECT event_type AS track, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos,
         count(*) OVER (PARTITION BY event_type) AS total, value / 997.0::DOUBLE AS l, -value / 1999.0::DOUBLE AS r FROM events)"""
TRACKS = SIGNAL + """, tracks AS (SELECT DISTINCT track, total FROM sig)"""


def schedule_sql(win: int, overlap: int) -> str:
    hop = win - overlap
    return TRACKS + f""", starts AS (
  SELECT track, total, unnest(CASE WHEN total <= {win} THEN [0] ELSE list_concat(range(0, total - {win} + 1, {hop}),
         CASE WHEN (total - {win}) % {hop} <> 0 THEN [total - {win}] ELSE [] END) END) AS start FROM tracks),
sched AS (
  SELECT track, total, row_number() OVER w - 1 AS win_id, start, least(total - start, {win}) AS take,
         coalesce(lead(start) OVER w, total) AS next_start, row_number() OVER w = 1 AS is_first, lead(start) OVER w IS NULL AS is_last
  FROM starts WINDOW w AS (PARTITION BY track ORDER BY start))"""


def assigned_sql(win: int, overlap: int) -> str:
    return schedule_sql(win, overlap) + f""", assigned AS (
  SELECT sig.*, win_id, start, pos - start AS k, is_first, is_last,
         CASE WHEN NOT is_last AND pos - start >= {win - overlap} THEN ({win - 1} - (pos - start)) / {overlap - 1}.0::DOUBLE
              WHEN NOT is_first AND pos - start < {overlap} THEN (pos - start) / {overlap - 1}.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sig JOIN sched USING (track, total) WHERE pos >= start AND pos < start + {win})"""


def ordered_stems(win: int, overlap: int) -> str:
    """Stems of the signal bit for bit: every step in single precision, windows in order."""
    parts = {"voc_l": "l", "voc_r": "r", "bg_l": "l", "bg_r": "r"}
    share = {p: f"{c}::FLOAT * 0.25::FLOAT" if p[0] == "v" else f"{c}::FLOAT - {c}::FLOAT * 0.25::FLOAT" for p, c in parts.items()}
    lists = ", ".join(f"list(({x}) * w::FLOAT ORDER BY win_id) AS {p}" for p, x in share.items())
    total = "list_reduce({0}, lambda a, b: a + b)".format
    made = ", ".join(f"(CASE WHEN {total('ws')} > 1e-8::FLOAT THEN {total(p)} / {total('ws')} ELSE 0::FLOAT END)::DOUBLE AS {p}" for p in parts)
    return f"WITH {assigned_sql(win, overlap)}, lists AS (SELECT track, pos, list(w::FLOAT ORDER BY win_id) AS ws, {lists} FROM assigned GROUP BY track, pos) SELECT track, pos, {made} FROM lists"


SCHEDULE = schedule_sql(1000, 375)
ASSIGNED = assigned_sql(1000, 375)
