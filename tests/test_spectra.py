"""Frames and small spectra: no join on positions, which Spark would broadcast whole; right at the ends of tracks."""

import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from wavelane.operators import spectral
from wavelane.plans.catalog import QUERIES


def mirrored(total, n_fft, hop):
    """(frame, k, pos) by the definition: mirrored once, places outside the track dropped."""
    for frame in range(total // hop + 1):
        for k in range(n_fft):
            p = frame * hop + k - n_fft // 2
            p = -p if p < 0 else 2 * (total - 1) - p if p >= total else p
            if 0 <= p < total:
                yield frame, k, p


@pytest.mark.parametrize("n_fft, hop", [(16, 4), (8, 8), (4, 6), (6, 1)])
def test_frames_of_tracks_of_every_length(spark, n_fft, hop):
    totals = range(1, 41)
    signal = spark.createDataFrame([(f"t{n}", p, n, float(100 * n + p)) for n in totals for p in range(n)], "track string, pos long, total long, v double")
    out = spectral.framed(signal, ["track"], n_fft, hop)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [("track", "string"), ("total", "bigint"), ("frame", "int"), ("k", "int"), ("v", "double")]
    want = sorted((f"t{n}", n, f, k, float(100 * n + p)) for n in totals for f, k, p in mirrored(n, n_fft, hop))
    assert sorted(map(tuple, out.collect())) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def final_plan(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", ["gather_and_scatter", "masked_spectrum", "short_dft_round_trip", "framed_signal", "short_dft"])
def test_positions_are_not_broadcast(spark, name):
    """At 60 times sf0.1 the places of all frames, 24 million, were broadcast by way of the driver."""
    plan = final_plan(QUERIES[name](spark, SF))
    assert "isFinalPlan=true" in plan
    assert not re.search(r"Join \[track#\d+, pos#", plan)


def broadcast_rows(node):
    """Rows of each broadcast in a plan that has run."""
    name = node.nodeName()
    if "QueryStage" in name:
        return broadcast_rows(node.plan())
    if name == "AdaptiveSparkPlan":
        return broadcast_rows(node.executedPlan())
    own = [node.metrics().apply("numOutputRows").value()] if name == "BroadcastExchange" else []
    return own + [n for k in range(node.children().size()) for n in broadcast_rows(node.children().apply(k))]


@pytest.mark.parametrize("name", ["masked_spectrum", "framed_signal", "short_dft"])
def test_no_broadcast_grows_with_the_events(spark, tmp_path, name):
    """Ten copies of the events: only counts by track and day are broadcast, as many as for one copy."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    days = e.selectExpr("event_type", "date_trunc('day', ts)").distinct().count()
    copies = e.crossJoin(spark.range(10).withColumnRenamed("id", "copy")).withColumn("event_id", F.expr("event_id + copy * 1000000")).drop("copy")
    copies.write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        df = QUERIES[name](spark, str(tmp_path))
        df.collect()
        rows = broadcast_rows(df._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows and max(rows) <= days


def test_bands_stay_where_the_spectra_are(spark):
    """One exchange by frame at most (none where the signal is small enough to stay together); there were two."""
    plan = final_plan(QUERIES["gather_and_scatter"](spark, SF))
    assert len(re.findall(r"Exchange hashpartitioning\(track#\d+, (?:total#\d+L?, )?frame#", plan)) <= 1


def test_inverse_of_tracks_of_every_length(spark):
    totals = range(1, 41)
    signal = spark.createDataFrame([(f"t{n}", p, n, float((p * 37 + n) % 11 - 5)) for n in totals for p in range(n)], "track string, pos long, total long, v double")
    back = spectral.small_idft(spectral.small_dft(signal, ["track"], 16, 4), ["track"], 16, 4)
    got = sorted((r.track, r.pos, round(r.v, 9) + 0.0) for r in back.collect())
    assert got == sorted((f"t{n}", p, float((p * 37 + n) % 11 - 5)) for n in totals for p in range(n) if p < n // 4 * 4 + 8)
    # A frame's samples are summed side by side, not once for each bin and place.
    assert not re.search(r"hashpartitioning\([^)]*frame#\d+, (?:k|bin)#", final_plan(back))
