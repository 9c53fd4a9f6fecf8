import pytest
from pyspark.sql import functions as F

from wavelane.errors import ModelError
from wavelane.plans.grid import Grid, positions


def starts(total, win, overlap):
    out, s = [], 0
    if total <= win:
        return [0]
    while s + win <= total:
        out.append(s)
        s += win - overlap
    return out + [total - win] * (out[-1] < total - win)


W, OV = 176_400, 66_150


@pytest.mark.parametrize("total", [0, 1, W - 1, W, W + 1, 2 * W - OV, 2 * W - OV + 1, 3 * W])
def test_schedule_at_the_boundaries(spark, total):
    got = Grid(W, OV).schedule(spark.createDataFrame([(total,)], "total long")).orderBy("win_id").collect()
    assert [r.start for r in got] == starts(total, W, OV)
    assert [r.is_first for r in got] == [True] + [False] * (len(got) - 1)
    assert got[-1].is_last and got[-1].next_start == total


def test_bad_grids():
    for win, ov in ((0, 0), (10, 6), (10, -1)):
        with pytest.raises(ModelError):
            Grid(win, ov)
    assert Grid(10, 0).hop == 10


@pytest.mark.parametrize("total", [5, 10, 11, 16, 17, 40, 43])
@pytest.mark.parametrize("overlap", [0, 3, 4, 5])
def test_assignment_is_the_range_join(spark, total, overlap):
    g = Grid(10, overlap)
    frames = spark.range(total).select(F.col("id").alias("pos"), F.lit(total).cast("long").alias("total"))
    got = {(r.pos, r.start) for r in g.assign(frames).collect()}
    assert got == {(p, s) for s in starts(total, 10, overlap) for p in range(total) if s <= p < s + 10}


@pytest.mark.parametrize("total", [10, 16, 17, 40, 43, 55])
def test_resume_plan_reaches_back_far_enough(spark, total):
    g = Grid(10, 4)
    st = starts(total, 10, 4)
    rows = spark.range(total + 2).select(F.col("id").alias("f"), g.resume(F.lit(total).cast("long"), F.col("id")).alias("p")).collect()
    for r in rows:
        if r.f >= total:
            assert (r.p.first, r.p.prime_from, r.p.keep_frames) == (len(st), len(st), total)
            continue
        j = max(k for k, s in enumerate(st) if s <= r.f)
        prime = j
        while prime and st[prime - 1] + min(10, total - st[prime - 1]) > st[j]:
            prime -= 1
        assert (r.p.first, r.p.prime_from, r.p.keep_frames) == (j, prime, st[j])
        assert j - prime <= 2


def test_no_nested_loop_in_the_flagship(spark):
    from tests.conftest import SF
    from wavelane.plans.catalog import QUERIES

    plan = QUERIES["stems_quantised"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_positions_over_buckets(spark):
    df = spark.createDataFrame([("a", k * 7 % 50) for k in range(50)] + [("b", 3)], "t string, o int")
    got = positions(df, ["t"], ["o"], F.floor(F.col("o") / 6)).collect()
    assert all(r.pos == r.o and r.total == 50 for r in got if r.t == "a")
    assert [(r.pos, r.total) for r in got if r.t == "b"] == [(0, 1)]
