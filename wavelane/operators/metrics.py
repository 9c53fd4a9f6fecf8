"""Comparing signals, files and timed runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def difference(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """keys, n, differing, max_abs, max_rel (where |a| > 1e-4), corr, snr_db."""
    x, y = F.col(a), F.col(b)
    e = x - y
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(x != y).alias("differing"),
        F.max(F.abs(e)).alias("max_abs"),
        F.max(F.when(F.abs(x) > 1e-4, F.abs(e) / F.abs(x))).alias("max_rel"),
        F.corr(a, b).alias("corr"),
        decibel(F.sum(x * x), F.sum(e * e)).alias("snr_db"),
    )


def decibel(signal: Column, noise: Column) -> Column:
    return F.when(noise > 0, 10 * F.log10(signal / noise))


def dbfs(x: Column) -> Column:
    """Aggregate: root mean square in decibels of full scale."""
    return F.when(F.avg(x * x) > 0, 20 * F.log10(F.sqrt(F.avg(x * x))))


def si_sdr(reference: Column, estimate: Column) -> Column:
    """Aggregate: scale-invariant signal-to-distortion ratio in decibels."""
    dot, ref, est = F.sum(reference * estimate), F.sum(reference * reference), F.sum(estimate * estimate)
    target = dot * dot / ref
    return F.when((ref > 0) & (est > target), 10 * F.log10(target / (est - target)))


def first_difference(a: DataFrame, b: DataFrame, keys: list[str], pos: str = "pos", value: str = "v") -> DataFrame:
    """keys, first_diff, n_diff over all positions of either; a position that one lacks differs."""
    both = a.select(*keys, pos, F.col(value).alias("x")).join(b.select(*keys, pos, F.col(value).alias("y")), [*keys, pos], "full_outer")
    odd = ~F.col("x").eqNullSafe(F.col("y"))
    return both.groupBy(*keys).agg(F.min(F.when(odd, F.col(pos))).alias("first_diff"), F.count_if(odd).alias("n_diff"))


VERDICTS = ("smaller than the position term", "the orders disagree", "within the scatter", "consistent across the swap")


def paired_estimate(runs: DataFrame, keys: list[str]) -> DataFrame:
    """runs: keys, label (A or B), position order (AB or BA), wall_s.

    keys, d_ab, d_ba, dd, position, scatter, verdict: the difference B - A with
    the position effect cancelled; no verdict where a run is missing.
    """

    def wall(label: str, order: str) -> Column:
        return F.max(F.when((F.col("label") == label) & (F.col("order") == order), F.col("wall_s"))).alias(f"{label}_{order}")

    r = runs.groupBy(*keys).agg(*[wall(x, o) for x in "AB" for o in ("AB", "BA")])
    d_ab, d_ba = F.col("B_AB") - F.col("A_AB"), F.col("B_BA") - F.col("A_BA")
    a, b = F.col("A_BA") - F.col("A_AB"), F.col("B_AB") - F.col("B_BA")
    r = r.select(*keys, d_ab.alias("d_ab"), d_ba.alias("d_ba"), ((d_ab + d_ba) / 2).alias("dd"), ((a + b) / 2).alias("position"), F.greatest(F.abs(a), F.abs(b)).alias("scatter"))
    agree = ~(((F.col("dd") > 0) & (F.col("d_ab") < 0)) | ((F.col("dd") < 0) & (F.col("d_ab") > 0)))
    size = F.abs("dd")
    said = F.when(size <= F.abs("position"), VERDICTS[0]).when(~agree, VERDICTS[1]).when(size < F.col("scatter"), VERDICTS[2]).when(size.isNotNull(), VERDICTS[3])
    return r.withColumn("verdict", F.when(F.col("scatter").isNotNull() & F.col("dd").isNotNull(), said))
