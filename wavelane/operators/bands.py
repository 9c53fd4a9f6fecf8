"""Mel bands over FFT bins, as a bridge table of bands and bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.signal import hz_to_mel, mel_to_hz

BANDS, BINS, NYQUIST = 60, 1025, 22050.0


def band_bins(spark: SparkSession, bands: int = BANDS, bins: int = BINS, nyquist: float = NYQUIST) -> DataFrame:
    """(band, bin): triangles of the mel scale that hold the bin; both ends are forced in."""
    top = hz_to_mel(F.lit(nyquist))
    edge = spark.range(bands + 2).select(F.col("id").cast("int").alias("e"), mel_to_hz(F.when(F.col("id") == bands + 1, top).otherwise(top / (bands + 1) * F.col("id"))).alias("hz"))
    by = Window.orderBy("e")  # bands + 2 rows
    tri = edge.select(F.col("e").alias("band"), F.col("hz").alias("lo"), F.lead("hz").over(by).alias("mid"), F.lead("hz", 2).over(by).alias("hi")).filter("hi IS NOT NULL")
    bin_ = spark.range(bins).select(F.col("id").cast("int").alias("bin"), F.when(F.col("id") == bins - 1, F.lit(nyquist)).otherwise(nyquist / (bins - 1) * F.col("id")).alias("f"))
    held = tri.join(F.broadcast(bin_), F.least((F.col("f") - F.col("lo")) / (F.col("mid") - F.col("lo")), (F.col("hi") - F.col("f")) / (F.col("hi") - F.col("mid"))) > 0).select("band", "bin")
    ends = spark.createDataFrame([(0, 0), (bands - 1, bins - 1)], "band int, bin int")
    return held.union(ends).distinct()


def band_sizes(bridge: DataFrame) -> DataFrame:
    """(band, n_bins, dim_in, feature_start): four features a bin, bands one after the other."""
    sizes = bridge.groupBy("band").agg(F.count("*").alias("n_bins"))
    before = F.sum("n_bins").over(Window.orderBy("band")) - F.col("n_bins")  # one row a band
    return sizes.select("band", "n_bins", (F.col("n_bins") * 4).alias("dim_in"), (before * 4).alias("feature_start"))


def bands_per_bin(bridge: DataFrame) -> DataFrame:
    return bridge.groupBy("bin").agg(F.count("*").alias("n_bands"))


def gather(features: DataFrame, bridge: DataFrame) -> DataFrame:
    """features (frame, bin, ch, ri, v) once for each band that holds the bin."""
    return features.join(F.broadcast(bridge), "bin")


def scatter_average(masks: DataFrame, bridge: DataFrame) -> DataFrame:
    """masks (frame, band, bin, ch, ri, v) summed by bin over the number of its bands."""
    sums = masks.groupBy("frame", "bin", "ch", "ri").agg(F.sum("v").alias("v"))
    return sums.join(F.broadcast(bands_per_bin(bridge)), "bin").select("frame", "bin", "ch", "ri", (F.col("v") / F.greatest(F.col("n_bands").cast("double"), F.lit(1e-8))).alias("v"))
