"""Names and shapes of the network's tensors, and checks of a weight file against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bands import band_bins, band_sizes

DIM, HEADS, HEAD_DIM, DEPTH, FF_MULT = 384, 8, 64, 6, 4
INNER, HIDDEN = HEADS * HEAD_DIM, FF_MULT * DIM
AXES = ("time_transformer", "freq_transformer")

#: Member of a transformer layer and its shape.
LAYER = (
    ("layers_0.attn.norm.weight", (DIM,)),
    ("layers_0.attn.to_qkv.weight", (DIM, 3 * INNER)),
    ("layers_0.attn.to_gates.weight", (DIM, HEADS)),
    ("layers_0.attn.to_gates.bias", (HEADS,)),
    ("layers_0.attn.to_out.layers.0.weight", (INNER, DIM)),
    ("layers_0.ff.net.layers.0.weight", (DIM,)),
    ("layers_0.ff.net.layers.1.weight", (DIM, HIDDEN)),
    ("layers_0.ff.net.layers.1.bias", (HIDDEN,)),
    ("layers_0.ff.net.layers.4.weight", (HIDDEN, DIM)),
    ("layers_0.ff.net.layers.4.bias", (DIM,)),
    ("norm.weight", (DIM,)),
)


def expected(spark: SparkSession) -> DataFrame:
    """(key, shape) of every tensor."""
    sizes = band_sizes(band_bins(spark)).select("band", F.col("dim_in").cast("int").alias("d"))
    band = F.col("band").cast("string")
    split = F.concat(F.lit("band_split.to_features_"), band)
    mask = F.concat(F.lit("mask_estimators_0.to_freqs_"), band, F.lit(".layers."))

    def row(name: Column, suffix: str, *shape) -> Column:
        return F.struct(F.concat(name, F.lit(suffix)).alias("key"), F.array(*[F.lit(x) if isinstance(x, int) else x for x in shape]).alias("shape"))

    d = F.col("d")
    own = F.array(
        row(split, ".norm.weight", d), row(split, ".linear.weight", d, DIM), row(split, ".linear.bias", DIM),
        row(mask, "0.weight", DIM, HIDDEN), row(mask, "0.bias", HIDDEN), row(mask, "2.weight", HIDDEN, HIDDEN),
        row(mask, "2.bias", HIDDEN), row(mask, "4.weight", HIDDEN, 2 * d), row(mask, "4.bias", 2 * d),
    )
    blocks = spark.createDataFrame([(f"layers_{i}.{axis}.{name}", list(shape)) for i in range(DEPTH) for axis in AXES for name, shape in LAYER], "key string, shape array<int>")
    return sizes.select(F.explode(own).alias("t")).select("t.key", "t.shape").union(blocks)


def check(found: DataFrame, want: DataFrame) -> DataFrame:
    """(key, fault): unknown, missing, repeated, or of another shape; found: key, shape."""
    twice = found.groupBy("key").count().filter("count > 1").select("key", F.lit("repeated").alias("fault"))
    unknown = found.join(want, "key", "left_anti").select("key", F.lit("unknown").alias("fault"))
    missing = want.join(found, "key", "left_anti").select("key", F.lit("missing").alias("fault"))
    odd = found.join(want.withColumnRenamed("shape", "want"), "key").filter(~F.col("shape").eqNullSafe(F.col("want")))
    shaped = odd.select("key", F.concat(F.lit("shape "), F.array_join(F.col("shape").cast("array<string>"), "x"), F.lit(" for "), F.array_join(F.col("want").cast("array<string>"), "x")).alias("fault"))
    return unknown.union(missing).union(shaped).union(twice).distinct()


def transposed(tensors: DataFrame) -> DataFrame:
    """(key, shape, data) with two-dimensional tensors turned from [out, in] to [in, out]."""
    # Under other names: in a lambda, a name means the select's own alias before the input's column.
    old = tensors.select("key", F.col("shape").alias("__shape"), F.col("data").alias("__data"))
    o, i = F.get("__shape", F.lit(0)), F.get("__shape", F.lit(1))
    turned = F.transform(F.sequence(F.lit(0), o * i - 1), lambda p: F.get("__data", ((p % o) * i + F.floor(p / o)).cast("int")))
    two = F.size("__shape") == 2
    return old.select("key", F.when(two, F.reverse("__shape")).otherwise(F.col("__shape")).alias("shape"), F.when(two, turned).otherwise(F.col("__data")).alias("data"))


def canonical_key(name: Column) -> Column:
    """Key of an exported parameter name; null if it lies outside the model."""
    inside = F.regexp_replace(F.regexp_replace(name, r"^model\.", ""), r"\.gamma", ".weight")

    def axis(c: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(c, r"^(layers_\d+)\.0\.", "$1.time_transformer."), r"^(layers_\d+)\.1\.", "$1.freq_transformer.")

    split = F.regexp_replace(F.regexp_replace(inside, r"^band_split\.to_features\.(\d+)\.0\.", "band_split.to_features_$1.norm."), r"^band_split\.to_features\.(\d+)\.1\.", "band_split.to_features_$1.linear.")
    layers = F.regexp_replace(split, r"^layers\.(\d+)\.([01])\.", "layers_$1.$2.")
    inner = F.regexp_replace(F.regexp_replace(layers, r"^(layers_\d+\.[01])\.layers\.(\d+)\.0\.", "$1.layers_$2.attn."), r"^(layers_\d+\.[01])\.layers\.(\d+)\.1\.", "$1.layers_$2.ff.")
    mask = F.regexp_replace(axis(inner), r"^mask_estimators\.(\d+)\.to_freqs\.(\d+)\.0\.(\d+)\.", "mask_estimators_$1.to_freqs_$2.layers.$3.")
    numbered = F.regexp_replace(F.regexp_replace(mask, r"\.net\.(\d+)\.", ".net.layers.$1."), r"\.to_out\.(\d+)\.", ".to_out.layers.$1.")
    return F.when(name.startswith("model."), numbered)


def numbered(rows: DataFrame, key: str = "key") -> DataFrame:
    """rows with n, the place of the key in order; the table is as small as the model."""
    return rows.withColumn("n", F.row_number().over(Window.orderBy(key)) - 1)
