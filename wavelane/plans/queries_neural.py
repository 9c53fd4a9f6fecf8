"""Queries on the network's layers, over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import neural as N
from ..operators import weights as W_
from .grid import positions
from .registry import load, query, r6

PI = "3.141592653589793::DOUBLE"


def vectors(spark, sf_dir):
    """vec_id, label, x (double)."""
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def long_form(df, column, name="v"):
    return df.select("vec_id", F.posexplode(column).alias("i", name)).select("vec_id", F.col("i").cast("long").alias("i"), r6(F.col(name)).alias(name))


E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"
X = E + ", x AS (SELECT vec_id, label, i - 1 AS i, x[i] AS v FROM (SELECT vec_id, label, x, unnest(range(1, len(x) + 1)) AS i FROM e))"
W = "WITH "


@query(W + X + ", n AS (SELECT vec_id, sqrt(sum(v * v)) AS n, count(*) AS d FROM x GROUP BY vec_id) SELECT vec_id, i, round(v / greatest(n, 1e-12) * sqrt(d::DOUBLE) * (0.5::DOUBLE + i / 64.0::DOUBLE), 6) + 0.0 AS v FROM x JOIN n USING (vec_id)")
def l2_norm(spark, sf_dir):
    """Normalised vectors times a weight that rises with the place."""
    weight = F.transform(F.sequence(F.lit(0), F.size("x") - 1), lambda i: 0.5 + i / 64.0)
    return long_form(vectors(spark, sf_dir).withColumn("y", N.l2_normalise(F.col("x"), weight)), "y")


ERF = "sign({z}) * (1 - ((((1.061405429::DOUBLE * {t} + -1.453152027::DOUBLE) * {t} + 1.421413741::DOUBLE) * {t} + -0.284496736::DOUBLE) * {t} + 0.254829592::DOUBLE) * {t} * exp(-{z} * {z}))"


@query(W + X + ", z AS (SELECT vec_id, i, v * 4 AS v, v * 4 / sqrt(2.0::DOUBLE) AS z FROM x), t AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(z)) AS t FROM z) SELECT vec_id, i, round(0.5::DOUBLE * v * (1 + " + ERF.format(z="z", t="t") + "), 6) + 0.0 AS gelu, round(1 / (1 + exp(-v)), 6) + 0.0 AS sigmoid, round((exp(2 * v) - 1) / (exp(2 * v) + 1), 6) + 0.0 AS tanh FROM t")
def activations(spark, sf_dir):
    """GELU by erf, sigmoid and tanh of each component."""
    rows = vectors(spark, sf_dir).select("vec_id", F.posexplode("x").alias("i", "v")).withColumn("v", F.col("v") * 4)
    v = F.col("v")
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), r6(N.gelu(v)).alias("gelu"), r6(N.sigmoid(v)).alias("sigmoid"), r6(F.tanh(v)).alias("tanh"))


@query(W + X + " SELECT a.vec_id, a.i, round(a.v / (1 + exp(-b.v)), 6) + 0.0 AS v FROM x a JOIN x b ON a.vec_id = b.vec_id AND b.i = a.i + 32 WHERE a.i < 32")
def glu(spark, sf_dir):
    """First half gated by the second."""
    return long_form(vectors(spark, sf_dir).withColumn("y", N.glu(F.col("x"))), "y")


@query(W + X + """, p AS (SELECT vec_id, i, v, row_number() OVER (PARTITION BY label, i ORDER BY vec_id) - 1 AS place FROM x),
t AS (SELECT a.vec_id, a.i, a.v, b.v AS o, a.place / pow(10000.0::DOUBLE, 2.0::DOUBLE * (a.i // 2) / 64) AS th FROM p a JOIN p b ON a.vec_id = b.vec_id AND b.i = CASE WHEN a.i % 2 = 0 THEN a.i + 1 ELSE a.i - 1 END)
SELECT vec_id, i, round(v * cos(th) + CASE WHEN i % 2 = 0 THEN -o ELSE o END * sin(th), 6) + 0.0 AS v FROM t""")
def rope(spark, sf_dir):
    """Rotary positions; a vector's place is its rank within its label."""
    placed = positions(vectors(spark, sf_dir), ["label"], ["vec_id"], F.floor(F.col("vec_id") / 4096))
    return long_form(placed.withColumn("y", N.rope(F.col("x"), F.col("pos").cast("double"))), "y")


@query(W + X + ", m AS (SELECT vec_id, max(v) AS m FROM x GROUP BY vec_id), s AS (SELECT vec_id, sum(exp(v - m)) AS s FROM x JOIN m USING (vec_id) GROUP BY vec_id) SELECT vec_id, i, round(exp(v - m) / s, 6) + 0.0 AS v FROM x JOIN m USING (vec_id) JOIN s USING (vec_id)")
def softmax(spark, sf_dir):
    """shares of each component."""
    return long_form(vectors(spark, sf_dir).withColumn("y", N.softmax(F.col("x"))), "y")


@query(W + X + """, q AS (SELECT vec_id, vec_id // 25 AS s, i, v FROM x),
sc AS (SELECT a.s, a.vec_id AS qi, b.vec_id AS ki, sum(a.v * b.v) / 8 AS d FROM q a JOIN q b ON a.s = b.s AND a.i = b.i GROUP BY ALL),
ex AS (SELECT s, qi, ki, exp(d - max(d) OVER (PARTITION BY qi)) AS e FROM sc), w AS (SELECT s, qi, ki, e / sum(e) OVER (PARTITION BY qi) AS p FROM ex)
SELECT qi AS vec_id, q.i, round(sum(p * q.v), 6) + 0.0 AS v FROM w JOIN q ON q.vec_id = w.ki GROUP BY qi, q.i""")
def attention_head(spark, sf_dir):
    """K5, E5 for one head: 25 vectors are a sequence; scores, softmax and mix by joins of bounded groups."""
    v = vectors(spark, sf_dir).select("vec_id", F.floor(F.col("vec_id") / 25).alias("s"), "x")
    keys = v.select("s", F.struct(F.col("vec_id").alias("k"), F.col("x").alias("y")).alias("kv")).groupBy("s").agg(F.array_sort(F.collect_list("kv")).alias("kvs"))
    both = v.join(keys, "s").withColumn("d", F.transform("kvs", lambda kv: N.dot(F.col("x"), kv["y"]) / 8))
    p = N.softmax(F.col("d"))
    mixed = F.aggregate(F.zip_with(p, F.col("kvs"), lambda a, kv: F.transform(kv["y"], lambda y: a * y)), F.array_repeat(F.lit(0.0), 64), lambda s, y: F.zip_with(s, y, lambda a, b: a + b))
    return long_form(both.withColumn("y", mixed), "y")


WEIGHT = "(((i * 7 + o * 13) % 11) - 5) / 10.0::DOUBLE"


def weights(outputs, inputs):
    """A literal, which the optimizer folds once."""
    return F.lit([[((i * 7 + o * 13) % 11 - 5) / 10.0 for i in range(inputs)] for o in range(outputs)])


@query(W + X + f", o AS (SELECT unnest(range(0, 12)) AS o) SELECT vec_id, o AS i, round(sum(v * {WEIGHT}) + o / 10.0::DOUBLE, 6) + 0.0 AS v FROM x, o GROUP BY vec_id, o")
def linear_layer(spark, sf_dir):
    """E5, K4: vectors times a fixed weight matrix, plus bias."""
    bias = F.lit([o / 10.0 for o in range(12)])
    return long_form(vectors(spark, sf_dir).withColumn("y", N.linear(F.col("x"), weights(12, 64), bias)), "y")


@query(W + X + f""", o AS (SELECT unnest(range(0, 12)) AS o), h AS (SELECT vec_id, o, sum(v * {WEIGHT}) AS z0 FROM x, o GROUP BY vec_id, o),
g AS (SELECT vec_id, o AS i, z0, z0 / sqrt(2.0::DOUBLE) AS z, 1 / (1 + 0.3275911::DOUBLE * abs(z0 / sqrt(2.0::DOUBLE))) AS t FROM h),
a AS (SELECT vec_id, i, 0.5::DOUBLE * z0 * (1 + {ERF.format(z='z', t='t')}) AS v FROM g), p AS (SELECT unnest(range(0, 5)) AS o)
SELECT vec_id, o AS i, round(sum(v * {WEIGHT}), 6) + 0.0 AS v FROM a, p GROUP BY vec_id, o""")
def feed_forward(spark, sf_dir):
    """K6: two linear layers with GELU between."""
    h = vectors(spark, sf_dir).withColumn("h", N.linear(F.col("x"), weights(12, 64)))
    h = h.withColumn("a", F.transform("h", lambda v: N.gelu(v)))
    return long_form(h.withColumn("y", N.linear(F.col("a"), weights(5, 12))), "y")


@query(W + X + f""", o AS (SELECT unnest(range(0, 12)) AS o), h AS (SELECT vec_id, o AS i, (exp(2 * sum(v * {WEIGHT})) - 1) / (exp(2 * sum(v * {WEIGHT})) + 1) AS v FROM x, o GROUP BY vec_id, o),
p AS (SELECT unnest(range(0, 8)) AS o), y AS (SELECT vec_id, o, sum(v * {WEIGHT}) AS v FROM h, p GROUP BY vec_id, o)
SELECT a.vec_id, a.o AS i, round(a.v / (1 + exp(-b.v)), 6) + 0.0 AS v FROM y a JOIN y b ON a.vec_id = b.vec_id AND b.o = a.o + 4 WHERE a.o < 4""")
def mask_mlp(spark, sf_dir):
    """K9 in small: linear layers with tanh between, gated at the end."""
    h = vectors(spark, sf_dir).withColumn("h", F.transform(N.linear(F.col("x"), weights(12, 64)), lambda v: F.tanh(v)))
    return long_form(h.withColumn("y", N.glu(N.linear(F.col("h"), weights(8, 12)))), "y")


@query(W + X + " SELECT label, i, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(sqrt(sum(v * v)), 6) + 0.0 AS norm FROM x GROUP BY label, i")
def component_statistics(spark, sf_dir):
    """sums of squares by label and component."""
    rows = vectors(spark, sf_dir).select("label", F.posexplode("x").alias("i", "v"))
    return rows.groupBy("label", "i").agg(F.count("*").alias("n"), r6(F.avg("v")).alias("mean"), r6(F.sqrt(F.sum(F.col("v") * F.col("v")))).alias("norm")).withColumn("i", F.col("i").cast("long"))


@query(W + X + """, r AS (SELECT vec_id // 25 AS key, i, v, row_number() OVER (PARTITION BY vec_id // 25, i ORDER BY vec_id) - 1 AS nth, count(*) OVER (PARTITION BY vec_id // 25, i) AS n FROM x)
SELECT CAST(key AS VARCHAR) AS key, CAST(n AS INTEGER) AS columns, CAST(i * n + nth AS BIGINT) AS place, round(v, 6) + 0.0 AS v FROM r""")
def transposed(spark, sf_dir):
    """25 vectors are a tensor of rank 2; its rows and columns swapped, value by value."""
    rows = vectors(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 25).cast("string").alias("key")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("m"))
    tensors = rows.select("key", F.array(F.size("m"), F.lit(64)).alias("shape"), F.flatten(F.col("m.x")).alias("data"))
    turned = W_.transposed(tensors).select("key", F.get("shape", F.lit(1)).alias("columns"), F.posexplode("data").alias("place", "v"))
    return turned.select("key", "columns", F.col("place").cast("long").alias("place"), r6(F.col("v")).alias("v"))


@query(W + "s AS (SELECT event_type AS track, value, CASE WHEN event_id % 97 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 89 = 0 THEN 'Infinity'::DOUBLE ELSE value END AS v FROM events) SELECT track, count(*) FILTER (isfinite(v)) AS finite, count(*) FILTER (NOT isfinite(v)) AS not_finite FROM s GROUP BY track")
def finite_check(spark, sf_dir):
    """Values that aren't numbers, by track."""
    v = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).when(F.col("event_id") % 89 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    odd = F.isnan("v") | (F.abs("v") == F.lit(float("inf")))
    rows = load(spark, sf_dir, "events").select(F.col("event_type").alias("track"), v.alias("v"))
    return rows.groupBy("track").agg(F.count_if(~odd).alias("finite"), F.count_if(odd).alias("not_finite"))
