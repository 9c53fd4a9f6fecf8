"""Connected components of a link table, by alternating large and small stars.

Every step is a min per node (partially aggregated) and a join whose one side has
a row a node; the links of a node that has very many are dealt over many tasks
(`common.spread_join`). Rounds go on until nothing changes, which takes about the
square of the logarithm of the nodes at most. Each round is written to the shared
folder; the driver sees two numbers a round, and the busiest nodes.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_dir, spread_join, stored


def components(links: DataFrame, folder: str, a: str = "u", b: str = "v") -> DataFrame:
    """(node, component) of all nodes with links; the component is its least node."""
    spark = links.sparkSession

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("hi", "lo"), F.lit(1 << 40)))).first())

    edges = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct()
    edges, old = stored(edges, f"{folder}/edges-0"), f"{folder}/edges-0"
    last = state(edges)
    for k in itertools.count(1):
        down = edges.groupBy(F.col("hi").alias("n")).agg(F.min("lo").alias("r"))
        up = edges.select(F.col("lo").alias("n"), F.col("hi").alias("m"))
        least = up.select("n").distinct().join(down, "n", "left").select("n", F.least("n", "r").alias("r"))
        large = spread_join(up, least, ["n"], ["m"], total=last[0]).select(F.col("m").alias("hi"), F.col("r").alias("lo")).distinct()
        large = stored(large, f"{folder}/large-{k}")
        least = large.groupBy("hi").agg(F.min("lo").alias("r"))
        pairs = spread_join(large, least, ["hi"], ["lo"], total=last[0])
        small = pairs.select(F.explode(F.array(F.struct("hi", F.col("r").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("r").alias("lo")))).alias("e")).select("e.*")
        edges = stored(small.filter("hi <> lo").distinct(), f"{folder}/edges-{k}")
        now = state(edges)
        drop_dir(spark, old, f"{folder}/large-{k}")
        old = f"{folder}/edges-{k}"
        if now == last:
            break
        last = now
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
