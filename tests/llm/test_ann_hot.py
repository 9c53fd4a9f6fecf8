"""Neighbours inside a large group of near and of scaled copies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelane.llm import additive_quant as A


@pytest.mark.parametrize("jitter", [0.02, 0.0])
def test_neighbours_in_a_hot_group(spark, jitter):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 32))
    hot = np.arange(6000) % 3 == 0
    x[hot] = x[0] / np.linalg.norm(x[0]) + rng.normal(0, jitter, (hot.sum(), 32))
    x[hot] *= 2.0 ** rng.integers(-3, 4, hot.sum())[:, None]  # exact scaling: copies tie exactly
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in A.search(df, F.col("id") % 50 == 0, rerank=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(got) == 120
    for i, own in got.items():
        c = np.round(u @ u[i], 12)
        c[i] = -9
        assert own == np.lexsort((np.arange(6000), -c))[:5].tolist()
