"""Queries that run models, model graphs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import admission, modelgraph, modelweights, network, overlap
from ..sources import files
from ..sources.sidecar import Job
from ..streaming import separate
from .grid import Grid
from .registry import GRID, events_signal, ordered_stems, query, r6

SMALL = network.Shape(bands=6, n_fft=64, hop=16, dim=8, heads=2, head_dim=4, depth=2, mult=2)


@query()
def network_stems(spark, sf_dir):
    """Stems by a small band-split transformer with fixed random weights."""
    weights = SMALL.random()

    def make():
        return network.NetworkSeparator(network.Network(SMALL, weights), GRID.win)

    out = overlap.stems(events_signal(spark, sf_dir), GRID, make, ["track"])
    return out.select("track", "pos", *[r6(F.col(p)).alias(p) for p in overlap.PARTS])


def _ld(number: int, payload: bytes) -> bytes:
    return modelgraph.varint(number << 3 | 2) + modelgraph.varint(len(payload)) + payload


def _vi(number: int, v: int) -> bytes:
    return modelgraph.varint(number << 3) + modelgraph.varint(v)


def sample_graph(window: int) -> bytes:
    """A graph of two constants, an input, an output and a table, which carry the window."""

    def constant(name: str, values: list[int]) -> bytes:
        tensor = _ld(1, modelgraph.varint(len(values))) + _vi(2, 7) + _ld(9, b"".join(v.to_bytes(8, "little") for v in values))
        return _ld(3, name.encode()) + _ld(4, b"Constant") + _ld(5, _ld(1, b"value") + _ld(5, tensor) + _vi(20, 4))

    def end(name: str) -> bytes:
        return _ld(1, name.encode()) + _ld(2, _ld(1, _vi(1, 1) + _ld(2, b"".join(_ld(1, _vi(1, d)) for d in (1, 2, window)))))

    table = _ld(1, modelgraph.varint(window + modelgraph.N_FFT)) + _vi(2, 1) + _ld(8, b"window_sum_inv")
    graph = _ld(1, constant("/a", [2, window])) + _ld(1, constant("/b", [window])) + _ld(5, table) + _ld(11, end("mix")) + _ld(12, end("sources"))
    return _vi(1, 9) + _ld(7, graph)


@query("""
WITH w AS (SELECT o_orderkey AS k, (300000 // 441 - o_orderkey % 100) * 441 AS w FROM orders)
SELECT k, CAST(w AS BIGINT) AS "window", CAST(w AS BIGINT) AS capacity, CAST(2 AS BIGINT) AS nodes, CAST(4 AS BIGINT) AS sites, CAST((w // 882) * 441 AS BIGINT) AS patched FROM w""")
def graph_windows(spark, sf_dir):
    """Graphs in a table are inspected and patched to half their window."""
    from .registry import load

    k = F.col("o_orderkey")
    rows = load(spark, sf_dir, "orders").select(k.alias("k"), ((F.floor(F.lit(300000) / 441) - k % 100) * 441).alias("w"))

    def go(batches):
        for pdf in batches:
            out = []
            for key, w in zip(pdf.k, pdf.w, strict=True):
                raw = sample_graph(int(w))
                r = modelgraph.inspect(raw)
                _, after = modelgraph.patch_window(raw, w // 882 * 441)
                out.append((key, r.window, r.capacity, r.nodes, len(r.sites), after.window))
            yield type(pdf)(out, columns=["k", "window", "capacity", "nodes", "sites", "patched"])

    return rows.mapInPandas(go, "k long, window long, capacity long, nodes long, sites long, patched long")


@query("""
WITH w AS (SELECT o_orderkey AS k, (300000 // 441 - o_orderkey % 100) * 441 AS w FROM orders)
SELECT k, CAST(w AS BIGINT) AS "window", CAST((w // 1323) * 441 AS BIGINT) AS resized, CAST(4 AS BIGINT) AS sites, true AS same_after_return FROM w""")
def resized_graphs(spark, sf_dir):
    """Graphs get a third of their window by value, and their own again."""
    from .registry import load

    k = F.col("o_orderkey")
    rows = load(spark, sf_dir, "orders").select(k.alias("k"), ((F.floor(F.lit(300000) / 441) - k % 100) * 441).alias("window"))

    def go(batches):
        for pdf in batches:
            out = []
            for w in pdf.window:
                raw, target = sample_graph(int(w)), int(w) // 1323 * 441
                after = modelgraph.inspect(modelweights.resize(raw, target))
                out.append((w, after.window, len(after.sites), modelweights.round_trip(raw, target)))
            yield type(pdf)(out, columns=["window", "resized", "sites", "same_after_return"])

    # A graph a window, of which there are 100.
    graphs = rows.select("window").distinct().mapInPandas(go, "window long, resized long, sites long, same_after_return boolean")
    return rows.join(F.broadcast(graphs), "window").select("k", "window", "resized", "sites", "same_after_return")


@query("""SELECT * FROM (SELECT 1 AS field, 0 AS wire, CAST(count(*) AS INTEGER) AS n FROM orders UNION ALL SELECT 7, 2, CAST(count(*) AS INTEGER) FROM orders)""")
def graph_fields(spark, sf_dir):
    """The outermost fields of serialised models, one for each order's window, as a table function."""
    from .registry import load

    df = load(spark, sf_dir, "orders").select(((F.col("o_orderkey") % 800 + 1) * 441).alias("window"))

    def go(batches):
        for pdf in batches:
            found = [x[:2] for w in pdf.window for x in modelgraph.scan(sample_graph(int(w)))]
            yield type(pdf)(found, columns=["field", "wire"])

    return df.mapInPandas(go, "field int, wire int").groupBy("field", "wire").agg(F.count("*").cast("int").alias("n"))


@query()
def memory_snapshot(spark, sf_dir):
    """This machine's counters, and the ceiling they give."""
    return admission.snapshot_frame(spark).withColumn("ceiling", admission.ceiling())


@query(ordered_stems(500, 150))
def streamed_stems(spark, sf_dir):
    """Stems by a stream of window files, stopped once and resumed from its checkpoint."""
    grid = Grid(500, 150)
    folder = files.shared_folder(spark, "stream")
    frames = events_signal(spark, sf_dir)
    sched = grid.schedule(frames.select("track", "total").distinct(), "total", "track").select("track", "win_id", "next_start")
    wins = overlap.windows(frames, grid, ["track"]).withColumn("win_id", F.col("win_id").cast("int")).join(sched, ["track", "win_id"])
    wins = wins.select("track", "win_id", "start", "next_start", "is_first", "is_last", *[F.col(c).cast("array<float>").alias(c) for c in "lr"])
    separate.stage_windows(wins, f"{folder}/windows")
    n = sched.agg(F.coalesce(F.max("win_id") + 1, F.lit(0))).first()[0]
    job = Job(1, frames.count(), n, grid.win, grid.overlap, 0, 0, 0, 0)
    for most in (2, None):
        separate.run(spark, f"{folder}/windows", f"{folder}/run", job, lambda: overlap.ScaledMix(grid.win), grid, most_batches=most)
    out = spark.read.schema(separate.OUTPUT).parquet(f"{folder}/run/out")
    return out.select("track", "pos", *[F.col(p).cast("double").alias(p) for p in overlap.PARTS])
