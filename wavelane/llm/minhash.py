"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A document's set of word shingles gets a signature of `CHUNKS` x 4 symbols of 16
bits, each the low bits of one minimum hash. Signatures within distance
`CHUNKS * 2 - 1` differ in at most one symbol of some chunk (pigeonhole), so each
chunk is looked up with every allowed error: one key a symbol left out. All pairs
under that distance share a key. A pair lies beyond it with a chance of about
2e-8 at similarity 0.85, and 1.1e-6 at 0.8; nothing else is approximate.

Rows with equal sets are one node from the start, with a number of its own. In a
key's bucket every node is first compared with the bucket's most central node (that
which shares most keys with most nodes); what links up becomes one component. Around
a centre only pairs across components remain, and those are all compared on their
full sets, in blocks of bounded size that give links only. So no link between
different texts is lost, and where near copies link up with their centre, each costs
about one comparison. Nodes around a centre that don't link with it cost a comparison
with each of its nodes, in tasks of bounded size.

Keys, centres, components and groups of copies that have very many rows are dealt
over many tasks (`common.spread_join`).

Defined results: null texts and texts without words have an empty set, link with
nothing and are their own component. A document of fewer words than a shingle has
its whole sequence as one shingle. Rows that repeat a doc_id are judged row by row,
each by its own text. A row whose id is null links like others but never names a
component; one of such rows alone has a null name. Empty tables give empty results.
Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import vectext as V
from .common import drop_dir, shared_dir, spread_join, stored, table
from .components import components

CHUNKS = 8
SYMBOLS = 4 * CHUNKS
#: A node whose signature differs from its centre's in more symbols isn't compared with it at first, but like all that don't link with it.
DISTANCE = 18
#: Nodes around a centre in one block of the exhaustive comparison.
BLOCK = 512

_TABLE = V.byte_table(V.SPACES, lower=True)
_MULT = V.mix(np.arange(SYMBOLS, dtype=V.U) + V.U(0x3157)) | V.U(1)
_XOR = V.mix(np.arange(SYMBOLS, dtype=V.U) + V.U(0x8A11))


def shingle_sets(part: pa.RecordBatch, text: str, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    buf, off = V.utf8(part.column(text))
    w = V.Words(buf, off, _TABLE)
    h, inside = w.windows(size), w.inside(size)
    short = {k: V.window_hash(w.hash, k) for k in range(1, size)}
    out = []
    for i in range(w.docs):
        a, e = int(w.ptr[i]), int(w.ptr[i + 1])
        if e - a >= size:
            out.append(np.unique(h[a : e - size + 1]))
        elif e > a:
            out.append(V.mix(short[e - a][a : a + 1] + V.U(e - a)))
        else:
            out.append(np.zeros(0, V.U))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16-bit symbols of each non-empty set, one row a set."""
    flat = np.concatenate(sets)
    first = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), SYMBOLS), "<u2")
    for k in range(SYMBOLS):
        out[:, k] = V.mix(np.minimum.reduceat((flat ^ _XOR[k]) * _MULT[k], first)) & V.U(0xFFFF)
    return out


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """The SYMBOLS lookup keys of each signature: its chunks with one symbol left out."""
    chunks = np.ascontiguousarray(sig).view("<u8")
    keys = np.empty((len(sig), SYMBOLS), V.U)
    for c in range(CHUNKS):
        for s in range(4):
            keys[:, 4 * c + s] = V.mix((chunks[:, c] & ~V.U(0xFFFF << 16 * s)) ^ V.mix(np.array([4 * c + s], V.U)))
    return keys


def _identity(s: np.ndarray) -> tuple[int, int]:
    """128-bit hash of a set."""
    return int(V.mix(s).sum().view(np.int64)), int(V.mix(s ^ V.U(0x77)).sum().view(np.int64))


def sketch(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(doc_id, th, n, h1, h2, sig) of each row: its text's hash, its set's size, 128-bit hash and signature."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("th", T.LongType()), T.StructField("n", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("sig", T.BinaryType())])

    def go(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for part in V.slices(batch, text):
                sets = shingle_sets(part, text, size)
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full)) if full else iter(())
                rows = [(len(s), *_identity(s), next(sig).tobytes()) if len(s) else (0, 0, 0, None) for s in sets]
                cols = [part.column(doc_id), part.column("__th")] + [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(arrow)[2:], strict=True)]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return docs.select(doc_id, text, F.xxhash64(text).alias("__th")).mapInArrow(go, schema)


def _node_keys(nodes: DataFrame) -> DataFrame:
    schema = T.StructType.fromDDL("key long, node long")

    def go(batches):
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(-1, SYMBOLS)
                yield pa.RecordBatch.from_arrays([pa.array(V.signed(chunk_keys(sig)).ravel()), pa.array(np.repeat(batch.column("node").to_numpy(), SYMBOLS))], names=["key", "node"])

    return nodes.select("node", "sig").mapInArrow(go, schema)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=-1)


def _near(stars: DataFrame, nodes: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Pairs (u, v) of a centre and a node around it that sizes and signatures allow; stars: stored."""
    u, v = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"s_{x}")) for x in "uv")
    both = spread_join(stars, u, ["u"], ["v"]).join(v, "v").filter(least[1] * F.least("n_u", "n_v") >= least[0] * F.greatest("n_u", "n_v"))

    def go(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, SYMBOLS) for c in ("s_u", "s_v"))
                yield batch.filter(pa.array(_distance(a, b) <= DISTANCE)).select(["u", "v"])

    return both.select("u", "v", "s_u", "s_v").mapInArrow(go, T.StructType.fromDDL("u long, v long"))


def _linked(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Pairs whose full sets are similar enough; pairs: stored."""
    u, v = (sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")) for x in "uv")

    def go(batches):
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("set_u"), batch.column("set_v"), strict=True):
                a, b = np.frombuffer(a.as_buffer(), V.U), np.frombuffer(b.as_buffer(), V.U)
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(least[1] * both >= least[0] * (len(a) + len(b) - both))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["u", "v"])

    return spread_join(pairs, u, ["u"], ["v"]).join(v, "v").select("u", "v", "set_u", "set_v").mapInArrow(go, pairs.schema)


def _across(rows: DataFrame, least: tuple[int, int]) -> DataFrame:
    """All links across components among the nodes around one centre.

    rows: rep (the centre), node, set, component, main (the centre's component),
    c (nodes around it), o (those outside its component). They are dealt into
    blocks: all nodes by x, those outside by y. A block counts the common shingles
    of one y with all its x at once and gives only what links.
    """
    own = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    rows = rows.withColumn("nx", F.ceil(F.col("c") / BLOCK).cast("int")).withColumn("ny", F.ceil(F.col("o") / BLOCK).cast("int"))
    base = ["rep", "node", "set", "component"]
    xs = rows.select(*base, F.lit(0).alias("side"), F.pmod(own, F.col("nx")).cast("int").alias("bx"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("by"))
    ys = rows.filter("component <> main").select(*base, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("bx"), F.pmod(own, F.col("ny")).cast("int").alias("by"))
    dealt = xs.union(ys).repartition("rep", "bx", "by").sortWithinPartitions("rep", "bx", "by")
    schema = T.StructType.fromDDL("u long, v long")

    def links(g: pa.Table):
        sets = [np.frombuffer(b, V.U) for b in g.column("set").to_pylist()]
        node, comp, side = (g.column(c).to_numpy() for c in ("node", "component", "side"))
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(x) or not len(y):
            return
        size = np.array([len(s) for s in sets])
        ids = np.unique(np.concatenate([sets[j] for j in y]))
        flat = np.concatenate([sets[i] for i in x])
        at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        at[ids[at] != flat] = len(ids)
        first = np.cumsum(np.append(0, size[x][:-1]))
        mark = np.zeros(len(ids) + 1, np.int64)
        for j in y:
            spot = np.searchsorted(ids, sets[j])
            mark[spot] = 1
            both = np.add.reduceat(mark[at], first)
            mark[spot] = 0
            near = (comp[x] != comp[j]) & (least[1] * both >= least[0] * (size[x] + size[j] - both))
            for i in x[near]:
                yield int(node[i]), int(node[j])

    def go(batches):
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            if held is not None:
                now = pa.concat_tables([held, now])
            if not now.num_rows:
                continue
            ids = np.stack([now.column(c).to_numpy().astype(np.int64) for c in ("rep", "bx", "by")])
            cut = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
            found = [p for a, b in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=False) for p in links(now.slice(a, b - a))]
            held = now.slice(int(cut[-1]) if len(cut) else 0)
            yield from made(found)
        if held is not None and held.num_rows:
            yield from made(list(links(held)))

    def made(found):
        if found:
            u, v = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return dealt.mapInArrow(go, schema)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, least: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row a row of docs: doc_id, n_shingles, component_id.

    Links sets with least[1] * |intersection| >= least[0] * |union|.
    """
    x = F.col("first")
    return _grouped(docs, doc_id, text, shingle, least).select("doc_id", F.col("n").alias("n_shingles"), x.doc_id.alias("component_id"))


def keep_representatives(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, least: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs with one document of each group only, that of smallest doc_id; all columns stay.

    Where rows share it, that of least hash of its text; rows without id come last.
    Rows that repeat both id and text are one document.
    """
    x = F.col("first")
    other = ~(F.col("doc_id").eqNullSafe(x.doc_id) & (F.col("th") == x.th))
    gone = _grouped(docs, doc_id, text, shingle, least).filter(other).select(F.col("doc_id").alias("__gone"), F.col("th").alias("__th")).distinct()
    return docs.join(gone, docs[doc_id].eqNullSafe(gone["__gone"]) & (F.xxhash64(docs[text]) == gone["__th"]), "left_anti")


def _grouped(docs: DataFrame, doc_id: str, text: str, shingle: int, least: tuple[int, int]) -> DataFrame:
    """(doc_id, th, n, first) of each row; first: nameless, doc_id and th of the first row of its component."""
    spark = docs.sparkSession
    folder = shared_dir(spark)

    def keep(df: DataFrame, name: str) -> DataFrame:
        return stored(df, f"{folder}/{name}")

    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "th")
    sketches = keep(sketch(docs, doc_id, text, shingle), "sketches")
    classes = sketches.filter("n > 0").groupBy("h1", "h2").agg(F.min(row).alias("first"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbers are fixed once written
    nodes = classes.select("node", "n", "sig")

    keys = keep(_node_keys(nodes), "keys")
    shared = keep(keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "shared")
    sizes = shared.select("key", F.col("c").alias("n"))
    buckets = keep(spread_join(keys, shared, ["key"], ["node"], counts=sizes), "buckets")
    weight = keep(buckets.groupBy("node").agg(F.sum("c").alias("w")), "weights")
    centre = buckets.join(weight, "node").groupBy("key").agg((-F.max(F.struct("w", (-F.col("node")).alias("node")))["node"]).alias("rep"))
    stars = spread_join(buckets.select("key", "node"), centre, ["key"], ["node"], counts=sizes).filter("node <> rep")
    stars = keep(stars.select(F.col("rep").alias("u"), F.col("node").alias("v")).distinct(), "stars")
    drop_dir(spark, f"{folder}/keys", f"{folder}/shared", f"{folder}/buckets")

    sets = keep(_sets(docs, weight.join(classes, "node").select("node", "h1", "h2", "first"), doc_id, text, shingle), "sets")
    near = keep(_near(stars, nodes, least), "near")
    first = keep(_linked(near, sets, least), "links-1")
    label = nodes.select("node").join(components(first, f"{folder}/c1"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    main = label.select(F.col("node").alias("rep"), F.col("component").alias("main"))
    around = stars.select(F.col("u").alias("rep"), F.col("v").alias("node")).join(label, "node")
    around = keep(spread_join(around, main, ["rep"], ["node"], counts=stars.groupBy(F.col("u").alias("rep")).agg(F.count("*").alias("n")), total=stars.count()).select("rep", "node", "component", "main"), "around")
    open_ = around.groupBy("rep").agg((F.count("*") + 1).alias("c"), F.count_if(F.col("component") != F.col("main")).alias("o"), F.first("main").alias("m")).filter("o > 0")
    open_ = keep(open_, "open")
    own = open_.select("rep", F.col("rep").alias("node"), F.col("m").alias("component"), F.col("m").alias("main"))
    around = around.unionAll(own)
    around = spread_join(around, open_.drop("m"), ["rep"], ["node"], counts=open_.select("rep", F.col("c").alias("n")), total=open_.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    second = keep(_across(around.join(sets, "node"), least), "links-2")

    joined = components(first.union(second), f"{folder}/c2")
    of = keep(classes.select("h1", "h2", "first", "rows", "node").join(joined, "node", "left").select("h1", "h2", "first", "rows", F.coalesce("component", "node").alias("component")), "of")
    names = of.groupBy("component").agg(F.min("first").alias("first"))
    named = keep(spread_join(of.drop("first"), names, ["component"], ["h1", "h2"], total=of.count()).select("h1", "h2", "rows", "first"), "named")
    drop_dir(spark, *[f"{folder}/{n}" for n in ("weights", "stars", "sets", "near", "links-1", "around", "open", "links-2", "classes", "of", "c1", "c2")])
    some = spread_join(sketches.filter("n > 0"), named.drop("rows"), ["h1", "h2"], ["doc_id"], counts=named.select("h1", "h2", F.col("rows").alias("n")), total=sketches.count())
    return some.select("doc_id", "th", "n", "first").unionAll(sketches.filter("n = 0").select("doc_id", "th", "n", row.alias("first")))


def _sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(node, set) with the sorted shingle hashes as bytes; wanted: node, h1, h2, first (a row that has the set)."""
    schema = T.StructType.fromDDL("h1 long, h2 long, set binary")
    rows = wanted.select(F.col("first.doc_id").alias("__id"), F.col("first.th").alias("__th"))
    docs = docs.select(doc_id, text).join(rows, docs[doc_id].eqNullSafe(rows["__id"]) & (F.xxhash64(docs[text]) == rows["__th"]), "left_semi")

    def go(batches):
        for batch in batches:
            for part in V.slices(batch, text):
                sets = [s for s in shingle_sets(part, text, size) if len(s)]
                h = [_identity(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in h], pa.int64()), pa.array([x[1] for x in h], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=schema.names)

    return docs.select(text).mapInArrow(go, schema).dropDuplicates(["h1", "h2"]).join(wanted, ["h1", "h2"]).select("node", "set")


def op7_minhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, least=(85, 100))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
