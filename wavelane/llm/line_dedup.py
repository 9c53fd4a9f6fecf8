"""Line dedup over levelled sorted runs of line hashes.

The index is a set of immutable runs of (128-bit key hash, owner), in buckets by
hash, sorted and without repeats; the owner is the smallest document of the first
batch that holds the line. Documents come in batches of ascending id. A batch's
distinct hashes are staged in the same buckets and merge-joined with the runs as
they lie; what the runs lack becomes a run of level 0, and as soon as a level has
`FANOUT` runs they are merged into one run of the next. Within a call batches
ascend, so the owner found first is the smallest of all. Given an `index` folder,
the index stays there and a later call goes on with it: lines of documents added
before belong to those.

A line goes if its owner is another document. Hot lines: a batch's hashes are
reduced to one row each before they meet the runs; the rows of a line that losing
documents share are dealt over many tasks (`common.spread_join`).

Defined results: null and empty texts are one empty line, which stays (keys of
fewer than `MIN_CHARS` code points never go). A document whose id is null keeps
all lines and owns none. Rows that repeat a doc_id are one document. Lines that
repeat within the smallest document stay. Empty tables give empty results. An
input column named like the result column is replaced.
"""

from __future__ import annotations

import functools

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import vectext as V
from .common import SortedRuns, drop_dir, shared_dir, spread_join, stored, table, with_struct, without

MIN_CHARS = 10
BATCHES = 4
FANOUT = 2

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STRIP = V.SPACES

RESULT = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key; None if the key is too short to count."""
    key = line.strip(_STRIP)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key.translate(_LOWER))


def line_hashes(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(doc_id, key), each key once a row of docs."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("key", T.BinaryType())])

    def go(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for part in V.slices(batch, text):
                ids, keys = [], []
                for k, t in zip(part.column(doc_id).to_pylist(), part.column(text).to_pylist(), strict=True):
                    own = {line_key(x, min_chars) for x in (t or "").encode().split(b"\n")} - {None}
                    ids += [k] * len(own)
                    keys += own
                yield pa.RecordBatch.from_arrays([pa.array(ids, arrow.field(0).type), pa.array(keys, pa.binary())], schema=arrow)

    return docs.select(doc_id, text).filter(F.col(doc_id).isNotNull()).mapInArrow(go, schema)


class LineIndex:
    """Owners of all lines added so far, in a folder."""

    def __init__(self, spark: SparkSession, folder: str, kind: T.DataType, fanout: int = FANOUT):
        self.runs = SortedRuns(spark, folder, ["key"], f"key binary, owner {kind.simpleString()}", lambda old, new: {"owner": old["owner"]}, fanout)

    def add(self, batch: DataFrame, folder: str, keep: bool = True) -> DataFrame:
        """Adds the stored (doc_id, key) rows of a batch; gives those whose line another document owns.

        keep: false for the last batch of an index that ends with it.
        """
        runs = self.runs
        staged = runs.stage(batch.groupBy("key").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")))
        met = runs.matched(staged)
        shared = met.filter("known IS NOT NULL OR n > 1").select("key", F.coalesce("known.owner", "owner").alias("owner"), "n")
        shared = runs.run(lambda: stored(shared, f"{folder}/shared"))
        losing = spread_join(batch, shared.drop("n"), ["key"], ["doc_id"], counts=shared.select("key", "n"))
        losing = stored(losing.filter(F.col("owner") != F.col("doc_id")).select("doc_id", "key"), f"{folder}/losing")
        drop_dir(runs.spark, f"{folder}/shared")
        if keep:
            runs.append(met.filter("known IS NULL"))
        return losing


def _bounds(docs: DataFrame, doc_id: str, batches: int) -> list:
    """Ids that cut the documents into about equal batches; their number is fixed."""
    if batches < 2:
        return []
    return sorted(set(docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("double").alias("d")).approxQuantile("d", [k / batches for k in range(1, batches)], 0.01)))


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, index: str | None = None, into: str = "lines") -> DataFrame:
    """docs with a struct column `into`: n_lines, n_dropped, kept (text or null as it was).

    index: a folder whose index the documents are added to; without one, theirs ends with the call.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    batch = F.lit(0)
    for b in _bounds(docs, doc_id, batches):
        batch = batch + (F.col("doc_id") >= F.lit(b)).cast("int")
    lines = line_hashes(docs, doc_id, text, min_chars).withColumn("batch", batch)
    lines.write.partitionBy("batch").parquet(f"{folder}/lines")
    lines = spark.read.schema(lines.schema).parquet(f"{folder}/lines")
    held = LineIndex(spark, index or f"{folder}/index", docs.schema[doc_id].dataType, fanout)
    losers = [held.add(lines.filter(F.col("batch") == k).drop("batch"), f"{folder}/batch-{k}", keep=index is not None or k + 1 < batches) for k in range(batches)]
    held.runs.close(delete=index is None)
    drop_dir(spark, f"{folder}/lines")
    drops = functools.reduce(DataFrame.union, losers).groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set("key").alias("__drop"))
    docs = without(docs, into)
    joined = docs.join(drops, docs[doc_id] == drops["__doc"], "left").drop("__doc")
    schema = with_struct(docs.schema, into, RESULT)

    def go(parts):
        arrow = to_arrow_schema(schema)
        for whole in parts:
            for part in V.slices(whole, text):
                made = []
                for t, drop in zip(part.column(text).to_pylist(), part.column("__drop").to_pylist(), strict=True):
                    raw = (t or "").encode()
                    if not drop:
                        made.append({"n_lines": raw.count(b"\n") + 1, "n_dropped": 0, "kept": t})
                        continue
                    drop = set(drop)
                    cut = raw.split(b"\n")
                    kept = [x for x in cut if line_key(x, min_chars) not in drop]
                    made.append({"n_lines": len(cut), "n_dropped": len(cut) - len(kept), "kept": b"\n".join(kept).decode()})
                cols = [pa.array(made, arrow.field(into).type) if f.name == into else part.column(f.name) for f in schema.fields]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return joined.mapInArrow(go, schema)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    x = F.col("lines")
    return out.select("doc_id", x.n_lines.alias("n_lines"), x.n_dropped.alias("n_dropped"), F.sha2(F.coalesce(x.kept, F.lit("")), 256).alias("kept_sha256"))
