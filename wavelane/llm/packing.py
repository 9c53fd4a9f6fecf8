"""Packing documents into sequences: cutting stock by column generation.

A document's tokens are cut into whole sequences and one remainder. Remainders
are counted by length class (`UNIT` tokens wide), which gives a histogram of at
most `capacity / UNIT` rows however many documents there are. A linear program
over patterns (how many pieces of each class fill a sequence) is solved on it:
the simplex method keeps a basis of patterns, knapsack dynamic programming over
the dual prices finds the pattern to add, until none lowers the count or the
dual bound is within `GAP`. Patterns are rounded down and what remains is placed
best fit first.

The plan is then applied to ranked documents without gathering them: a piece's
rank in its class is the count of pieces in smaller salt buckets plus its rank in
its own bucket, so a class that holds a third of all pieces is dealt over all
buckets. Ranks map to (sequence, slot) by a table of rank ranges whose size
depends on the number of patterns only. Offsets are running sums in a sequence.

Tokens are those of the tokenizers library for the named vocabulary; they are
made by tiktoken from the same vocabulary's ranks, several times faster, and the
tests hold both against each other.

Defined results: null text is empty, so one end token. Every row is packed, also
rows that repeat a document. An empty table gives no pieces. Only `doc_id` and
`text` are read, so clashing names don't matter.
"""

from __future__ import annotations

import base64
import logging
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import vectext as V
from .common import partitions, shared_dir, stored, table

CAPACITY = 2048
END = 1
UNIT = 8
#: The linear program may stop when it is so near its lower bound.
GAP = 1e-3
#: Columns that may be priced; should they not do, that is logged, and the rounding pads some more. All pieces are packed either way.
STEPS = 6000
SPECIAL = {"<|endoftext|>": 50256}

_ENCODERS: dict = {}


def encoder(ranks: str | None = None):
    """The byte-level BPE of 50k, for this process; `ranks` is the file's path."""
    import public_tokenizers as P
    import tiktoken

    path = ranks or str(P.path("byte_bpe_50k.tiktoken"))
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("byte_bpe_50k", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens=SPECIAL)
    return _ENCODERS[path]


def token_ids(text: str | None, enc) -> np.ndarray:
    """Ids of one document, end token included, as little-endian uint32."""
    ids = enc.encode_to_numpy(text or "", allowed_special=set(SPECIAL), disallowed_special=())
    return np.append(ids, END).astype("<u4")


def pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, ranks: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Whole sequences and the remainder of each row: doc_id, start, length, ids_crc32, doc_tokens (, ids)."""
    fields = [T.StructField("doc_id", docs.schema[doc_id].dataType)] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids)

    def go(batches):
        arrow, enc = to_arrow_schema(schema), encoder(ranks)
        for batch in batches:
            for part in V.slices(batch, text):
                rows: list[tuple] = []
                for k, t in zip(part.column(doc_id).to_pylist(), part.column(text).to_pylist(), strict=True):
                    ids = token_ids(t, enc)
                    n = len(ids)
                    for a in range(0, n, capacity):
                        own = ids[a : a + capacity]
                        rows.append((k, a, len(own), zlib.crc32(own), n, *([own.astype("i4")] if keep_ids else [])))
                cols = list(zip(*rows, strict=True)) or [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return docs.select(doc_id, text).mapInArrow(go, schema)


def _price(dual: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of most dual value that fits: unbounded knapsack by dynamic programming."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fit = np.searchsorted(sizes, c, side="right")
        best[c] = best[c - 1]
        if fit:
            value = best[c - sizes[:fit]] + dual[:fit]
            k = int(value.argmax())
            if value[k] > best[c] + 1e-12:
                best[c], took[c] = value[k], k
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[capacity]), pattern


def plan_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP, most: int = STEPS) -> list[tuple[np.ndarray, float]]:
    """Linear program by column generation: patterns with their (fractional) counts."""
    m = len(sizes)
    basis = [np.eye(m, dtype=np.int64)[k] * (capacity // sizes[k]) for k in range(m)]
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    x = (inverse * demand).sum(axis=1)
    bound = 0.0
    for step in range(most):
        dual = inverse.sum(axis=0)
        value, pattern = _price(np.maximum(dual, 0), sizes, capacity)
        bound = max(bound, float((dual * demand).sum()) / max(value, 1.0))
        if value <= 1 + 1e-9 or x.sum() <= bound * (1 + gap):
            break
        own = np.flatnonzero(pattern)
        u = (inverse[:, own] * pattern[own]).sum(axis=1)  # few columns; no library threads wake up for it
        up = u > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, u, 1), np.inf)
        r = int(ratio.argmin())
        x = x - ratio[r] * u
        x[r] = ratio[r]
        inverse[r] /= u[r]
        other = u.copy()
        other[r] = 0
        inverse -= other[:, None] * inverse[r]
        x = np.maximum(x, 0)
        basis[r] = pattern
        if step % 200 == 199:
            columns = np.array(basis, float)
            if np.abs((columns * x[:, None]).sum(axis=0) - demand).max() > 1e-6 * demand.max():  # rounding has added up
                inverse = np.linalg.inv(columns.T)
                x = np.maximum((inverse * demand).sum(axis=1), 0)
    else:
        logging.getLogger(__name__).warning("linear program ended after %d columns at %.4f, %.2f %% above its bound", most, x.sum(), 100 * (x.sum() / bound - 1))
    return list(zip(basis, x.tolist(), strict=True))


def sequences(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pieces of each class in a sequence, how many such sequences); they hold the histogram exactly."""
    out = [({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    sizes = np.array(sorted(c for c, n in histogram.items() if n and c < capacity), np.int64)
    if not len(sizes):
        return out
    demand = np.array([histogram[int(c)] for c in sizes], float)
    left = demand.astype(np.int64)
    for pattern, x in plan_patterns(sizes, demand, capacity):
        n = int(x + 1e-6)
        used = pattern > 0
        n = min(n, int((left[used] // pattern[used]).min())) if used.any() else 0
        if n > 0:
            left -= n * pattern
            out.append(({int(c): int(a) for c, a in zip(sizes, pattern, strict=True) if a}, n))
    # What the rounding leaves: at most about one sequence a pattern. Best fit, largest first.
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[dict[int, int]] = []
    for c, n in zip(sizes[::-1].tolist(), left[::-1].tolist(), strict=True):
        for _ in range(n):
            free = next((f for f in range(c, capacity + 1) if room[f]), None)
            if free is None:
                bins.append({})
                free, b = capacity, len(bins) - 1
            else:
                b = room[free].pop()
            bins[b][c] = bins[b].get(c, 0) + 1
            room[free - c].append(b)
    return out + [(b, 1) for b in bins]


def _ranges(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, rank after, first sequence, pieces a sequence, first slot)."""
    at: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in plan:
        slot = 0
        for c, a in sorted(pattern.items(), reverse=True):
            lo = at.get(c, 0)
            at[c] = lo + a * n
            rows.append((c, lo, at[c], sequence, a, slot))
            slot += a
        sequence += n
    return rows


def assign(cut: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """cut with sequence_id and offset. cut: a stored table of pieces, ids aside."""
    spark = cut.sparkSession
    n = partitions(spark)
    cut = cut.withColumn("__class", F.ceil(F.col("length") / unit).cast("int")).withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(n)).cast("int"))
    counts = cut.groupBy("__class", "__bucket").agg(F.count("*").alias("__n"))
    before = counts.select("__class", "__bucket", (F.sum("__n").over(Window.partitionBy("__class").orderBy("__bucket")) - F.col("__n")).alias("__before"))
    histogram = {r[0]: r[1] for r in cut.groupBy("__class").count().collect()}  # at most capacity / unit rows
    # At most a row a piece of each of the program's patterns and of the sequences that rounding leaves, capacity / unit of either.
    ranges = spark.createDataFrame(_ranges(sequences(histogram, capacity // unit)) or [(0, 0, 0, 0, 1, 0)], "__c int, __lo long, __hi long, __seq long, __a long, __slot long")
    rank = F.row_number().over(Window.partitionBy("__class", "__bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = cut.join(before, ["__class", "__bucket"]).withColumn("__rank", rank + F.col("__before"))
    j = F.col("__rank") - F.col("__lo")
    placed = ranked.join(F.broadcast(ranges), (F.col("__class") == F.col("__c")) & (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi")))
    placed = placed.withColumn("sequence_id", F.expr("__seq + (__rank - __lo) div __a")).withColumn("__slot", F.col("__slot") + j % F.col("__a"))
    inside = Window.partitionBy("sequence_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("offset", F.sum("length").over(inside) - F.col("length"))
    return placed.drop("__class", "__bucket", "__before", "__rank", "__c", "__lo", "__hi", "__seq", "__a", "__slot")


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, unit: int = UNIT, keep_ids: bool = False, **options) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (, ids).

    Places are found without the ids, which join them at the end.
    """
    cut = pieces(docs, doc_id=doc_id, text=text, capacity=capacity, keep_ids=keep_ids, **options)
    if keep_ids:
        cut = cut.withColumn("__piece", F.monotonically_increasing_id())  # fixed once written
    cut = stored(cut, f"{shared_dir(docs.sparkSession)}/pieces")
    if not keep_ids:
        return assign(cut, capacity, unit)
    return assign(cut.drop("ids"), capacity, unit).join(cut.select("__piece", "ids"), "__piece").drop("__piece")


def padding(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """tokens, sequences and padding of a packing; a sequence as long as a power of two isn't padded."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    whole = F.expr("bit_count(used) = 1")
    return used.agg(F.sum("used").alias("tokens"), F.count("*").alias("sequences"), F.sum(F.when(whole, 0).otherwise(capacity - F.col("used"))).alias("padding"))


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
