"""Substring dedup over a log-structured index of window fingerprints.

A window is `WINDOW` consecutive words. Each window is anchored at the least
hash among its `GRAM`-word grams, so equal windows have equal anchors, and
consecutive windows mostly share one: there is an anchor for about every
fourteenth word. A fingerprint stands for the stretch of windows with one anchor:
the gram's hash and a 128-bit digest of the stretch's own words.

The index (`SubstringIndex`) is kept in a folder as immutable sorted runs, with two
companions that are kept alike: what each anchor gram has been seen with, and the
windows that were opened. `add` takes a batch of documents:

* its fingerprints, reduced to one row each, are merge-joined with the historical
  runs. One that comes twice, here or in history, repeats: all windows of all its
  stretches, in the batch and the first one of history;
* an anchor gram with several fingerprints: stretches that differ somewhere may
  still share windows. One stretch of each such fingerprint, of history as well if
  it was the gram's only one till now, is opened and every window in it verified by
  a 128-bit digest of its own words, against the opened windows of history;
* what is new becomes a run, and full levels are merged.

So the spans that all calls give together are those of one call with all documents;
a call also tells which spans of earlier documents have become repeats. Digests are
taken over the very words (joined by a space), which makes a false match a matter of
2 ** -128; texts themselves aren't compared.

Words covered by repeated windows go, in every occurrence. Nothing is gathered
for a hot passage: counts are partially aggregated, and where many stretches share a
fingerprint, a window or a gram, joins deal them over many tasks.

Defined results: null text has no words; documents of fewer than `WINDOW` words
lose nothing. Rows with equal id and text each count as a place of their own.
Ids may be null or repeat. Empty tables give empty results. An input column named
like the result column is replaced.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import vectext as V
from .common import SortedRuns, drop_dir, shared_dir, spread_join, stored, table, with_struct, without

WINDOW = 35
GRAM = 8
BATCHES = 3
FANOUT = 2

_TABLE = V.byte_table(V.SPACES, lower=False)

RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
PLACE = ["d", "th", "a", "m"]
PLACES = "d long, th long, a int, m int"
PRINT = ["x1", "x2", "g"]
PRINTS = f"x1 long, x2 long, g long, {PLACES}"
OPENED = ["y1", "y2"]
WINDOWS = f"y1 long, y2 long, {PLACES}"


def stretches(w: V.Words, window: int, gram: int):
    """(anchor gram hash, first word of the slice, document, number of windows) of each stretch of a slice."""
    n = len(w.start)
    at = np.flatnonzero(w.inside(window)) if n >= window else np.zeros(0, np.int64)
    if not len(at):
        return (np.zeros(0, V.U), *(np.zeros(0, np.int64),) * 3)
    grams = w.windows(gram)
    low = V.U((1 << n.bit_length()) - 1)
    least = V.sliding_min((grams & ~low) | np.arange(n, dtype=V.U), window - gram + 1)
    anchor = (least[at] & low).astype(np.int64)
    # Anchors of two documents differ, so no stretch reaches over an end.
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    a, m = at[first], np.diff(np.append(first, len(at)))
    return grams[anchor[first]], a, np.searchsorted(w.ptr, a, side="right") - 1, m


class Joined:
    """The words of a slice, joined by one space each."""

    def __init__(self, w: V.Words):
        size = w.end - w.start
        self.after = np.cumsum(size + 1) - 1
        self.first = self.after - size
        raw = np.full(int(self.after[-1]) + 1 if len(size) else 0, 32, np.uint8)
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        raw[np.repeat(self.first, size) + step] = w.buf[np.repeat(w.start, size) + step]
        self.raw = memoryview(raw.tobytes())

    def digests(self, first: np.ndarray, words: np.ndarray | int) -> np.ndarray:
        """(n, 2): the 128-bit digest of so many words from each first one on."""
        raw, digest = self.raw, xxhash.xxh3_128_digest
        ends = self.after[first + words - 1]
        return np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(self.first[first].tolist(), ends.tolist(), strict=True)]), "<i8").reshape(-1, 2)


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs with __d and __th, 128 bits which tell rows apart that differ in id or text."""
    return docs.withColumns({"__d": F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.col(doc_id))), "__th": F.xxhash64(F.col(text), F.col(doc_id).isNull())})


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    schema = T.StructType.fromDDL(PRINTS)

    def go(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for part in V.slices(batch, text):
                w = V.Words(*V.utf8(part.column(text)), _TABLE)
                g, a, doc, m = stretches(w, window, gram)
                x = Joined(w).digests(a, m + window - 1)
                d, th = (part.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("__d", "__th"))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((x[:, 0], x[:, 1], V.signed(g), d, th, a - w.ptr[doc], m), arrow, strict=True)], schema=arrow)

    return _rows(docs.select(doc_id, text), doc_id, text).select("__d", "__th", text).mapInArrow(go, schema)


def _open(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, window: int) -> DataFrame:
    """The digest of each window of the wanted stretches, with its place."""
    lists = wanted.groupBy("d", "th").agg(F.collect_set(F.struct("a", "m")).alias("__open"))
    rows = _rows(docs.select(doc_id, text), doc_id, text).dropDuplicates(["__d", "__th"])
    rows = rows.join(lists, (rows["__d"] == lists["d"]) & (rows["__th"] == lists["th"])).select("d", "th", text, "__open")
    schema = T.StructType.fromDDL(WINDOWS)

    def go(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for part in V.slices(batch, text):
                w = V.Words(*V.utf8(part.column(text)), _TABLE)
                lists = part.column("__open")
                flat = lists.flatten()
                doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                a, m = (flat.field(k).to_numpy().astype(np.int64) for k in range(2))
                step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                doc, start = np.repeat(doc, m), np.repeat(a, m) + step
                y = Joined(w).digests(w.ptr[doc] + start, window)
                d, th = (part.column(c).to_numpy()[doc] for c in ("d", "th"))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((y[:, 0], y[:, 1], d, th, start, np.ones(len(doc), np.int32)), arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(go, schema)


class SubstringIndex:
    """Fingerprints of all documents added so far, in a folder.

    Three indexes alike: of fingerprints, of anchor grams by the fingerprints they have
    been seen with, and of opened windows. A run holds how often a key came, and one
    place; once it came twice, more isn't told.
    """

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT, window: int = WINDOW, gram: int = GRAM):
        def runs(name: str, keys: list[str]) -> SortedRuns:
            columns = f"{', '.join(f'{k} long' for k in keys)}, c long, {PLACES}"
            return SortedRuns(spark, f"{folder}/{name}", keys, columns, lambda old, new: {"c": old["c"] + new["c"], **{p: old[p] for p in PLACE}}, fanout)

        self.spark, self.window, self.gram = spark, window, gram
        self.prints, self.grams, self.windows = runs("prints", PRINT), runs("grams", ["g"]), runs("windows", OPENED)

    def add(self, docs: DataFrame, folder: str, *, doc_id: str = "doc_id", text: str = "text", earlier: DataFrame | None = None) -> DataFrame:
        """Adds documents; gives (d, th, a, m): m windows from word a on repeat, in the row with d and th, old or new.

        earlier: all documents added before, where stretches of theirs must be opened.
        """
        prints = stored(fingerprints(docs, doc_id, text, self.window, self.gram), f"{folder}/prints")
        return self._add(prints, docs if earlier is None else docs.select(doc_id, text).unionAll(earlier.select(doc_id, text)), folder, doc_id, text)

    def _add(self, prints: DataFrame, texts: DataFrame, folder: str, doc_id: str, text: str, keep: bool = True) -> DataFrame:
        """prints: those of the batch, stored; texts: the documents of the batch and of history; keep: false for the last batch of an index that ends with it."""
        met, again = self._met(self.prints, prints, PRINT, f"{folder}/whole")
        fresh = met.filter("known IS NULL").select("g", *PLACE)
        met_grams, several = self._met(self.grams, fresh, ["g"], f"{folder}/grams")
        total = several.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
        wanted = spread_join(fresh, several.select("g"), ["g"], ["d", "a"], counts=several.select("g", F.col("c").alias("n")), total=total).select(*PLACE)
        wanted = wanted.unionAll(several.filter("one IS NOT NULL").select("one.*"))
        opened = self.prints.run(lambda: stored(_open(texts, wanted, doc_id, text, self.window), f"{folder}/opened"))
        met_windows, twice = self._met(self.windows, opened, OPENED, f"{folder}/single")
        spans = stored(_places(prints, PRINT, again).unionAll(_places(opened, OPENED, twice)), f"{folder}/spans")
        if keep:
            for runs, rows in ((self.prints, met), (self.grams, met_grams), (self.windows, met_windows)):
                runs.append(rows.filter("known IS NULL OR known.c = 1"))
        drop_dir(self.spark, *[f"{folder}/{n}" for n in ("opened", "whole", "grams", "single")])
        return spans

    @staticmethod
    def _met(runs: SortedRuns, rows: DataFrame, keys: list[str], where: str) -> tuple[DataFrame, DataFrame]:
        """The batch's keys with what history knows; of those that came more than once: keys, c, and in `one` history's place if that wasn't told yet."""
        staged = rows.groupBy(*keys).agg(F.count("*").alias("c"), *[F.first(p).alias(p) for p in PLACE])
        met = runs.matched(runs.run(lambda: runs.stage(staged)))
        one = F.when(F.col("known.c") == 1, F.struct(*[F.col(f"known.{p}") for p in PLACE])).alias("one")
        return met, runs.run(lambda: stored(met.filter("known IS NOT NULL OR c > 1").select(*keys, "c", one), where))

    def close(self, delete: bool = False) -> None:
        for runs in (self.prints, self.windows, self.grams):
            runs.close(delete)


def _places(rows: DataFrame, keys: list[str], again: DataFrame) -> DataFrame:
    """Places of the stored rows whose key is among those that came again, and those that history holds."""
    here = spread_join(rows, again.select(*keys), keys, ["d", "a"], counts=again.select(*keys, F.col("c").alias("n"))).select(*PLACE)
    return here.unionAll(again.filter("one IS NOT NULL").select("one.*"))


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, fanout: int = FANOUT, into: str = "repeats") -> DataFrame:
    """docs with a struct column `into`: n_words, n_removed and the kept words joined by a space."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    prints = fingerprints(docs, doc_id, text, window, gram).withColumn("batch", F.pmod(F.xxhash64("d", "th"), F.lit(batches)).cast("int"))
    prints.write.partitionBy("batch").parquet(f"{folder}/prints")
    prints = spark.read.schema(prints.schema).parquet(f"{folder}/prints")
    index = SubstringIndex(spark, f"{folder}/index", fanout, window, gram)
    spans = []
    for k in range(batches):
        spans.append(index._add(prints.filter(F.col("batch") == k).drop("batch"), docs, f"{folder}/batch-{k}", doc_id, text, keep=k + 1 < batches))
        drop_dir(spark, f"{folder}/prints/batch={k}")
    index.close(delete=True)
    drop_dir(spark, f"{folder}/prints")
    return without_spans(docs, functools.reduce(DataFrame.unionAll, spans), doc_id=doc_id, text=text, window=window, into=into)


def without_spans(docs: DataFrame, spans: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, into: str = "repeats") -> DataFrame:
    """docs with a struct column `into`, as in remove_repeats, from the spans that an index gave."""
    lists = spans.groupBy("d", "th").agg(F.collect_set(F.struct("a", "m")).alias("__spans"))
    docs = without(docs, into)
    rows = _rows(docs, doc_id, text)
    rows = rows.join(lists, (rows["__d"] == lists["d"]) & (rows["__th"] == lists["th"]), "left").select(*[rows[f"`{c}`"] for c in docs.columns], "__spans")
    schema = with_struct(docs.schema, into, RESULT)

    def go(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for part in V.slices(batch, text):
                made = []
                for t, spans in zip(part.column(text).to_pylist(), part.column("__spans"), strict=True):
                    words = (t or "").encode().split()
                    if spans.is_valid and len(words):
                        a, m = (spans.values.field(k).to_numpy() for k in range(2))
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, a, 1)
                        np.add.at(edge, a + m + window - 1, -1)
                        kept = [x for x, gone in zip(words, np.cumsum(edge) > 0, strict=False) if not gone]
                    else:
                        kept = words
                    made.append({"n_words": len(words), "n_removed": len(words) - len(kept), "kept": b" ".join(kept).decode()})
                cols = [pa.array(made, arrow.field(into).type) if f.name == into else part.column(f.name) for f in schema.fields]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return rows.mapInArrow(go, schema)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    x = F.col("repeats")
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", x.n_words.alias("n_words"), x.n_removed.alias("n_removed"), F.sha2(x.kept, 256).alias("kept_sha256"))
