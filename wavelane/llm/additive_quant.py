"""Approximate nearest neighbours by additive quantisation.

A vector is coded as the sum of one word from each of `BOOKS` codebooks, all of
full dimension. Each codebook is k-means over what the books before it leave of
the sample, as coded by beam search. They are fitted on at most `SAMPLE` vectors
(the least hashes of their ids); every vector is coded and indexed.

A search scans all codes: a query's inner products with all words make a lookup
table, a row's score is the sum of its words' entries less half its stored
squared norm. The best `RERANK` rows of a query are reranked by the exact cosine
of the original vectors in double precision. The `k`-th best of these is what any
other row must reach. Coding leaves a remainder whose length is stored, and by the
Cauchy-Schwarz inequality a row's cosine is at most its decoded one plus that
length; a second scan gives every row that may reach the mark its exact cosine,
within the task and `PART` rows at a time, and passes on the best only. So the
neighbours are the exact ones however many near copies share a code; the codes
only save exact cosines.

Equal vectors are indexed once, with their smallest ids, so a vector that a third
of all rows share costs one row and hides nothing. Queries pass in blocks of at
most about `BLOCK`, whose tables are broadcast; a block's size, not the corpus,
bounds that. A task keeps the best of what it scans.

Defined results: vectors that are null, zero or that hold null or non-finite
components take no part, nor do rows without id. Vectors of different lengths have no
cosine: those of each length are searched apart, one length after the other. Rows that repeat an id and its vector are one row. With fewer
candidates than asked for, all are returned; an empty table returns nothing.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import drop_dir, shared_dir, stored, table

BOOKS, WORDS = 40, 16
SAMPLE = 8192
BEAM = 4
RERANK = 400
BLOCK = 4096
#: Codes that one task scans.
SCAN = 65_536
#: Rows that one step of the second scan holds against a block of queries.
PART = 512
#: More than the rounding of scores added up in single precision, and of products in double precision.
SLACK, ROUNDING = 1e-4, 1e-9


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    words = x[rng.choice(len(x), k, replace=len(x) < k)] + rng.normal(0, 1e-6, (k, x.shape[1]))
    for _ in range(rounds):
        near = (x @ words.T - 0.5 * (words**2).sum(1)).argmax(1)
        own = (near == np.arange(k)[:, None]).astype(float)
        n = own.sum(1)
        words[n > 0] = (own @ x)[n > 0] / n[n > 0, None]
    return words


class Quantiser:
    """Codebooks of shape (BOOKS, WORDS, dimension); each is fitted to what those before leave."""

    def __init__(self, sample: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 7):
        rng = np.random.default_rng(seed)
        made, rest, cost = [], sample[:, None, :], (sample * sample).sum(1)[:, None]
        for _ in range(books):
            best = np.take_along_axis(rest, cost.argmin(1)[:, None, None], 1)[:, 0]
            made.append(_kmeans(best, words, rng))
            rest, cost, _, _ = self._step(rest, cost, made[-1], BEAM)
        self.words = np.array(made)

    @staticmethod
    def _step(rest: np.ndarray, cost: np.ndarray, book: np.ndarray, keep: int):
        """The best `keep` continuations of the partial sums: what is left, cost, which sum, which word."""
        new = (cost[:, :, None] - 2 * (rest @ book.T) + (book * book).sum(1)).reshape(len(rest), -1)
        keep = min(keep, new.shape[1])
        best = np.argpartition(new, keep - 1, axis=1)[:, :keep]
        of, word = best // len(book), best % len(book)
        return np.take_along_axis(rest, of[:, :, None], 1) - book[word], np.take_along_axis(new, best, 1), of, word.astype(np.uint8)

    def _beam(self, x: np.ndarray, beam: int) -> np.ndarray:
        codes, rest, cost = np.zeros((len(x), 1, 0), np.uint8), x[:, None, :], (x * x).sum(1)[:, None]
        for m, book in enumerate(self.words):
            rest, cost, of, word = self._step(rest, cost, book, beam if m + 1 < len(self.words) else 1)
            codes = np.concatenate([np.take_along_axis(codes, of[:, :, None], 1), word[:, :, None]], axis=2)
        return codes[:, 0]

    def encode(self, x: np.ndarray, beam: int = BEAM, chunk: int = 1024) -> np.ndarray:
        return np.concatenate([self._beam(x[i : i + chunk], beam) for i in range(0, len(x), chunk)])

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(len(self.words)))


def _matrix(column: pa.Array, kind=float) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(kind)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v) of the rows that take part, v in double precision."""
    v = F.col(embedding).cast("array<double>")
    # A finite number is one whose difference to itself is 0.
    fine = vectors.filter(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).select(F.col(vec_id).alias("id"), v.alias("v"))
    return fine.filter(F.forall("v", lambda x: x.isNotNull() & (x - x == 0)) & F.exists("v", lambda x: x != 0))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(rep, v, ids): each different vector once, with its `keep` smallest ids."""
    low = Window.partitionBy("v", "__salt").orderBy("id")
    some = rows.withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(64))).dropDuplicates(["id", "v"]).withColumn("__r", F.row_number().over(low)).filter(F.col("__r") <= keep)
    both = some.withColumn("__r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("__r") <= keep)
    return both.groupBy("v").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids"))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, as squares of tiny or huge numbers vanish or overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def build(distinct: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, Quantiser | None]:
    """distinct with code, half and rest: a vector's code, half its squared norm as decoded, and how far that is from it."""
    schema = T.StructType([*distinct.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("half", T.DoubleType()), T.StructField("rest", T.DoubleType())])
    rows = distinct.select("v", "rep").orderBy(F.xxhash64("rep"), "rep").limit(sample).collect()
    if not rows:
        return distinct.sparkSession.createDataFrame([], schema), None
    q = Quantiser(_unit(np.array([r[0] for r in rows])))
    shared = distinct.sparkSession.sparkContext.broadcast(q)

    def go(batches):
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column("v")))
                codes = shared.value.encode(x)
                decoded = shared.value.decode(codes)
                half, rest = 0.5 * (decoded**2).sum(1), np.sqrt(((x - decoded) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(half), pa.array(rest)], names=schema.names)

    return distinct.mapInArrow(go, schema), q


def scan(codes: DataFrame, q: Quantiser, ids: list, queries: np.ndarray, best: int) -> DataFrame:
    """(query_id, rep, approx): what each task finds best for each query of a block."""
    spark = codes.sparkSession
    tables = np.einsum("nd,mkd->mkn", _unit(queries), q.words).astype(np.float32)
    shared = spark.sparkContext.broadcast((np.array(ids), tables))
    kind = codes.schema["rep"].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("rep", kind), T.StructField("approx", T.DoubleType())])

    def go(batches):
        names, tables = shared.value
        score = rep = None
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                s = np.repeat(-part.column("half").to_numpy().astype(np.float32)[:, None], len(names), axis=1)
                for m in range(code.shape[1]):
                    s += tables[m][code[:, m]]
                r = np.repeat(part.column("rep").to_numpy()[:, None], len(names), axis=1)
                if score is not None:
                    s, r = np.concatenate([score, s]), np.concatenate([rep, r])
                if len(s) > best:
                    top = np.argpartition(-s, best - 1, axis=0)[:best]
                    s, r = np.take_along_axis(s, top, 0), np.take_along_axis(r, top, 0)
                score, rep = s, r
        if score is not None:
            for j in range(len(names)):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[j], len(score))), pa.array(rep[:, j]), pa.array(score[:, j].astype(float))], names=schema.names)

    return codes.select("rep", "code", "half").mapInArrow(go, schema)


def _bounds(part: pa.RecordBatch, tables: np.ndarray) -> np.ndarray:
    """(rows, queries): what no cosine exceeds."""
    code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, -1)
    s = np.repeat((part.column("rest").to_numpy() + SLACK).astype(np.float32)[:, None], tables.shape[2], axis=1)
    for m in range(code.shape[1]):
        s += tables[m][code[:, m]]
    return s


def complete(codes: DataFrame, q: Quantiser, ids: list, queries: np.ndarray, marks: np.ndarray, best: int) -> DataFrame:
    """query_id, ids, score of the `best` rows that each task finds for each query of a block, by exact cosines.

    marks: the cosine a query has found already; all rows that may reach it are looked at.
    """
    queries = _unit(queries)
    tables = np.einsum("nd,mkd->mkn", queries, q.words).astype(np.float32)
    shared = codes.sparkSession.sparkContext.broadcast((np.array(ids), queries, tables, marks))
    kind = codes.schema["rep"].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("ids", T.ArrayType(kind)), T.StructField("score", T.DoubleType())])

    def go(batches):
        arrow = to_arrow_schema(schema)
        names, queries, tables, marks = shared.value
        marks, found = marks.copy(), [[] for _ in names]
        for batch in batches:
            for i in range(0, batch.num_rows, PART):
                part = batch.slice(i, PART)
                maybe = _bounds(part, tables) >= marks.astype(np.float32)
                rows, cols = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
                if not len(rows):
                    continue
                part = part.take(pa.array(rows))
                v = _unit(_matrix(part.column("v")))
                x, y = np.nonzero(v @ queries[cols].T >= marks[cols] - ROUNDING)
                y = cols[y]
                score = np.concatenate([np.zeros(0), *[(queries[y[c : c + 65_536]] * v[x[c : c + 65_536]]).sum(axis=1) for c in range(0, len(x), 65_536)]]).clip(-1, 1)
                by_id = np.argsort(np.argsort(part.column("rep").to_numpy(zero_copy_only=False)))
                order = np.lexsort((by_id[x], -score, y))
                x, y, score = x[order], y[order], score[order]
                first = np.searchsorted(y, y)
                top = np.arange(len(y)) - first < best
                for r, j, c in zip(x[top].tolist(), y[top].tolist(), score[top].tolist(), strict=True):
                    found[j].append((-c, part.column("rep")[r].as_py(), part.column("ids")[r].as_py()))
                for j in np.unique(y).tolist():
                    if len(found[j]) >= best:
                        found[j] = sorted(found[j])[:best]
                        marks[j] = max(marks[j], -found[j][-1][0])
        rows = [(name, ids, -c) for name, own in zip(names.tolist(), found, strict=True) for c, _, ids in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], arrow.field(k).type) for k in range(3)], schema=arrow)

    return codes.select("rep", "ids", "v", "code", "rest").mapInArrow(go, schema)


def _cosines(pairs: DataFrame, kind) -> DataFrame:
    """query_id, ids, score from q and v."""
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("ids", T.ArrayType(kind)), T.StructField("score", T.DoubleType())])

    def go(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = _unit(_matrix(batch.column("q"))), _unit(_matrix(batch.column("v")))
                score = np.clip((a * b).sum(axis=1), -1, 1)
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("ids"), pa.array(score)], names=schema.names)

    return pairs.select("query_id", "ids", "q", "v").mapInArrow(go, schema)


def search(vectors: DataFrame, is_query, *, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", rerank: int = RERANK, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row where is_query holds."""
    spark = vectors.sparkSession
    folder = shared_dir(spark)
    rows = stored(usable(vectors, vec_id, embedding), f"{folder}/rows")
    sizes = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())  # as many as there are lengths
    found = [_search(rows.filter(F.size("v") == s), is_query, k, rerank, block, f"{folder}/of-{s}") for s in sizes]
    drop_dir(spark, f"{folder}/rows")
    return _nearest(functools.reduce(DataFrame.unionAll, found, _nothing(spark, rows.schema["id"].dataType)), k)


def _nothing(spark, kind: T.DataType) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField("query_id", kind), T.StructField("ids", T.ArrayType(kind)), T.StructField("score", T.DoubleType())]))


def _search(rows: DataFrame, is_query, k: int, rerank: int, block: int, folder: str) -> DataFrame:
    """(query_id, ids, score) of what any task finds best, among vectors of one length."""
    spark, kind = rows.sparkSession, rows.schema["id"].dataType
    distinct = stored(distinct_vectors(rows, k + 1), f"{folder}/distinct")
    queries = stored(rows.filter(is_query).dropDuplicates(["id"]).select(F.col("id").alias("query_id"), F.col("v").alias("q")), f"{folder}/queries")
    n = queries.count()
    found = _nothing(spark, kind)
    if n:  # so there are vectors to build from
        codes, q = build(distinct)
        codes = stored(codes, f"{folder}/codes")
        dealt = codes.coalesce(max(1, -(-codes.count() // SCAN)))
        blocks = -(-n // block)
        of = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        best = Window.partitionBy("query_id").orderBy(F.desc("approx"), "rep")
        for b in range(blocks):
            own = queries.filter(of == b).collect()  # about `block` rows
            if own:
                ids, vectors = [r[0] for r in own], np.array([r[1] for r in own])
                hits = scan(dealt, q, ids, vectors, rerank).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= rerank).drop("r")
                near = _nearest(_cosines(hits.join(queries, "query_id").join(codes, "rep"), kind), k)
                marks = dict(near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") == k).select("query_id", "s").collect())
                found = found.unionAll(stored(complete(dealt, q, ids, vectors, np.array([marks.get(i, -2.0) for i in ids]), k + 1), f"{folder}/found-{b}"))
    drop_dir(spark, f"{folder}/distinct", f"{folder}/queries", f"{folder}/codes")
    return found


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, from (query_id, ids, score)."""
    scored = found.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_ann(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
