"""What the operators share: the shared folder, tables, hot-key limits."""

from __future__ import annotations

import gc
import json
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only a local session may lack that setting; the warehouse then takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, where: str) -> DataFrame:
    """Writes a table in the shared folder and reads it back: lineage ends here."""
    df.write.mode("overwrite").parquet(where)
    tidy(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(where)


#: Seconds between two collections of garbage, at least.
TIDY_S = 2
_tidied = [0.0]


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of plans that nothing refers to any more, now and then."""
    if time.monotonic() - _tidied[0] >= TIDY_S:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _tidied[0] = time.monotonic()


def _at(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def drop_dir(spark: SparkSession, *folders: str) -> None:
    for where in folders:
        fs, path = _at(spark, where)
        fs.delete(path, True)


def read_text(spark: SparkSession, where: str) -> str | None:
    """The text of a small file; null if there is none."""
    fs, path = _at(spark, where)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, where: str, text: str) -> None:
    """Puts a small file in place, whole or not at all."""
    fs, path = _at(spark, where)
    _, beside = _at(spark, f"{where}.{uuid.uuid4().hex}")
    stream = fs.create(beside)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs.delete(path, False)
    fs.rename(beside, path)


def with_struct(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    """schema with column `name` of type `kind` last; one of that name is replaced."""
    return T.StructType([f for f in schema.fields if f.name.lower() != name.lower()] + [T.StructField(name, kind)])


def without(df: DataFrame, *names: str) -> DataFrame:
    low = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in low])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def salt(*cols: str, n: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


#: Rows of one key that are never dealt over several tasks.
FEW = 256


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], by: list[str], how: str = "inner", counts: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """many joined on `keys` with one, which has at most a row for each value of them.

    Where a value has more than an even share of many's rows, these are dealt by the
    hash of `by` over as many tasks as they fill, and one's row goes to each. Fewer
    values than there are partitions can be so, which bounds the list of them that
    is collected and broadcast. many has no null keys and, unless its number of rows
    is given, is a stored table; counts (keys, n) are its rows by key, if known.
    """
    spark, parts = many.sparkSession, partitions(many.sparkSession)
    share = max(FEW, -(-(many.count() if total is None else total) // parts))
    counts = many.groupBy(*keys).agg(F.count("*").alias("__n")) if counts is None else counts.withColumnRenamed("n", "__n")
    heat = counts.filter(F.col("__n") > share).select(*keys, F.ceil(F.col("__n") / share).cast("int").alias("__parts")).collect()
    if not heat:
        return many.join(one, keys, how)
    heat = F.broadcast(spark.createDataFrame(heat, T.StructType([*(many.schema[k] for k in keys), T.StructField("__parts", T.IntegerType())])))
    dealt = many.join(heat, keys, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    copies = one.join(heat, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copies, [*keys, "__salt"], how).drop("__salt")


@contextmanager
def _sorted_buckets(spark: SparkSession):
    """Scans of bucketed tables give their order, where a bucket is one file."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class SortedRuns:
    """A log-structured index: levels of immutable runs, each in buckets by the hash of `keys` and sorted by them.

    Every run has the same buckets, one sorted file each, so a staged batch is
    merge-joined with the runs, and runs with one another, without an exchange or
    a sort on either side. A new run is of level 0; a level that has `fanout` runs
    is merged into one run of the next. The manifest in the folder says what the
    index holds, and a run counts only once the manifest names it; so a lost session
    leaves the index as it was, and another one can go on with it.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], columns: str, merge, fanout: int, buckets: int | None = None):
        """columns: DDL of keys and the others; merge(older, newer): the others of a key that two runs have.

        A key is at most once in a run. buckets: of a new index; by default the
        session's number of shuffle partitions, which spares a batch an exchange.
        """
        self.spark, self.folder, self.keys, self.merge, self.fanout = spark, folder, keys, merge, fanout
        self.schema = T.StructType.fromDDL(columns)
        self.rest = [n for n in self.schema.names if n not in keys]
        self.tables: dict[str, str] = {}
        held = json.loads(read_text(spark, f"{folder}/manifest") or "null") or {"buckets": buckets or partitions(spark), "levels": [], "made": 0}
        self.buckets, self.levels, self.made = held["buckets"], held["levels"], held["made"]

    def runs(self) -> list[str]:
        """Oldest first."""
        return [r for level in reversed(self.levels) for r in level]

    def read(self, run: str) -> DataFrame:
        if run not in self.tables:
            self.tables[run] = f"wavelane_run_{uuid.uuid4().hex}"
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
            self.spark.sql(f"CREATE TABLE {self.tables[run]} ({columns}) USING parquet CLUSTERED BY ({', '.join(self.keys)}) SORTED BY ({', '.join(self.keys)}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{run}'")
        return self.spark.table(self.tables[run])

    def _write(self, rows: DataFrame, run: str) -> str:
        drop_dir(self.spark, f"{self.folder}/{run}")  # what a lost session may have begun
        self.tables[run] = f"wavelane_run_{uuid.uuid4().hex}"
        with _sorted_buckets(self.spark):
            rows.write.format("parquet").bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", f"{self.folder}/{run}").saveAsTable(self.tables[run])
        tidy(self.spark)
        return run

    def _forget(self, runs: list[str], delete: bool = True) -> None:
        for run in runs:
            if run in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(run)}")
            if delete:
                drop_dir(self.spark, f"{self.folder}/{run}")

    def stage(self, grouped: DataFrame) -> DataFrame:
        """A batch as a table in the buckets and order of the runs; grouped: by keys, in their order, with all columns of a run and any others."""
        if partitions(self.spark) != self.buckets:
            grouped = grouped.repartition(self.buckets, *self.keys)
        self._forget(["staged"])
        self._write(grouped, "staged")
        return self.spark.table(self.tables["staged"])

    def matched(self, staged: DataFrame) -> DataFrame:
        """staged with `known`: what the runs have of a key, null if nothing."""
        out = staged.withColumn("known", F.lit(None).cast(T.StructType([self.schema[n] for n in self.rest])))
        for run in self.runs():
            old = self.read(run).select(*self.keys, F.struct(*self.rest).alias("__old"))
            out = out.join(old.hint("merge"), self.keys, "left").withColumn("known", self._both("known", "__old")).drop("__old")
        return out

    def _both(self, a: str, b: str) -> Column:
        made = F.struct(*[c.cast(self.schema[n].dataType).alias(n) for n, c in self.merge(F.col(a), F.col(b)).items()])
        return F.when(F.col(a).isNull(), F.col(b)).when(F.col(b).isNull(), F.col(a)).otherwise(made)

    def run(self, action):
        """action() with scans of runs in their order."""
        with _sorted_buckets(self.spark):
            return action()

    def append(self, rows: DataFrame) -> None:
        """A new run, of rows that come from the staged batch; full levels are merged.

        Where there is no run yet, the staged batch is the run: its rows are all new.
        """
        run = f"run-{self.made}"
        self.made += 1
        if self.runs():
            self._write(rows.select(*self.schema.names), run)
            gone = ["staged"]
        else:
            self._forget(["staged"], delete=False)
            fs, staged = _at(self.spark, f"{self.folder}/staged")
            fs.rename(staged, _at(self.spark, f"{self.folder}/{run}")[1])
            gone = []
        self.levels = self.levels or [[]]
        self.levels[0] = [*self.levels[0], run]
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            if len(self.levels) == level + 1:
                self.levels.append([])
            self.levels[level + 1] = [*self.levels[level + 1], self._merge(old)]
            gone += old
            level += 1
        self._say()
        self._forget(gone)

    def _merge(self, runs: list[str]) -> str:
        """Two runs are merged as they lie; each further one costs an exchange."""
        out = self.read(runs[0]).select(*self.keys, F.struct(*self.rest).alias("__a"))
        for run in runs[1:]:
            b = self.read(run).select(*self.keys, F.struct(*self.rest).alias("__b"))
            out = out.join(b.hint("merge"), self.keys, "full").withColumn("__a", self._both("__a", "__b")).drop("__b")
        self.made += 1
        return self._write(out.select(*self.keys, "__a.*"), f"run-{self.made - 1}")

    def compact(self) -> None:
        """All runs into one."""
        if len(gone := self.runs()) > 1:
            merged = self._merge(gone)
            self.levels = [[] for _ in self.levels[:-1]] + [[merged]]
            self._say()
            self._forget(gone)

    def _say(self) -> None:
        write_text(self.spark, f"{self.folder}/manifest", json.dumps({"buckets": self.buckets, "levels": self.levels, "made": self.made}))

    def close(self, delete: bool = False) -> None:
        """Forgets this session's tables; the folder stays unless it shall go."""
        self._forget(list(self.tables), delete=False)
        if delete:
            drop_dir(self.spark, self.folder)
