"""What the corpus operators share: tables, written intermediate results and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where the session names none (local tests), a folder is made once for the application."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


#: While a result is written: rows here are whole texts, and fewer of them at a time keep the memory of Python workers small
#: (a row larger than the bytes is a batch of its own); shuffle files go when the write is over, as it is read again from what it wrote.
_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


class Written:
    """Intermediate results written as Parquet in the shared folder.

    A written table cuts lineage as checkpoint() does and survives the loss of executors, but is computed
    once, keeps only its columns and has known sizes, from which the planner picks its joins. drop() removes
    tables that later steps no longer read; the last ones stay for the lazy result, until close() or the end of the driver.
    Settings of the session are changed for the time of a write only."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.count = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        atexit.register(self._leave)

    @contextlib.contextmanager
    def settings(self) -> Iterator[None]:
        """The settings of writes, for other actions too; the session's own come back."""
        before = {k: self.spark.conf.get(k, None) for k in _SETTINGS}
        rows = before["spark.sql.execution.arrow.maxRecordsPerBatch"]
        try:
            for k, v in _SETTINGS.items():
                if not (k.endswith("maxRecordsPerBatch") and rows and 0 < int(rows) < int(v)):
                    self.spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def _save(self, writer: DataFrameWriter, path: str) -> None:
        with self.settings():
            writer.parquet(path)

    def __call__(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        self._save(df.write, path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def by_kind(self, df: DataFrame, *kinds: int) -> list[DataFrame]:
        """Written in one pass, apart by the column `kind`: a table for each of these kinds."""
        self.count += 1
        base = f"{self.base}/{self.count}"
        self._save(df.write.partitionBy("kind"), base)
        out = []
        for kind in kinds:
            # a kind without rows has no folder; the base then reads as empty
            part = self.spark.read.schema(df.schema).parquet(base).where(F.col("kind") == kind).select(*df.columns)
            self.paths[id(part)] = part, f"{base}/kind={kind}"
            out.append(part)
        return out

    def drop(self, *dfs: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in dfs:
            if found := self.paths.pop(id(df), None):
                p = jvm.org.apache.hadoop.fs.Path(found[1])
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def drop_all_but(self, *dfs: DataFrame) -> None:
        """What a result that is written itself no longer needs."""
        self.drop(*[df for df, _ in list(self.paths.values()) if all(df is not x for x in dfs)])

    def _leave(self) -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone
            self.close()

    def close(self) -> None:
        """Deletes everything that was written; results that read it can't be used afterwards."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        self.paths.clear()


def in_order(df: DataFrame, columns: list[str]) -> list[Column]:
    """Something to order rows by, for every column; maps are compared as JSON."""
    return [F.to_json(col(c)) if "map<" in df.schema[c].dataType.simpleString() else col(c) for c in columns]


def least_rows(df: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """Of the rows that agree in the columns `by` the least one by all of `keep` (maps are compared as JSON)."""
    row = F.struct(*[col(c) for c in keep])
    return df.groupBy(*[col(c) for c in by]).agg(F.min_by(row, F.struct(*in_order(df, keep))).alias("d")).select("d.*")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the Python worker, which serves later tasks too, gives back the memory that it no longer uses."""

    def then_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return then_back


def fresh(columns: Iterable[str], wanted: str) -> str:
    """A column name that clashes with none of `columns` (compared as Spark does, without case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def components(spark: SparkSession, edges: DataFrame, write: Written) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root being the smallest node of the component.

    Distributed union-find by alternating large-star and small-star steps until nothing changes: every round hangs each node's larger
    (then smaller) neighbours under the smallest one, so trees flatten in a number of rounds that is logarithmic
    in practice. Each round's edges are written to the shared folder. A node of large degree is handled by a
    group-wise minimum and a join, never gathered in one row. Null ends and loops are ignored."""
    now = write(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = write(large)
        # now every edge goes from a to a smaller b; small star links the smaller neighbours of a to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = write(small)
        write.drop(large, now)
        # a forest of stars: no node is both above and below, and none is below two
        sums = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        now = after
        if before == sums:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = sums
