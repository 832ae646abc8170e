"""Sources by address, chains of SQL views, and save points."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ADDRESS = re.compile(r"^([a-z]+)://(.*)$", re.DOTALL)


def run_sql_chain(spark: SparkSession, queries: Sequence[str], prefix: str, start: int = 1) -> DataFrame:
    """Each query's result is a view prefix1, prefix2, ... that later ones may use; the last result is returned. Views are lazy, so the optimizer sees one plan."""
    if not queries:
        raise ValueError("a chain needs a query")
    out = None
    for k, q in enumerate(queries, start):
        require_select(q)
        out = spark.sql(q)
        out.createOrReplaceTempView(f"{prefix}{k}")
    return out


def require_select(q: str) -> None:
    if not re.match(r"\s*(select|with|\()", q, re.IGNORECASE):
        raise ValueError("only queries that select are allowed")


def read_table(spark: SparkSession, name: str, queries: Sequence[str] = (), prefix: str = "table") -> DataFrame:
    """A catalog table, or without a name a chain of queries."""
    return spark.table(name) if name else run_sql_chain(spark, queries, prefix)


def read_jdbc(spark: SparkSession, url: str, name: str, queries: Sequence[str] = (), prefix: str = "table", properties: Mapping[str, str] | None = None) -> DataFrame:
    """A table, or a chain whose first query runs in the database and the rest in Spark."""
    if name:
        return spark.read.jdbc(url, name, properties=dict(properties or {}))
    if not queries:
        raise ValueError("a chain needs a query")
    require_select(queries[0])
    first = spark.read.jdbc(url, f"( {queries[0]} ) first_table", properties=dict(properties or {}))
    first.createOrReplaceTempView(f"{prefix}1")
    return run_sql_chain(spark, queries[1:], prefix, 2) if len(queries) > 1 else first


def read_files(spark: SparkSession, path: str, kind: str, queries: Sequence[str] = (), prefix: str = "table") -> DataFrame:
    """csv and tsv (with header, all text), json (lines) or parquet. Queries may use a view named like the file up to its first dot."""
    if kind in ("csv", "tsv"):
        df = spark.read.option("header", True).option("sep", "," if kind == "csv" else "\t").csv(path)
    elif kind in ("json", "parquet"):
        df = getattr(spark.read, kind)(path)
    else:
        raise ValueError(f"unknown format {kind}")
    if not queries:
        return df
    df.createOrReplaceTempView(PurePosixPath(path.rstrip("/")).name.split(".")[0])
    return run_sql_chain(spark, queries, prefix)


def read(spark: SparkSession, source: str, kind: str = "", queries: Sequence[str] = (), prefix: str = "table", jdbc: Mapping[str, str] | None = None) -> DataFrame:
    """hive://db.table, jdbc://table (with settings url, user, password, driver), or hdfs://path, file://path and others that Spark opens."""
    found = _ADDRESS.match(source)
    if not found:
        raise ValueError(f"no source address: {source}")
    scheme, rest = found.groups()
    if scheme == "hive":
        return read_table(spark, rest, queries, prefix)
    if scheme in ("jdbc", "vertica"):
        settings = dict(jdbc or {})
        return read_jdbc(spark, settings.pop("url"), rest, queries, prefix, settings)
    if scheme in ("hdfs", "file", "s3a", "abfs", "gs"):
        return read_files(spark, source, kind, queries, prefix)
    raise ValueError(f"unknown source {scheme}")


def select_roles(df: DataFrame, roles: Mapping[str, Sequence[str]], response: str | None = None, where: str | None = None) -> DataFrame:
    """The distinct columns of all roles, for rows that satisfy `where` or, without it, have a response."""
    names = list(dict.fromkeys(c for columns in roles.values() for c in columns))
    df = df.where(where) if where else df.where(F.col(response).isNotNull()) if response else df
    return df.select(*names)


class SavePoints:
    """Steps, inputs, models and results of one model in a folder of any file system that Spark reaches.

    root/project/model/retrain/{model,predict,monitoring}; fitted pipelines are always read from `model`."""

    def __init__(self, spark: SparkSession, root: str, project: str, model: str, retrain: str = "0", job: str = "model"):
        if job not in ("model", "predict", "monitoring"):
            raise ValueError(f"unknown job {job}")
        self.spark, self.home = spark, f"{root.rstrip('/')}/{project}/{model}/{retrain}"
        self.base = f"{self.home}/{job}"

    @staticmethod
    def page(number: int | None) -> str:
        return "noPage" if not number else f"page{number}"

    def data(self, step: str, split: int = 0, page: int | None = None) -> str:
        return f"{self.base}/{self.page(page)}/noSegment/data/{step}{split}"

    def save(self, df: DataFrame, step: str, split: int = 0, page: int | None = None) -> DataFrame:
        df.write.mode("overwrite").parquet(self.data(step, split, page))
        return self.load(step, split, page)

    def load(self, step: str, split: int = 0, page: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.data(step, split, page))

    def load_all(self, step: str, splits: int, pages: Iterable[int | None] = (None,)) -> list[list[DataFrame]]:
        return [[self.load(step, s, p) for s in range(splits)] for p in pages]

    def save_input(self, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.base}/input_data")
        return self.load_input()

    def load_input(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/input_data")

    def pipeline(self, step: str, page: int | None = None) -> str:
        return f"{self.home}/model/{self.page(page)}/noSegment/pipeline/{step}_pipeline"

    def save_pipeline(self, model: PipelineModel, step: str, page: int | None = None) -> None:
        model.write().overwrite().save(self.pipeline(step, page))

    def load_pipeline(self, step: str, page: int | None = None, missing: bool = False) -> PipelineModel | None:
        """missing: give None where there is none."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.pipeline(step, page))
        if missing and not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return PipelineModel.load(self.pipeline(step, page))

    def save_metrics(self, df: DataFrame, name: str) -> None:
        """As JSON and as CSV, side by side. Metrics are a few rows."""
        one = df.coalesce(1)
        one.write.mode("overwrite").json(f"{self.base}/metrics/{name}.json")
        one.write.mode("overwrite").option("header", True).csv(f"{self.base}/metrics/{name}.csv")

    def save_text(self, lines: DataFrame, name: str) -> None:
        lines.coalesce(1).write.mode("overwrite").text(f"{self.base}/metrics/{name}.txt")

    def append_predictions(self, df: DataFrame, name: str = "cv") -> None:
        df.write.mode("append").parquet(f"{self.base}/predictions/{name}")

    def save_sample(self, df: DataFrame, kind: str = "csv") -> None:
        """A sample for checks by people: one file."""
        if kind not in ("csv", "json"):
            raise ValueError(f"unknown format {kind}")
        w = df.coalesce(1).write.mode("overwrite")
        (w.option("header", True).csv if kind == "csv" else w.json)(f"{self.base}/qa")

    def save_config(self, text: str) -> None:
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.base}/config")
