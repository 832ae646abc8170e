"""Scoring of a stream: the batch stages keep no state, so a fitted pipeline transforms a stream as it does a table."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def score_stream(rows: DataFrame, model: PipelineModel, out: str, checkpoint: str, columns: list[str] | None = None, once: bool = False) -> StreamingQuery:
    """Appends scores as Parquet; the checkpoint makes a restart continue where it stopped. once: stop when all that is there is scored."""
    scored = model.transform(rows)
    writer = (scored.select(*columns) if columns else scored).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
