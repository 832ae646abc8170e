"""Concatenate and cut: texts, each followed by an end token, form one stream that is cut into windows of fixed length.

First pass: texts are sized once, their sizes written, ordered by id over range partitions, and each partition's tokens are summed. The
prefix sums of the partition totals, a row for each partition, give where each partition begins in the stream; prefix sums inside the partitions give
where each text begins. Second pass: every text goes to the windows that it touches, as boundary records: the text, the
token of it with which the window's part begins, the part's length and its place in the window. Windows hold
`window` tokens each but the last, which holds what is left.

Cases: null texts are left out; an empty text is its end token. Rows with a null id come first in the stream. Rows of equal id are
ordered by length, and rows equal in both are alike in the result. A text longer than a window fills several. An empty table
gives no windows. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Written, col, table
from .token_counts import VOCABULARY, token_counts

WINDOW = 2048


def pack(sizes: DataFrame, window: int = WINDOW, ident: str = "doc_id", tokens: str = "n_tokens") -> DataFrame:
    """(window_id, n_tokens, doc_ids, doc_starts, lengths, positions) from rows with an id and a number of tokens."""
    write = Written(sizes.sparkSession, "packing")
    # written first: the range partitioning below samples its input, and texts are to be sized once
    rows = write(sizes.where(col(tokens) > 0).select(col(ident).alias("id"), col(tokens).cast("long").alias("n")))
    ordered = write(rows.repartitionByRange("id", "n").withColumn("part", F.spark_partition_id()))
    write.drop(rows)
    totals = ordered.groupBy("part").agg(F.sum("n").alias("total"))
    begins = totals.select(F.col("part").alias("p"), (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("begin"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("id", "n").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = ordered.withColumn("inside", inside).join(begins, F.col("part") == F.col("p")).select("id", "n", (F.col("begin") + F.col("inside")).alias("at"))
    size = F.lit(window).cast("long")
    first, last = F.expr(f"at div {window}"), F.expr(f"(at + n - 1) div {window}")
    parts = placed.withColumn("window_id", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("at"), F.col("window_id") * size)
    end = F.least(F.col("at") + F.col("n"), (F.col("window_id") + 1) * size)
    parts = parts.select("window_id", F.struct((begin - F.col("window_id") * size).cast("int").alias("position"), "id", (begin - F.col("at")).alias("start"), (end - begin).cast("int").alias("length")).alias("r"))
    windows = parts.groupBy("window_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return windows.select("window_id", F.aggregate("r", F.lit(0), lambda a, x: a + x["length"]).alias("n_tokens"), F.col("r.id").alias("doc_ids"), F.col("r.start").alias("doc_starts"), F.col("r.length").alias("lengths"), F.col("r.position").alias("positions"))


def pack_texts(docs: DataFrame, window: int = WINDOW, ident: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end_tokens: int = 1) -> DataFrame:
    sized = token_counts(docs.select(col(ident).alias("id"), col(text).alias("text")), vocabulary=vocabulary)
    return pack(sized.select("id", (F.col("n_tokens") + end_tokens).alias("n_tokens")), window, "id")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_texts(docs)
