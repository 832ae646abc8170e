"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are combined as log probabilities for each language: the text (naive Bayes over hashed
byte trigrams of the lower-cased text), the declared markup language, the address suffix, and a prior for the
host. The reliabilities of the last three are read from the corpus itself by grouped aggregation over all rows:
how often each declaration, suffix and host goes with each language that the text alone suggests. Host priors
are smoothed hierarchically (host, then registered domain, then the whole corpus).

Only the text model is fitted on a bounded sample of labelled rows (`sample`), shared among the labels so that a rare
language keeps all its rows beside frequent ones. One more hypothesis, `und`,
spreads text evenly over all trigrams; it wins for text that resembles no language.

Cases: a null or empty text has no text evidence, so the other evidence decides; null declarations, addresses and
hosts are no evidence. A row is rejected if `und` wins or the winner's probability is below `least`; a row with
neither text nor any other evidence is rejected. A longer text counts more, ever more slowly but without an upper bound.
The same letter three times running is learned for no language, so a text of one repeated letter is `und` whatever its label. Repeated rows are judged alike and all kept. Ties go to the language first in the
alphabet. An empty table gives an empty result. Further columns of any name are carried along untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Written, col, fresh, lean, table
from .vectext import BYTE_CODE, slices

UNKNOWN = "und"
_SPOKEN = np.zeros(256, bool)
_SPOKEN[[32, 39, *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class TextModel:
    """Log probabilities of trigram buckets: one row for each language, in alphabetical order."""

    languages: tuple[str, ...]
    table: np.ndarray

    @property
    def bits(self) -> int:
        return int(self.table.shape[1]).bit_length() - 1


def buckets(data: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of the trigram that begins at each byte but the last two."""
    code = (BYTE_CODE & np.uint64(0xFFFFFFFF)).astype(np.uint32)[data]
    x = code[:-2] * np.uint32(0x9E3779B1) + code[1:-1] * np.uint32(0x85EBCA77) + code[2:] * np.uint32(0xC2B2AE3D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    return x >> np.uint32(32 - bits)


def text_sums(column: pa.Array, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the summed row of `values` (languages, buckets) over its trigrams, and the trigrams' number.

    Only trigrams of letters, non-ASCII characters, blanks and apostrophes count: numbers, keys and mark-up say nothing."""
    bits = int(values.shape[1]).bit_length() - 1
    out, count = np.zeros((len(column), len(values))), np.zeros(len(column), np.int64)
    for at, rows, data, offsets in slices(column, most=1 << 18, lower=True):
        n = np.maximum(np.diff(offsets) - 2, 0)
        if len(data) < 3:
            continue
        ok = _SPOKEN[data]
        ok = ok[:-2] & ok[1:-1] & ok[2:]
        b = buckets(data, bits)
        full = np.flatnonzero(n)
        first, last = offsets[full], offsets[full] + n[full]
        sums = np.concatenate(([0], np.cumsum(ok)))
        count[at + full] = sums[last] - sums[first]
        for k, one in enumerate(values):
            sums = np.concatenate(([0.0], np.cumsum(one[b] * ok, dtype=np.float64)))
            out[at + full, k] = sums[last] - sums[first]
    return out, count


def part_of(numbers: list[int], sample: int, least: int) -> int:
    """The bound, `least` or more, with which labels of so many rows give `sample` rows in all."""
    left = sample
    for k, n in enumerate(sorted(numbers)):
        if n * (len(numbers) - k) > left:
            return max(least, left // (len(numbers) - k))
        left -= n
    return max(least, *numbers)


def fit_text_model(labelled: DataFrame, text: str, label: str, sample: int = 4000, bits: int = 14, alpha: float = 0.5, least_rows: int = 5) -> TextModel | None:
    """Fit on about `sample` labelled rows, chosen by a hash of text and label and so the same at every run.

    A label with no more rows than its part of the sample (100 at least) gives all of them, another one distinct texts. Labels with fewer
    than `least_rows` rows in the whole table are left out. None if no label is left."""
    rows = labelled.where(col(text).isNotNull() & col(label).isNotNull() & (F.length(col(text)) > 0)).select(col(text).alias("text"), col(label).cast("string").alias("label"))
    numbers = {r.label: (r.n, r.texts) for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.approx_count_distinct("text", 0.02).alias("texts")).where(F.col("n") >= least_rows).collect()}
    if not numbers:
        return None
    bound = part_of([n for n, _ in numbers.values()], sample, least=min(sample, 100))
    rates = [(name, None if n <= bound else math.ceil(min(1.0, bound / max(texts, 1)) * (1 << 40))) for name, (n, texts) in numbers.items()]
    rows = rows.join(F.broadcast(labelled.sparkSession.createDataFrame(rates, "label string, rate long")), "label")
    chance = F.xxhash64("text", "label")
    sampled = rows.where(F.pmod(chance, F.lit(1 << 40)) < F.col("rate")).withColumn("chance", chance).dropDuplicates(["label", "chance"])
    rows = rows.where("rate is null").select("text", "label").unionAll(sampled.select("text", "label"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            for name in set(names.tolist()):
                part = batch.column(0).filter(pa.array(names == name))
                into = totals.setdefault(name, np.zeros(1 << bits, np.int64))
                for _, _, data, offsets in slices(part, lower=True):
                    if len(data) >= 3:
                        ok = _SPOKEN[data]
                        ok = ok[:-2] & ok[1:-1] & ok[2:]
                        # no language is learned from one letter again and again
                        ok &= (data[:-2] == 32) | (data[:-2] != data[1:-1]) | (data[1:-1] != data[2:])
                        for back in (1, 2):
                            cut = offsets[1:-1] - back
                            ok[cut[(cut >= 0) & (cut < len(ok))]] = False
                        into += np.bincount(buckets(data, bits)[ok], minlength=1 << bits)
        for name, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["label", "bucket", "n"])

    with Written(labelled.sparkSession, "text-model").settings():
        found = rows.mapInArrow(lean(counted), "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(numbers))
    counts = np.zeros((len(languages), 1 << bits))
    for k, name in enumerate(languages):
        own = found[found.label == name]
        counts[k, own.bucket.to_numpy()] = own.n.to_numpy()
    return TextModel(languages, np.log((counts + alpha) / (counts.sum(1, keepdims=True) + alpha * (1 << bits))).astype(np.float32))


def effective(n: np.ndarray, weight: float, scale: float) -> np.ndarray:
    """For how many independent trigrams n neighbouring ones count: about weight * n of them at first, and ever more slowly more, without an upper bound."""
    return scale * np.log1p(n * weight / scale)


def text_scores(df: DataFrame, model: TextModel, text: str, weight: float = 0.25, scale: float = 60.0) -> DataFrame:
    """df with its text replaced by `scores`, the log likelihood of each language relative to `und`, tempered, and `has_text`. Texts are read in place and not moved."""
    bits, values, at = model.bits, model.table, df.columns.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, n = text_sums(batch.column(at), values)
            gain = sums + (n * bits * math.log(2))[:, None]
            gain *= (effective(n, weight, scale) / np.maximum(n, 1))[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, gain.size + 1, gain.shape[1], dtype=np.int32)), pa.array(gain.ravel()))
            has = pc.fill_null(pc.greater(pc.binary_length(batch.column(at)), 0), False)
            rest = [k for k in range(batch.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in rest], lists, has], names=[*[batch.schema.names[k] for k in rest], "scores", "has_text"])

    fields = [f for k, f in enumerate(df.schema.fields) if k != at]
    return df.mapInArrow(lean(scored), T.StructType([*fields, T.StructField("scores", T.ArrayType(T.DoubleType()), True), T.StructField("has_text", T.BooleanType(), True)]))


def domain_of(host: Column) -> Column:
    """The last two labels of a host; a host with fewer is its own domain."""
    return F.regexp_extract(F.lower(host), r"([^.]+\.)?[^.]*$", 0)


def suffix_of(host: Column) -> Column:
    return F.when(host.contains("."), F.regexp_extract(F.lower(host), r"[^.]*$", 0))


def beside(rows: DataFrame, facts: DataFrame, on: Column, languages: int, most_bytes: int = 32 << 20) -> DataFrame:
    """rows left joined with facts, a table of logs for each language: broadcast if it is counted to be small. Else both are shuffled; rows
    are narrow by then, and what a hot key brings to one partition is split by the adaptive join."""
    return rows.join(F.broadcast(facts) if facts.count() * (8 * languages + 100) <= most_bytes else facts, on, "left")


def judge(scored: DataFrame, names: tuple[str, ...], write: Written, smooth: float = 20.0, least: float = 0.5) -> DataFrame:
    """Rows with columns scores, has_text, host and declared, and others, to these others with language, probability and accepted."""
    rest = [c for c in scored.columns if c not in ("scores", "has_text", "host", "declared")]
    rows = scored.withColumns({"h": F.lower("host"), "d": F.lower(F.trim("declared"))})
    rows = write(rows.select(*rest, "scores", "has_text", "h", "d", suffix_of(F.col("h")).alias("s"), F.when(F.array_max("scores") > 0, F.array_position("scores", F.array_max("scores").cast("double")).cast("int") - 1).alias("guess")))
    # one pass: how often each host, declaration and suffix goes with each language that the text suggests
    counts = write(rows.where("guess is not null").groupBy("h", "d", F.col("guess").alias("l")).agg(F.count("*").alias("n")))
    each = range(len(names))

    def vectors(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key).agg(F.array(*[F.sum(F.when(F.col("l") == k, F.col("n")).otherwise(0)).cast("double") for k in each]).alias("c"))

    total = np.zeros(len(names))
    for r in counts.groupBy("l").agg(F.sum("n").alias("n")).collect():  # a row for each language
        total[r.l] = r.n
    prior = [float(x) for x in (total + 1) / (total.sum() + len(names))]
    sizes = [float(x) for x in total]

    def total_of(c: str) -> Column:
        return F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x)

    hosts = counts.where("h is not null").withColumn("dom", domain_of(F.col("h")))
    by_domain = vectors(hosts, "dom").select("dom", F.transform("c", lambda x, i: (x + smooth * F.get(F.lit(prior), i)) / (total_of("c") + smooth)).alias("pd"))
    by_host = vectors(hosts, "h").withColumn("dom", domain_of(F.col("h"))).join(by_domain, "dom").select(F.col("h").alias("own_h"), F.transform("c", lambda x, i: F.log((x + smooth * F.get("pd", i)) / (total_of("c") + smooth))).alias("hp"))

    def reliability(rows: DataFrame, key: str, name: str, out: str) -> DataFrame:
        """log P(value | language) for every value, smoothed towards the value's overall share."""
        n = float(total.sum()) or 1.0
        return vectors(rows, key).select(F.col(key).alias(name), F.transform("c", lambda x, i: F.log((x + smooth * total_of("c") / n) / (F.get(F.lit(sizes), i) + smooth))).alias(out))

    suffixes = counts.withColumn("s", suffix_of(F.col("h"))).where("s is not null").groupBy("s", "l").agg(F.sum("n").alias("n"))
    by_host, by_declared, by_suffix = write(by_host), write(reliability(counts.where("d is not null"), "d", "own_d", "dp")), write(reliability(suffixes, "s", "own_s", "sp"))
    write.drop(counts)
    result = beside(rows, by_host, F.col("h") == F.col("own_h"), len(names))
    result = beside(result, by_declared, F.col("d") == F.col("own_d"), len(names))
    result = beside(result, by_suffix, F.col("s") == F.col("own_s"), len(names))
    zero = F.lit(0.0)
    logs = F.transform("scores", lambda x, i: x + F.coalesce(F.get("hp", i), F.log(F.get(F.lit(prior), i))) + F.coalesce(F.get("dp", i), zero) + F.coalesce(F.get("sp", i), zero))
    # `und` has the mean reliability of every declaration and suffix: neither speaks for it
    mean = lambda c: F.coalesce(F.aggregate(F.col(c), zero, lambda a, x: a + x) / len(names), zero)
    result = result.withColumn("logs", F.concat(logs, F.array(F.lit(math.log(0.02)) + mean("dp") + mean("sp"))))
    result = result.withColumn("top", F.array_max("logs"))
    mass = F.aggregate("logs", zero, lambda a, x: a + F.exp(x - F.col("top")))
    seen = F.coalesce(F.col("has_text") | F.col("hp").isNotNull() | F.col("dp").isNotNull() | F.col("sp").isNotNull(), F.lit(False))
    language, probability = F.element_at(F.lit([*names, UNKNOWN]), F.array_position("logs", F.col("top")).cast("int")), 1 / mass
    return result.select(*rest, language.alias("language"), probability.alias("probability"), ((language != UNKNOWN) & (probability >= least) & seen).alias("accepted"))


def row_key(columns: list[str]) -> list[Column]:
    """Two hashes of what a judgement rests on; null and the empty text differ."""
    every = [x for c in columns for x in (col(c), col(c).isNull())]
    return [F.xxhash64(*every).alias("key_1"), F.xxhash64(F.lit(1), *reversed(every)).alias("key_2")]


def judgements(df: DataFrame, model: TextModel, text: str, declared: str | None, host: str | None, write: Written, **more: float) -> tuple[list[Column], DataFrame]:
    """The key of a row of df, and the judgement for each key: rows alike in text, declaration and host are judged alike."""
    none = F.lit(None).cast("string")
    key = row_key([c for c in (text, declared, host) if c])
    narrow = df.select(*key, col(text).alias("text"), (col(declared).cast("string") if declared else none).alias("declared"), (col(host).cast("string") if host else none).alias("host"))
    return key, judge(text_scores(narrow, model, "text"), model.languages, write, **more)


def identify(df: DataFrame, model: TextModel, text: str = "text", declared: str | None = None, host: str | None = None, **more: float) -> DataFrame:
    """df with columns language, probability and accepted (renamed with leading underscores if df has them already).

    declared: column with the declared language; host: column with the host (or another source name)."""
    write, keep = Written(df.sparkSession, "language"), df.columns
    key, judged = judgements(df, model, text, declared, host, write, **more)
    names = [fresh(keep, x) for x in ("key_1", "key_2", "own_1", "own_2", "language", "probability", "accepted")]
    judged = write(judged.dropDuplicates(["key_1", "key_2"])).toDF(*names[2:])
    a, b, x, y = (col(n) for n in names[:4])
    return df.withColumns(dict(zip(names, key))).join(judged, (a == x) & (b == y)).select(*[col(c) for c in [*keep, *names[4:]]])


def page_evidence(pages: DataFrame) -> DataFrame:
    """(doc_id, declared, host) of pages whose address ends in a document's number; one row for a document.

    Of all its pages' declarations the most frequent counts, and so of their hosts; ties go to the smallest page_id."""
    address = F.col("url")
    found = pages.select(
        F.expr("try_cast(nullif(regexp_extract(url, '://[^/?#]+/(?:[^?#]*/)?([0-9]{1,18})(?:[.]html)?/?(?:[?#].*)?$', 1), '') as bigint)").alias("page_doc"),
        F.lower(F.nullif(F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-zA-Z]+)", 1), F.lit(""))).alias("page_lang"),
        F.nullif(F.regexp_extract(address, r"://([^/?#:]+)", 1), F.lit("")).alias("page_host"),
        "page_id",
    ).where("page_doc is not null")
    each = found.select("page_doc", "page_id", F.explode(F.array(F.struct(F.lit(0).alias("of"), F.col("page_lang").alias("value")), F.struct(F.lit(1).alias("of"), F.col("page_host").alias("value")))).alias("x")).select("page_doc", "page_id", "x.of", "x.value")
    counts = each.where("value is not null").groupBy("page_doc", "of", "value").agg(F.struct((-F.count("*")).alias("n"), F.min("page_id").alias("p")).alias("place"))
    first = lambda k: F.min_by(F.when(F.col("of") == k, F.col("value")), F.when(F.col("of") == k, F.col("place")))
    return counts.groupBy("page_doc").agg(first(0).alias("page_lang"), first(1).alias("page_host"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its language, judged from its text and, where a page shows it, from the page's markup and address."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = fit_text_model(docs, "text", "lang")
    if model is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("probability"), F.lit(False).alias("accepted"))
    # texts are scored where they are read; what meets the pages is the scores
    scored = text_scores(docs.select("doc_id", "source", "text"), model, "text")
    evidence = page_evidence(table(spark, sf_dir, "pages"))
    joined = scored.join(evidence, scored.doc_id == evidence.page_doc, "left").select("doc_id", "scores", "has_text", F.coalesce("page_host", "source").alias("host"), F.col("page_lang").alias("declared"))
    return judge(joined, model.languages, Written(spark, "language")).select("doc_id", "language", F.round("probability", 6).alias("probability"), "accepted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are accepted; declared language and source are evidence beside the text. Only the keys of rejected ones meet the texts.

    Where no label has enough rows for a model, no language can be found: every document is `und` and none is accepted, as in op5."""
    model = fit_text_model(docs, "text", "lang")
    if model is None:
        return docs.where(F.lit(False))
    write, keep = Written(spark, "language"), docs.columns
    key, judged = judgements(docs, model, "text", "lang", "source", write)
    a, b, x, y = (fresh(keep, c) for c in ("key_1", "key_2", "own_1", "own_2"))
    out = write(judged.where("not accepted").select("key_1", "key_2").distinct()).toDF(x, y)
    return docs.withColumns(dict(zip((a, b), key))).join(out, (col(a) == col(x)) & (col(b) == col(y)), "left_anti").select(*[col(c) for c in keep])
