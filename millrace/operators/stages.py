"""Steps of a configured run as stages of one pipeline: fitted on the training part only, saved with it, and applied to raw rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions import text as T
from . import binning, journey, models


class Settings(Params):
    """One parameter, a JSON object, which is saved with the stage."""

    setting = Param(Params._dummy(), "setting", "what the stage does, as JSON values", TypeConverters.identity)

    def __init__(self, setting: Mapping[str, Any] | None = None):
        super().__init__()
        self._set(setting=dict(setting or {}))

    @property
    def values(self) -> dict[str, Any]:
        return self.getOrDefault(self.setting)


def resolved(stage: Mapping[str, Any]) -> dict[str, Any]:
    """A text stage with its word lists and rules in place of the files that have them."""
    kind, p = stage["type"], stage.get("parameter")
    if kind == "regex_replacement":
        p = [list(r) for r in D.rules(p)]
    elif kind == "regex_removal":
        p = D.word_list(p)
    elif kind == "word_classes_replacement":
        p = D.word_classes(p)
    elif kind in ("contractions_replacement", "lemma"):
        p = D.pairs(p)
    elif kind == "stopwords":
        p = D.stop_words(p or "english") if p is None or p in D.LANGUAGES else D.word_list(p)
    elif kind == "stemming":
        p = D.word_list(p) if p else []
    return {"type": kind, "parameter": p}


def text_chain(value: Column, chain: Sequence[Mapping[str, Any]]) -> Column:
    """The text stages in order on a column."""
    pattern = T.delimiter(next((t["parameter"] for t in chain if t["type"] == "tokenizer"), None))
    apply: dict[str, Callable[[Column, Any], Column]] = {
        "case_normalization": lambda v, p: T.lower_case(v),
        "sentence_marker": lambda v, p: T.mark_sentence(v),
        "regex_replacement": T.replace_patterns,
        "regex_removal": T.remove_patterns,
        "word_classes_replacement": T.replace_word_classes,
        "contractions_replacement": lambda v, p: T.substitute_words(v, p, pattern),
        "lemma": lambda v, p: T.substitute_words(v, p, pattern),
        "stopwords": lambda v, p: T.remove_stop_words(v, p, pattern),
        "stemming": lambda v, p: T.stem_words(v, p, pattern),
        "tokenizer": lambda v, p: T.tokenize(v, p or r"\s"),
        "nullcheck": lambda v, p: F.coalesce(v, F.lit(p)),
    }
    for t in chain:
        value = apply[t["type"]](value, t["parameter"])
    return value


class TextStage(Settings, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """input, output, chain: a chain of text stages; with a nullcheck, imputerCol_<input> is 1 too."""

    def _transform(self, df: DataFrame) -> DataFrame:
        v = self.values
        if any(t["type"] == "nullcheck" for t in v["chain"]):
            df = df.withColumn(f"imputerCol_{v['input']}", F.lit(1))
        return df.withColumn(v["output"], text_chain(F.col(v["input"]), v["chain"]))


class GramStage(Settings, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """input, output, type (ngram or skip_gram), parameter: tokens with their grams behind them."""

    def _transform(self, df: DataFrame) -> DataFrame:
        v, tokens = self.values, F.col(self.values["input"])
        made = [T.ngrams(tokens, n) for n in v["parameter"]] if v["type"] == "ngram" else [T.skip_grams(tokens, v["parameter"])]
        return df.withColumn(v["output"], T.assemble_grams(tokens, *made))


class CategoricalStage(Settings, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """inputs, output: one token for each categorical column that isn't null."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.values["output"], F.filter(T.categorical_array(self.values["inputs"]), lambda x: x.isNotNull()))


class IntervalStage(Settings, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """input, output, splits: the bin of a number."""

    def _transform(self, df: DataFrame) -> DataFrame:
        v = self.values
        return df.withColumn(v["output"], binning.intervals(F.col(v["input"]).cast("double"), v["splits"]))


class EquidistantBins(Settings, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """input, output, bins: borders from the fitted rows' smallest and largest value."""

    def _fit(self, df: DataFrame) -> IntervalStage:
        v = self.values
        return IntervalStage({"input": v["input"], "output": v["output"], "splits": binning.equidistant_splits(df, v["input"], v["bins"])})


class EquiareaBins(Settings, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """input, output, bins: borders from the fitted rows' quantiles, by a sketch of bounded size."""

    def _fit(self, df: DataFrame) -> IntervalStage:
        v = self.values
        return IntervalStage({"input": v["input"], "output": v["output"], "splits": binning.sketched_splits(df, v["input"], v["bins"])})


class DropStage(Settings, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """columns: intermediate ones that nothing after this stage reads."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.values["columns"])


class TopStage(Settings, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """labels, k: `top_intents`, the k most probable labels; prediction_label, the name of the predicted one."""

    def _transform(self, df: DataFrame) -> DataFrame:
        labels, k = self.values["labels"], self.values.get("k", 0)
        named = df.withColumn("prediction_label", F.get(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int")))
        return named.withColumn("top_intents", models.top_intents(vector_to_array("probability"), labels, k)) if k else named


class HotLeadStage(Settings, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """page, thresholds and, for time on page, top and top_thresholds: `is_hot`."""

    def _transform(self, df: DataFrame) -> DataFrame:
        v = self.values
        top = F.col(v["top"]) if v.get("top") else None
        page = F.col(v["page"]) if v.get("page") else F.lit(1)
        return df.withColumn("is_hot", journey.is_hot(F.get(vector_to_array("probability"), 1), page, v["thresholds"], top, v.get("top_thresholds")))


class _FolderWriter(MLWriter):
    def __init__(self, stage: Any):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        for k, one in enumerate(self.stage.inner):
            one.write().save(f"{path}/inner/{k:05d}")


class _FolderReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> Any:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.kind()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        stage.inner = [DefaultParamsReader.loadParamsInstance(f"{path}/inner/{k:05d}", self.sparkSession) for k in range(stage.values["inner"])]
        return stage


class Nested(Settings, MLWritable, MLReadable):
    """A stage with others inside, which are saved in its folder."""

    def __init__(self, setting: Mapping[str, Any] | None = None, inner: Sequence[Any] = ()):
        super().__init__({**(setting or {}), "inner": len(inner)})
        self.inner = list(inner)

    def write(self) -> MLWriter:
        return _FolderWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FolderReader(cls)

    def copy(self, extra: Any = None) -> Any:
        one = super().copy(extra)
        one.inner = [x.copy(extra) for x in self.inner]
        return one


class OneVsRestModel(Nested, Model):
    """A binary model for each class: raw scores are kept, and probabilities where the base has them."""

    def _transform(self, df: DataFrame) -> DataFrame:
        keep, has = df.columns, self.inner[0].hasParam("probabilityCol")
        raw, probability = [], []
        for k, m in enumerate(self.inner):
            extra = {m.rawPredictionCol: f"_raw{k}", m.predictionCol: f"_pred{k}"} | ({m.probabilityCol: f"_prob{k}"} if has else {})
            df = m.transform(df, extra).drop(f"_pred{k}")
            raw.append(F.get(vector_to_array(f"_raw{k}"), 1))
            probability.append(F.get(vector_to_array(f"_prob{k}"), 1) if has else None)
        out = df.withColumn("_scores", F.array(*raw))
        more = [array_to_vector("_scores").alias("rawPrediction"), (F.array_position("_scores", F.array_max("_scores")) - 1).cast("double").alias("prediction")]
        if has:
            p = F.array(*probability)
            more.append(array_to_vector(F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda a, b: a + b))).alias("probability"))
        return out.select(*keep, *more)


class OneVsRest(Nested, Estimator):
    """label, features, classes, parallelism; inside: the binary classifier. Classifiers are fitted on features and labels only."""

    def __init__(self, setting: Mapping[str, Any] | None = None, inner: Sequence[Any] = ()):
        super().__init__({"label": "label", "features": "features", "parallelism": 3, **(setting or {})}, inner)

    def hasParam(self, paramName: str) -> bool:
        return super().hasParam(paramName) or bool(getattr(self, "inner", [])) and self.inner[0].hasParam(paramName)

    def _fit(self, df: DataFrame) -> OneVsRestModel:
        v, base = self.values, self.inner[0]
        rows = df.select(v["label"], v["features"]).persist()
        try:
            classes = v.get("classes") or int(rows.agg(F.max(v["label"])).first()[0]) + 1

            def one(k: int) -> Model:
                return base.copy({base.labelCol: "_one"}).fit(rows.withColumn("_one", (F.col(v["label"]) == k).cast("double")))

            with ThreadPoolExecutor(v["parallelism"]) as pool:
                return OneVsRestModel({}, list(pool.map(one, range(classes))))
        finally:
            rows.unpersist()


class PlattModel(Settings, Model, DefaultParamsReadable, DefaultParamsWritable):
    """pairs (a, b): calibration of raw scores, one for each class or one for two classes."""

    def _transform(self, df: DataFrame) -> DataFrame:
        pairs, scores = self.values["pairs"], vector_to_array(self.values.get("raw", "rawPrediction"))
        if len(pairs) == 1:
            p = models.sigmoid(F.get(scores, 1), *pairs[0])
            return df.withColumn("probability", array_to_vector(F.array(1 - p, p)))
        out = df.withColumn("_p", F.array(*[models.sigmoid(F.get(scores, k), *ab) for k, ab in enumerate(pairs)])).withColumn("svm_prediction", F.col("prediction"))
        total = F.aggregate("_p", F.lit(0.0), lambda x, y: x + y)
        return out.withColumn("prediction", (F.array_position("_p", F.array_max("_p")) - 1).cast("double")).withColumn("probability", array_to_vector(F.transform("_p", lambda x: x / total))).drop("_p")


class Platt(Settings, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """label, classes, raw, regularization. Two classes: hard labels. More: one calibration for each class against the rest, with smoothed targets.

    Scores are computed once, and all classes are counted in one pass."""

    def _fit(self, df: DataFrame) -> PlattModel:
        v = {"label": "label", "raw": "rawPrediction", "regularization": 0.1, **self.values}
        rows = df.select(F.col(v["label"]).alias("y"), vector_to_array(v["raw"]).alias("raw")).persist()
        try:
            numbers = {int(r.y): r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row for each class
            classes, total = v.get("classes") or max(numbers) + 1, sum(numbers.values())
            pairs = []
            for k in [1] if classes == 2 else range(classes):
                one = rows.select(array_to_vector(F.array(F.get("raw", k))).alias("features"), (F.col("y") == k).cast("double").alias("y"))
                if classes > 2:
                    n = numbers.get(k, 0)
                    one = one.withColumn("y", models.platt_targets(F.lit(total - n), F.lit(n), F.col("y")))
                m = models.fit_soft_labels(one, "y", regParam=v["regularization"])
                pairs.append([float(m.coefficients[0]), float(m.intercept)])
            return PlattModel({"pairs": pairs, "raw": v["raw"]})
        finally:
            rows.unpersist()


class LinearModel(Settings, Model, HasFeaturesCol, HasRawPredictionCol, HasProbabilityCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """weights, intercept: a logistic model of given coefficients, such as those of a published one."""

    def _transform(self, df: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(float(w)) for w in self.values["weights"]])
        products = F.zip_with(vector_to_array(self.getFeaturesCol()), weights, lambda x, w: x * w)
        margin = F.aggregate(products, F.lit(0.0), lambda a, x: a + x) + F.lit(float(self.values["intercept"]))
        df = df.withColumn("_margin", margin)
        p = models.sigmoid(F.col("_margin"), 1.0, 0.0)
        made = {self.getRawPredictionCol(): array_to_vector(F.array(-F.col("_margin"), "_margin")), self.getProbabilityCol(): array_to_vector(F.array(1 - p, p)), self.getPredictionCol(): (F.col("_margin") > 0).cast("double")}
        return df.withColumns(made).drop("_margin")


class UpliftModel(Nested, Model):
    """treatment (place of the feature, -1 for the last): the models inside are applied with it at 0 and at 1; see models.uplift()."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return models.uplift(df, self.inner, self.values.get("treatment", -1))
