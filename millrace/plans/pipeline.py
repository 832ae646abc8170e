"""A configured run: read, split, then one pipeline from raw rows to scores for each page, fitted on the training part only; metrics and publishing.

Jobs: `model` fits and measures; `predict` scores new rows with the saved pipelines; `monitoring` compares new rows with those the model was made from."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, journey, metrics, models, publish, sampling
from ..operators import stages as S
from ..sources.readers import SavePoints, read, select_roles
from .config import STEPS, Config, load_config


def page_filter(config: Config, df: DataFrame, p: int | None) -> DataFrame:
    return df if p is None else journey.page_part(df, config.get("roles.page"), p, config.pages())


def split(config: Config, df: DataFrame) -> list[DataFrame]:
    kind, label, keys = config.get("sampling.type"), config.get("roles.response"), config.get("roles.keys")
    if support := config.get("sampling.minimum_support"):
        df = sampling.stabilize_classes(df, label, support, config.get("sampling.other", "other"))
    if kind == "conditional":
        source = config.get("roles.random_source") or keys[0]
        parts = sampling.conditional_split(sampling.with_random_variable(df, source, config.get("roles.random")), config.get("sampling.conditions"))
    elif kind == "stratified":
        parts = list(sampling.stratified_split(df, label, config.get("sampling.split")[0] / 100, F.xxhash64(F.lit(sampling.SEED), *keys)))
    else:
        parts = sampling.hash_split(df, config.get("sampling.split"), keys)
    if percent := config.get("sampling.positive_percent"):
        parts[0] = sampling.balance_conditional(parts[0], label, percent, config.get("roles.random")) if config.get("sampling.balance") == "conditional" else sampling.balance_random(parts[0], label, percent, keys)
    return parts


def feature_stages(config: Config) -> list[Any]:
    """Text, bins, grams, categorical tokens, vectors and their assembly, in this order."""
    made: list[str] = []
    out: list[Any] = []
    columns = list(config.get("roles.numerical", []) or [])
    for step in config.get("preprocessing", []):
        out.append(S.TextStage({"input": step["input"], "output": step["output"], "chain": [S.resolved(t) for t in step["transformations"]]}))
        made.append(step["output"])
    for b in config.get("binning", []):
        names = {"input": b["input"], "output": b["output"]}
        if b["type"] == "intervals":
            out.append(S.IntervalStage(names | {"splits": list(b["parameter"])}))
        else:
            out.append((S.EquidistantBins if b["type"] == "equidistant" else S.EquiareaBins)(names | {"bins": b["parameter"]}))
        columns.append(b["output"])
    for g in config.get("grams", []):
        out.append(S.GramStage({"input": g["input"], "output": g["output"], "type": g["type"], "parameter": g["parameter"]}))
        made.append(g["output"])
    if names := config.get("roles.categorical"):
        out.append(S.CategoricalStage({"inputs": list(names), "output": "categorical_array"}))
        made.append("categorical_array")
    for v in config.get("vectorization", []):
        out.append(models.vectorizer(v["method"], v["input"], v["output"], v["slots"]))
        columns.append(v["output"])
    treatment = config.get("roles.treatment")
    if "uplift" in config.get("method", ""):  # the last feature
        columns = [c for c in columns if c != treatment] + [treatment]
    out.append(models.assembler(columns))
    known = {c for v in config.get("roles").values() for c in ([v] if isinstance(v, str) else v or [])}
    drop = [c for c in made if c not in known]
    return [*out, S.DropStage({"columns": [*drop, *[v["output"] for v in config.get("vectorization", [])], *[f"{v['output']}_tf" for v in config.get("vectorization", []) if v["method"] == "tfidf"]]})]


def estimator_of(config: Config, classes: int, size: int | None) -> tuple[Any, Any]:
    """The classifier alone, and with one-vs-rest and calibration around it."""
    kind = config.get("algorithm.type", "logistic_regression")
    params = {k: v for k, v in config.get("algorithm.parameters", {}).items() if not isinstance(v, list | Mapping) or k == "layers"}
    base = models.classifier(kind, 2 if config.get("algorithm.build") == "ovr" else classes, size, **params)
    if kind == "logistic_regression" and config.get("algorithm.build") in ("binomial", "multinomial"):
        base = base.setFamily(config.get("algorithm.build"))
    whole: Any = S.OneVsRest({"classes": classes, "parallelism": config.get("parallelism")}, [base]) if config.get("algorithm.build") == "ovr" else base
    return base, Pipeline(stages=[whole, S.Platt({"classes": classes})]) if config.get("algorithm.calibrate") else whole


def fit(config: Config, train: DataFrame, points: SavePoints | None = None, page: int | None = None) -> PipelineModel:
    """One pipeline from raw rows to scores. Vectors are made once and, with save points, written; classifiers see features and labels only."""
    prepared = Pipeline(stages=feature_stages(config)).fit(train)
    response, keys = config.get("roles.response"), config.get("roles.keys")
    roles = [config.get(f"roles.{r}") for r in ("page", "treatment", "date", "random", "top")]
    columns = dict.fromkeys([*keys, *[c for c in roles if c], *(config.get("roles.additional") or []), response])
    rows = prepared.transform(train).select(*[c for c in columns if c in train.columns], "features")
    rows = points.save(rows, "vectorization", 0, page) if points and config.get("savepoints") else rows.persist()
    multi = config.get("method", "").startswith("multi")
    indexer = models.label_indexer(response, "label", multi).fit(rows)
    rows = indexer.transform(rows)
    kind = config.get("algorithm.type", "logistic_regression")
    size = rows.select(F.size(vector_to_array("features"))).first()[0] if kind == "multilayer_perceptron" else None
    base, estimator = estimator_of(config, len(indexer.labels), size)
    params = config.get("algorithm.parameters", {})
    if config.get("hyperparameters") == "hyperband":
        h = config.get("hyperband")
        model, _, _ = models.hyperband(rows, estimator, params, budget=h["iterations"], eta=h["eta"], multiplier=h["iterMultiplier"], train=h["trainSize"], parallelism=config.get("parallelism"), stratified=h.get("split") == "stratified", key=keys)
    elif config.get("cv.folds", 1) > 1:
        sink = (lambda held: points.append_predictions(held, f"cv{page or ''}")) if points else None
        model, table = models.cross_validate(rows, estimator, models.grid(kind, base, params), keys, config.get("cv.folds"), config.get("cv.metric"), parallelism=config.get("parallelism"), sink=sink)
        if points:
            points.save_metrics(train.sparkSession.createDataFrame(table), f"cv{page or ''}")
    else:
        model = estimator.fit(rows)
    rows.unpersist()
    chain: list[Transformer] = list(model.stages) if isinstance(model, PipelineModel) else [model]
    if "uplift" in config.get("method", ""):
        chain = [S.UpliftModel({"treatment": -1}, chain)]
    elif multi and (config.get("algorithm.calibrate") or kind != "svm"):
        chain.append(S.TopStage({"labels": list(indexer.labels), "k": config.get("top_intents", 0)}))
    if hot := config.get("hotlead.thresholds"):
        chain.append(S.HotLeadStage({"page": config.get("roles.page"), "thresholds": hot, "top": config.get("roles.top"), "top_thresholds": config.get("hotlead.top")}))
    return PipelineModel(stages=[*prepared.stages, indexer, *chain])


def score(config: Config, rows: DataFrame, fitted: Mapping[int | None, PipelineModel], labelled: bool) -> DataFrame:
    """Raw rows of all pages by their pages' pipelines, filtered and projected to keys, roles and scores. Without labels the label indexer is left out."""
    roles = [config.get(f"roles.{r}") for r in ("page", "date", "top", "response", "treatment")]
    wanted = [*config.get("roles.keys"), *[c for c in roles if c and c in rows.columns], *(config.get("roles.additional") or []), "label", "prediction_label", "top_intents", "is_hot", "svm_prediction"]
    scores = ["rawPrediction", "probability", "prediction"]
    if "uplift" in config.get("method", ""):
        scores += ["modelRawPrediction", "modelProbability", "modelPrediction"]
    parts = []
    for p, m in fitted.items():
        one = (m if labelled else publish.complete_pipeline(m)).transform(page_filter(config, rows, p))
        parts.append(one.select(*dict.fromkeys(c for c in [*wanted, *scores] if c in one.columns)))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if where := config.get("scoring.filter"):
        return out.where(where)
    return out.where(F.col(config.get("roles.response")).isNotNull()) if labelled else out


def measure(config: Config, scored: list[DataFrame], points: SavePoints) -> None:
    """Two classes: area and best threshold by page, and what hot leads capture. All: weighted metrics and a line for each class."""
    uplift = "uplift" in config.get("method", "")
    prediction, probability = ("modelPrediction", "modelProbability") if uplift else ("prediction", "probability")
    page, last = config.get("roles.page"), config.pages() or 1
    for i, s in enumerate(scored):
        points.save_metrics(metrics.weighted(s, "label", prediction), f"standard{i}")
        points.save_text(metrics.per_intent_report(s, "label", prediction), f"intents{i}")
        if config.get("method").startswith("single") and (probability in s.columns or "rawPrediction" in s.columns):
            value = F.get(vector_to_array(probability if probability in s.columns else "rawPrediction"), 1)
            rows = s.select("label", *config.get("roles.keys"), *([page] if page else []), *(["is_hot"] if "is_hot" in s.columns else []), value.alias("_score"))
            rows = rows if page else rows.withColumn("_page", F.lit(1))
            points.save_metrics(metrics.binary_by_page(rows, page or "_page", "_score", "label", last), f"pages{i}")
            if "is_hot" in s.columns and page:
                points.save_metrics(journey.hot_leads(rows, config.get("roles.keys"), page, "label", F.col("is_hot"), last), f"web{i}")


def source_rows(spark: SparkSession, config: Config) -> DataFrame:
    data = read(spark, config.get("input.source"), config.get("input.format", ""), config.get("input.queries", []), config.get("input.prefix", "table"), config.get("input.jdbc"))
    roles = {k: [v] if isinstance(v, str) else list(v) for k, v in config.get("roles").items() if v}
    if config.get("job") != "model":  # new rows need no response
        have = {c.lower() for c in data.columns}
        roles = {k: [c for c in v if c.lower() in have or k not in ("response", "random")] for k, v in roles.items()}
        return select_roles(data, roles, None, config.get("input.filter"))
    return select_roles(data, roles, config.get("roles.response"), config.get("input.filter"))


def pages_of(config: Config) -> list[int | None]:
    return list(range(1, config.pages() + 1)) if config.pages() else [None]


def publish_models(spark: SparkSession, config: Config, fitted: Mapping[int | None, PipelineModel], points: SavePoints) -> None:
    whole = {p: publish.complete_pipeline(m) for p, m in fitted.items()}
    if config.get("publish.format", "native") == "native":
        publish.save_native(whole, f"{points.base}/publish")
    else:
        code = publish.javascript(whole, config.get("publish.views"), config.get("hotlead.thresholds"), config.get("publish.decimals", 6))
        spark.createDataFrame([(code,)], "value string").coalesce(1).write.mode("overwrite").text(f"{points.base}/publish")


def run(spark: SparkSession, source: str | Mapping[str, Any], root: str) -> dict[str, Any]:
    """The steps that the configuration names, of its job. A step that isn't named, but whose result a later one needs, is read from its save point."""
    config = load_config(source)
    points = SavePoints(spark, root, config.get("project"), config.get("model"), str(config.get("retrain", "0")), config.get("job"))
    points.save_config(config.render())
    return {"model": run_model, "predict": run_predict, "monitoring": run_monitoring}[config.get("job")](spark, config, points)


def run_model(spark: SparkSession, config: Config, points: SavePoints) -> dict[str, Any]:
    first = min(STEPS.index(s) for s in config.get("steps"))
    named = set(config.get("steps"))
    out: dict[str, Any] = {"config": config}
    n = len(config.get("sampling.conditions") or []) if config.get("sampling.type") == "conditional" else 2 if config.get("sampling.type") == "stratified" else len(config.get("sampling.split"))
    save = config.get("savepoints") or first > 0
    scored: list[DataFrame] | None = None
    if first <= STEPS.index("scoring") and named - {"metrics", "publish"}:
        if first <= STEPS.index("sampling"):
            if "read" in named:
                rows = source_rows(spark, config)
                rows = points.save_input(rows) if save else rows
            else:
                rows = points.load_input()
            parts = split(config, rows)
            out["parts"] = [points.save(p, "sampling", i) for i, p in enumerate(parts)] if save or len(named) < len(STEPS) else parts
        else:
            out["parts"] = points.load_all("sampling", n)[0]
            out["classes"] = sampling.minority_majority(out["parts"][0], config.get("roles.response"))[:2]
    fits = named & {"preprocessing", "featuregeneration", "vectorization", "modelling"}
    if fits:
        out["models"] = {p: fit(config, page_filter(config, out["parts"][0], p), points, p) for p in pages_of(config)}
        for p, m in out["models"].items():
            points.save_pipeline(m, "modelling", p)
    elif named & {"scoring", "publish"}:
        out["models"] = {p: points.load_pipeline("modelling", p) for p in pages_of(config)}
    if "scoring" in named:
        scored = [points.save(score(config, part, out["models"], True), "scoring", i) for i, part in enumerate(out["parts"])]
    elif "metrics" in named:
        scored = points.load_all("scoring", n)[0]
    if scored is not None:
        out["scored"] = scored
    if "metrics" in named:
        measure(config, scored, points)
    if "publish" in named:
        publish_models(spark, config, out["models"], points)
        if visitors := config.get("publish.qa_visitors"):
            probability = "modelProbability" if "uplift" in config.get("method") else "probability"
            kept = [c for c in out["scored"][-1].columns if c in (*config.get("roles.keys"), config.get("roles.page"), probability)]
            keys = [*config.get("roles.keys"), *([config.get("roles.page")] if config.get("roles.page") else [])]
            points.save_sample(publish.qa_data(out["scored"][-1].select(*kept), out["parts"][-1], keys, visitors, config.get("roles.date"), probability).drop("features"), config.get("publish.qa_format", "json"))
    return out


def run_predict(spark: SparkSession, config: Config, points: SavePoints) -> dict[str, Any]:
    """New rows, which need no response, by the pipelines of the model job."""
    fitted = {p: points.load_pipeline("modelling", p) for p in pages_of(config)}
    scored = score(config, source_rows(spark, config), fitted, False)
    return {"config": config, "models": fitted, "scored": [points.save(scored, "scoring", 0)]}


def run_monitoring(spark: SparkSession, config: Config, points: SavePoints) -> dict[str, Any]:
    """Stability of scores by page, with the ranges left out, and of categorical variables, with their values, against the model job's training part."""
    made = SavePoints(spark, points.home.rsplit("/", 3)[0], config.get("project"), config.get("model"), str(config.get("retrain", "0")))
    page, base = config.get("roles.page"), made.load("sampling", 0)
    fitted = {p: points.load_pipeline("modelling", p) for p in pages_of(config)}
    new = source_rows(spark, config)
    scores = []
    for df in (base, new):
        one = score(config, df, fitted, False)
        keys = [journey.page_bucket(F.col(page), config.pages() or 10).alias("page")] if page else []
        scores.append(one.select(*keys, F.get(vector_to_array("probability"), 1).alias("score")))
    out: dict[str, Any] = {"config": config, "psi": drift.psi(scores[0], scores[1], "score", ["page"] if page else [])}
    points.save_metrics(out["psi"].withColumn("excluded", F.to_json("excluded")), "psi")
    if names := list(config.get("roles.categorical") or []):
        out |= {"vsi": drift.vsi(base, new, names), "values": drift.values_by_kind(base, new, names)}
        points.save_metrics(out["vsi"], "vsi")
        points.save(out["values"], "variable_values")
    return out
