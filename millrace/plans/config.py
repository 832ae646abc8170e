"""The declarative configuration of a pipeline, and its checks before anything runs."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

STEPS = ("read", "sampling", "preprocessing", "featuregeneration", "vectorization", "modelling", "scoring", "metrics", "publish")
TEXT_STAGES = ("case_normalization", "sentence_marker", "regex_replacement", "regex_removal", "word_classes_replacement", "contractions_replacement", "lemma", "stopwords", "stemming", "tokenizer", "nullcheck")
BINNINGS = ("equidistant", "equiarea", "intervals")
VECTORIZERS = ("hashingtf", "count_vectorizer", "word2vec", "tfidf")
ALGORITHMS = ("logistic_regression", "svm", "random_forest", "gradient_boosted_trees", "decision_tree", "naive_bayes", "multilayer_perceptron")
TUNABLE = ("logistic_regression", "svm", "gradient_boosted_trees")
BUILD = {"binary": "binomial", "binomial": "binomial", "multinomial": "multinomial", "ovr": "ovr"}
METHODS = ("single_intent", "multi_intent", "single_intent_page_level", "single_intent_uplift", "single_intent_page_level_uplift", "multi_intent_page_level")
JOBS = ("model", "predict", "monitoring")
#: Every setting that a run reads, by section; anything else is an error, so that none is ignored.
SETTINGS: dict[str, tuple[str, ...]] = {
    "": ("project", "model", "job", "retrain", "method", "pages", "parallelism", "steps", "savepoints", "input", "roles", "sampling", "preprocessing", "binning", "grams", "vectorization", "algorithm", "hyperparameters", "hyperband", "cv", "scoring", "top_intents", "hotlead", "publish"),
    "input": ("source", "format", "queries", "prefix", "jdbc", "filter"),
    "roles": ("keys", "response", "text", "numerical", "categorical", "page", "treatment", "date", "random", "random_source", "top", "additional"),
    "sampling": ("type", "split", "conditions", "minimum_support", "other", "positive_percent", "balance"),
    "algorithm": ("type", "build", "calibrate", "parameters"),
    "hyperband": ("iterations", "iterMultiplier", "eta", "trainSize", "split"),
    "cv": ("folds", "metric"),
    "scoring": ("filter",),
    "hotlead": ("thresholds", "top"),
    "publish": ("format", "views", "decimals", "qa_visitors", "qa_format"),
}
DEFAULTS: dict[str, Any] = {"parallelism": 3, "job": "model", "method": "single_intent", "sampling": {"type": "random", "split": [80, 20]}, "steps": list(STEPS), "cv": {"folds": 1, "metric": "weightedPrecision"}, "hyperband": {"iterations": 81, "iterMultiplier": 20, "eta": 3, "trainSize": 0.8}}


class ConfigError(ValueError):
    """All problems found, one a line."""


@dataclass
class Config:
    values: dict[str, Any]
    problems: list[str] = field(default_factory=list)

    def get(self, path: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in path.split("."):
            if not isinstance(at, Mapping) or part not in at:
                return default
            at = at[part]
        return at

    def render(self) -> str:
        return json.dumps(self.values, indent=2, sort_keys=True)

    def pages(self) -> int:
        return int(self.get("pages", 0) or 0)

    def scoped(self, path: str, page: int | None = None) -> Any:
        """A setting for a page: one for all, or a list with one for each."""
        v = self.get(path)
        if page and self.get(f"{path}_scope") == "perPage":
            return v[min(page, len(v)) - 1]
        return v


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def text_of(path: str) -> str:
    """A small file of the driver's machine, or by an address with a scheme of any file system that Spark reaches."""
    if "://" not in path:
        return Path(path).read_text(encoding="utf-8")
    return SparkSession.active().read.text(path, wholetext=True).first()[0]


def load_config(source: str | Mapping[str, Any]) -> Config:
    own = json.loads(text_of(source)) if isinstance(source, str) else source
    config = Config(merged(DEFAULTS, own))
    validate(config)
    return config


def validate(config: Config) -> None:
    bad = config.problems
    get = config.get

    def require(ok: object, text: str) -> None:
        if not ok:
            bad.append(text)

    for section, names in SETTINGS.items():
        for k in (get(section) or {}) if section else config.values:
            require(k in names, f"unknown setting {section}{'.' if section else ''}{k}")
    require(get("job") in JOBS, f"job is one of {', '.join(JOBS)}")
    for name in ("project", "model"):
        require(re.fullmatch(r"[\w.\-]+", str(get(name, ""))), f"{name}: letters, digits, dots and dashes")
    require(get("method", "single_intent") in METHODS, f"method is one of {', '.join(METHODS)}")
    method = get("method", "single_intent")
    require(get("roles.response"), "roles.response is missing")
    require(get("roles.keys"), "roles.keys is missing")
    for s in get("steps"):
        require(s in STEPS, f"unknown step {s}")
    if "page_level" in method:
        require(config.pages() > 0 and get("roles.page"), "page-level methods need pages and roles.page")
    if "uplift" in method:
        require(get("roles.treatment"), "uplift needs roles.treatment")
        require(method.startswith("single"), "uplift is for one intent")
        require(get("algorithm.type") != "svm" or get("algorithm.calibrate"), "uplift needs probabilities: svm with algorithm.calibrate")
    if get("job") == "monitoring":
        require(get("algorithm.type") != "svm" or get("algorithm.calibrate"), "monitoring needs probabilities: svm with algorithm.calibrate")
    require(get("steps"), "steps is empty")
    if "publish" in get("steps") and get("publish.qa_visitors"):
        require("scoring" in get("steps"), "publish.qa_visitors needs the scoring step")
    kind = get("sampling.type")
    require(kind in ("random", "conditional", "stratified"), "sampling.type is random, conditional or stratified")
    require(not (kind == "stratified" and method.startswith("single")), "stratified sampling is for several intents")
    if kind == "conditional":
        require(get("sampling.conditions"), "conditional sampling needs conditions")
    else:
        require(sum(get("sampling.split")) <= 100, "sampling.split is in percent")
    percent = get("sampling.positive_percent")
    require(percent is None or 0 < percent < 50, "sampling.positive_percent is above 0 and below 50")
    require(percent is None or method.startswith("single"), "sampling.positive_percent is for one intent")
    require(get("sampling.balance", "random") in ("random", "conditional"), "sampling.balance is random or conditional")
    require(get("sampling.balance") != "conditional" or get("roles.random"), "sampling.balance conditional needs roles.random")
    known = {c for columns in get("roles", {}).values() for c in ([columns] if isinstance(columns, str) else columns or [])}
    for i, step in enumerate(get("preprocessing", [])):
        require(step.get("input") in known, f"preprocessing {i}: input {step.get('input')} is no role column and no earlier output")
        for t in step.get("transformations", []):
            require(t.get("type") in TEXT_STAGES, f"preprocessing {i}: unknown transformation {t.get('type')}")
        known.add(step.get("output"))
    for i, b in enumerate(get("binning", [])):
        require(b.get("type") in BINNINGS, f"binning {i}: type is one of {', '.join(BINNINGS)}")
        require(b.get("input") in known, f"binning {i}: unknown input {b.get('input')}")
        known.add(b.get("output"))
    for i, g in enumerate(get("grams", [])):
        require(g.get("input") in known, f"grams {i}: input {g.get('input')} is no output of preprocessing")
        require(g.get("type") in ("ngram", "skip_gram"), f"grams {i}: type is ngram or skip_gram")
        known.add(g.get("output"))
    if get("roles.categorical"):
        known.add("categorical_array")
    for i, v in enumerate(get("vectorization", [])):
        require(v.get("input") in known, f"vectorization {i}: unknown input {v.get('input')}")
        require(v.get("method") in VECTORIZERS, f"vectorization {i}: method is one of {', '.join(VECTORIZERS)}")
        require(isinstance(v.get("slots"), int) and v["slots"] > 0, f"vectorization {i}: slots is a positive number")
        known.add(v.get("output"))
    algorithm = get("algorithm.type", "logistic_regression")
    require(algorithm in ALGORITHMS, f"algorithm.type is one of {', '.join(ALGORITHMS)}")
    require(get("algorithm.build", "binary") in BUILD, "algorithm.build is binary, binomial, multinomial or ovr")
    ovr = get("algorithm.build") == "ovr"
    require(not ovr or method.startswith("multi"), "algorithm.build ovr is for several intents")
    require(not method.startswith("multi") or ovr or algorithm not in ("svm", "gradient_boosted_trees"), f"{algorithm} needs algorithm.build ovr for several intents")
    require(get("algorithm.build", "binary") in ("binary", "ovr") or algorithm == "logistic_regression", f"{algorithm} has no {get('algorithm.build')} family")
    require(not get("algorithm.calibrate") or algorithm in ("svm", "logistic_regression"), "algorithm.calibrate is for svm and logistic_regression")
    require(not get("top_intents") or method.startswith("multi") and (algorithm != "svm" or get("algorithm.calibrate")), "top_intents needs several intents and probabilities")
    require(not get("hotlead") or method.startswith("single") and (algorithm != "svm" or get("algorithm.calibrate")), "hotlead needs one intent and probabilities")
    require(get("hyperparameters") in (None, "hyperband", "cv"), "hyperparameters is hyperband or cv")
    require(get("cv.folds", 1) == 1 or get("hyperparameters") != "hyperband", "cv and hyperband exclude each other")
    require(get("hyperparameters") != "cv" or get("cv.folds", 1) > 1, "hyperparameters cv needs cv.folds above 1")
    require(get("cv.metric") in ("accuracy", "weightedPrecision", "weightedRecall", "f1"), "cv.metric is accuracy, weightedPrecision, weightedRecall or f1")
    require(get("hyperband.split", "random") in ("random", "stratified"), "hyperband.split is random or stratified")
    tunes = get("hyperparameters") == "hyperband" or get("cv.folds", 1) > 1
    lists = [k for k, v in get("algorithm.parameters", {}).items() if isinstance(v, list | Mapping) and k != "layers"]
    require(tunes or not lists, f"algorithm.parameters {', '.join(lists)}: several values need cv or hyperband")
    if get("hyperparameters") == "hyperband":
        require(algorithm in TUNABLE, f"{algorithm} has no hyperband ranges")
    require(get("publish.format", "native") in ("native", "js"), "publish.format is native or js")
    if bad:
        raise ConfigError("\n".join(bad))
