"""Fitted pipelines for use elsewhere: native, as JavaScript, and samples to compare them by."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LinearSVCModel, LogisticRegressionModel
from pyspark.ml.feature import Bucketizer, CountVectorizerModel, HashingTF, IDFModel, RegexTokenizer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stages as S


def complete_pipeline(*parts: PipelineModel) -> PipelineModel:
    """All stages in order, tuned ones by their best model and without label indexers; nothing is fitted again."""
    stages: list[Transformer] = []
    for part in parts:
        for s in part.stages:
            s = getattr(s, "bestModel", s)
            stages += s.stages if isinstance(s, PipelineModel) else [] if isinstance(s, StringIndexerModel) else [s]
    return PipelineModel(stages=stages)


def save_native(models: Mapping[int | None, PipelineModel], root: str) -> list[str]:
    paths = []
    for page, model in models.items():
        paths.append(f"{root.rstrip('/')}/{'noPage' if page is None else f'page{page}'}")
        model.write().overwrite().save(paths[-1])
    return paths


def js(value: object) -> str:
    return json.dumps(value, ensure_ascii=True)


HELPERS = {
    "tokens": "function tokens(text, pattern) { return text.split(new RegExp(pattern)).filter(function (w) { return w.length > 0; }); }",
    "bucket": "function bucket(value, splits) { var k = 0; while (k + 1 < splits.length - 1 && value >= splits[k + 1]) { k += 1; } return k; }",
    "dot": "function dot(weights, x) { var s = 0; for (var i in x) { s += (weights[i] || 0) * x[i]; } return s; }",
    "counts": "function counts(words, vocabulary) { var x = {}; words.forEach(function (w) { var i = vocabulary[w]; if (i !== undefined) { x[i] = (x[i] || 0) + 1; } }); return x; }",
    "sigmoid": "function sigmoid(m) { return 1 / (1 + Math.exp(-m)); }",
    "normalized": "function normalized(p) { var s = p.reduce(function (a, x) { return a + x; }, 0); return p.map(function (x) { return x / s; }); }",
    "nGrams": 'function nGrams(t, n) { var out = []; for (var i = 0; i + n <= t.length; i++) { out.push(t.slice(i, i + n).join(" ")); } return out; }',
    # the public 32-bit murmur3 of UTF-8 bytes, seed 42
    "hashedCounts": "function hashedCounts(words, n) { function mixed(k) { k = Math.imul(k, 0xcc9e2d51); return Math.imul((k << 15) | (k >>> 17), 0x1b873593); } function hash(w) { var b = unescape(encodeURIComponent(w)), h = 42, i = 0, k; for (; i + 4 <= b.length; i += 4) { k = b.charCodeAt(i) | b.charCodeAt(i + 1) << 8 | b.charCodeAt(i + 2) << 16 | b.charCodeAt(i + 3) << 24; h ^= mixed(k); h = (h << 13) | (h >>> 19); h = (Math.imul(h, 5) + 0xe6546b64) | 0; } k = 0; for (var j = b.length - 1; j >= i; j--) { k = k << 8 | b.charCodeAt(j); } if (i < b.length) { h ^= mixed(k); } h ^= b.length; h = Math.imul(h ^ (h >>> 16), 0x85ebca6b); h = Math.imul(h ^ (h >>> 13), 0xc2b2ae35); return h ^ (h >>> 16); } var x = {}; words.forEach(function (w) { var i = ((hash(w) % n) + n) % n; x[i] = (x[i] || 0) + 1; }); return x; }",
    "skipGrams": 'function skipGrams(t, window) { var out = []; for (var k = 3; k <= window; k++) { for (var i = 0; i + k <= t.length; i++) { if (t[i] !== t[i + k - 1]) { out.push(t[i] + " & " + t[i + k - 1]); } } } return out; }',
}


def text_stage(kind: str, variable: str, parameter: object = None, pattern: str = "\\s") -> tuple[str, set[str]]:
    """One text stage as a statement, and the helpers that it needs. Stemming and word substitution have no JavaScript form."""
    v = variable
    if kind == "case_normalization":
        return f"{v} = {v}.toLowerCase();", set()
    if kind == "sentence_marker":
        return f'{v} = "_class_ss " + {v} + " _class_se";', set()
    if kind in ("regex_replacement", "word_classes_replacement"):
        return " ".join(f"{v} = {v}.replace(new RegExp({js(p.removeprefix('(?i)'))}, {js('gi' if p.startswith('(?i)') else 'g')}), {js(to)});" for p, to in parameter), set()
    if kind == "regex_removal":
        return " ".join(f'{v} = {v}.replace(new RegExp({js(p)}, "g"), "");' for p in parameter), set()
    if kind == "stopwords":
        return f"var stop = {js([w.lower() for w in parameter])}; {v} = tokens({v}, {js(pattern + '|~SP~')}).filter(function (w) {{ return stop.indexOf(w.toLowerCase()) < 0; }}).join({js('~SP~')});", {"tokens"}
    if kind == "tokenizer":
        return f"{v} = tokens({v}, {js((parameter or chr(92) + 's') + '|~SP~')});", {"tokens"}
    if kind == "nullcheck":
        return f"if ({v} === null || {v} === undefined) {{ {v} = {js(parameter)}; }}", set()
    if kind == "skip_gram":
        return f"{v} = skipGrams({v}, {int(parameter)});", {"skipGrams"}
    raise ValueError(f"{kind} can't be published as JavaScript")


def rounded(values: Sequence[float], decimals: int) -> list[float]:
    return [round(float(x), decimals) for x in values]


def stage_js(stage: Transformer, decimals: int) -> tuple[str, set[str]]:
    if isinstance(stage, RegexTokenizer):
        lower = ".toLowerCase()" if stage.getToLowercase() else ""
        return f"row[{js(stage.getOutputCol())}] = tokens(row[{js(stage.getInputCol())}]{lower}, {js(stage.getPattern())});", {"tokens"}
    if isinstance(stage, Bucketizer):
        splits = ["-Infinity" if x == float("-inf") else "Infinity" if x == float("inf") else repr(x) for x in stage.getSplits()]
        return f"row[{js(stage.getOutputCol())}] = bucket(row[{js(stage.getInputCol())}], [{', '.join(splits)}]);", {"bucket"}
    if isinstance(stage, CountVectorizerModel):
        return f"row[{js(stage.getOutputCol())}] = counts(row[{js(stage.getInputCol())}], {js({w: i for i, w in enumerate(stage.vocabulary)})}); row[{js(stage.getOutputCol() + '#')}] = {len(stage.vocabulary)};", {"counts"}
    if isinstance(stage, VectorAssembler):
        return f"(function () {{ var x = {{}}, at = 0; {js(stage.getInputCols())}.forEach(function (c) {{ var v = row[c], n = row[c + '#']; if (n === undefined) {{ x[at] = v; at += 1; }} else {{ for (var i in v) {{ x[at + Number(i)] = v[i]; }} at += n; }} }}); row[{js(stage.getOutputCol())}] = x; }})();", set()
    if isinstance(stage, LogisticRegressionModel):
        if stage.numClasses == 2:
            return f"row.probability = sigmoid(dot({js(rounded(stage.coefficients, decimals))}, row[{js(stage.getFeaturesCol())}]) + {round(stage.intercept, decimals)}); row.prediction = row.probability > {stage.getThreshold()} ? 1 : 0;", {"dot", "sigmoid"}
        rows = [rounded(r, decimals) for r in stage.coefficientMatrix.toArray()]
        return f"(function () {{ var w = {js(rows)}, b = {js(rounded(stage.interceptVector, decimals))}, m = w.map(function (r, k) {{ return dot(r, row[{js(stage.getFeaturesCol())}]) + b[k]; }}), top = Math.max.apply(null, m), e = m.map(function (x) {{ return Math.exp(x - top); }}), s = e.reduce(function (a, x) {{ return a + x; }}, 0); row.probability = e.map(function (x) {{ return x / s; }}); row.prediction = m.indexOf(top); }})();", {"dot"}
    if isinstance(stage, LinearSVCModel):
        return f"row.raw = dot({js(rounded(stage.coefficients, decimals))}, row[{js(stage.getFeaturesCol())}]) + {round(stage.intercept, decimals)}; row.prediction = row.raw > {stage.getThreshold()} ? 1 : 0;", {"dot"}
    return own_stage_js(stage, decimals)


def own_stage_js(stage: Transformer, decimals: int) -> tuple[str, set[str]]:
    """The stages of configured runs. In the row, a probability of two classes is one number, that of the positive class."""
    v = getattr(stage, "values", {})
    source, out = js(v.get("input")), js(v.get("output"))
    if isinstance(stage, S.DropStage):
        return "", set()
    if isinstance(stage, S.TextStage):
        lines, needs = [], set()
        pattern = next((t["parameter"] for t in v["chain"] if t["type"] == "tokenizer"), None) or r"\s"
        for t in v["chain"]:
            line, more = text_stage(t["type"], "x", t["parameter"], pattern)
            lines.append(line if t["type"] == "nullcheck" else f"if (x !== null && x !== undefined) {{ {line} }}")
            needs |= more
        return f"(function () {{ var x = row[{source}]; {' '.join(lines)} row[{out}] = x; }})();", needs
    if isinstance(stage, S.GramStage):
        if v["type"] == "skip_gram":
            return f"row[{out}] = row[{source}].concat(skipGrams(row[{source}], {int(v['parameter'])}));", {"skipGrams"}
        return f"row[{out}] = row[{source}].concat({', '.join(f'nGrams(row[{source}], {int(n)})' for n in v['parameter'])});", {"nGrams"}
    if isinstance(stage, S.CategoricalStage):
        return f"row[{out}] = {js(v['inputs'])}.filter(function (c) {{ return row[c] !== null && row[c] !== undefined; }}).map(function (c) {{ return c + '_' + row[c]; }});", set()
    if isinstance(stage, S.IntervalStage):
        return f"row[{out}] = {js([float(x) for x in v['splits']])}.filter(function (s) {{ return row[{source}] >= s; }}).length;", set()
    if isinstance(stage, HashingTF):
        to = js(stage.getOutputCol())
        return f"row[{to}] = hashedCounts(row[{js(stage.getInputCol())}], {stage.getNumFeatures()}); row[{js(stage.getOutputCol() + '#')}] = {stage.getNumFeatures()};", {"hashedCounts"}
    if isinstance(stage, IDFModel):
        a, b = stage.getInputCol(), stage.getOutputCol()
        return f"(function () {{ var idf = {js(rounded(stage.idf, decimals))}, x = {{}}; for (var i in row[{js(a)}]) {{ x[i] = row[{js(a)}][i] * idf[i]; }} row[{js(b)}] = x; row[{js(b + '#')}] = row[{js(a + '#')}]; }})();", set()
    if isinstance(stage, S.OneVsRestModel):
        features = js(stage.inner[0].getFeaturesCol())
        weights, intercepts = [rounded(m.coefficients, decimals) for m in stage.inner], rounded([m.intercept for m in stage.inner], decimals)
        line = f"row.raw = {js(weights)}.map(function (w, k) {{ return dot(w, row[{features}]) + {js(intercepts)}[k]; }}); row.prediction = row.raw.indexOf(Math.max.apply(null, row.raw));"
        return (line + " row.probability = normalized(row.raw.map(sigmoid));", {"dot", "sigmoid", "normalized"}) if stage.inner[0].hasParam("probabilityCol") else (line, {"dot"})
    if isinstance(stage, S.PlattModel):
        pairs = [rounded(p, decimals) for p in v["pairs"]]
        if len(pairs) == 1:
            return f"row.probability = sigmoid({pairs[0][0]} * row.raw + {pairs[0][1]});", {"sigmoid"}
        return f"(function () {{ var p = {js(pairs)}.map(function (ab, k) {{ return sigmoid(ab[0] * row.raw[k] + ab[1]); }}); row.svm_prediction = row.prediction; row.prediction = p.indexOf(Math.max.apply(null, p)); row.probability = normalized(p); }})();", {"sigmoid", "normalized"}
    if isinstance(stage, S.UpliftModel):
        made = [stage_js(m, decimals) for m in stage.inner]
        features, at = js(stage.inner[0].getFeaturesCol()), v.get("treatment", -1)
        at = at if at >= 0 else len(stage.inner[0].coefficients) + at
        body = " ".join(line for line, _ in made)
        run = f"[null, 0, 1].map(function (t) {{ var y = {{}}; for (var i in x) {{ y[i] = x[i]; }} if (t !== null) {{ y[{at}] = t; }} row[{features}] = y; {body} return [row.probability, row.prediction]; }})"
        return f"(function () {{ var x = row[{features}], p = {run}; row[{features}] = x; row.modelProbability = p[0][0]; row.modelPrediction = p[0][1]; row.probability = p[2][0] - p[1][0]; row.prediction = 1; }})();", set().union(*(n for _, n in made))
    if isinstance(stage, S.TopStage):
        k = int(v.get("k", 0))
        line = f"row.prediction_label = {js(v['labels'])}[row.prediction];"
        return line + (f" row.top_intents = row.probability.map(function (p, i) {{ return {{label: {js(v['labels'])}[i], probability: p, at: i}}; }}).sort(function (a, b) {{ return b.probability - a.probability || a.at - b.at; }}).slice(0, {k});" if k else ""), set()
    if isinstance(stage, S.HotLeadStage):
        page = f"row[{js(v['page'])}]" if v.get("page") else "1"
        of = lambda values: f"{js(values)}[Math.max(1, Math.min({page}, {len(values)})) - 1]"
        top = f" && row[{js(v['top'])}] >= {of(v.get('top_thresholds') or [0.0])}" if v.get("top") else ""
        return f"row.is_hot = row.probability >= {of(v['thresholds'])}{top};", set()
    raise ValueError(f"{type(stage).__name__} can't be published as JavaScript")


def javascript(models: Mapping[int | None, PipelineModel], views: Mapping[str, str] | None = None, thresholds: Sequence[float] | None = None, decimals: int = 6) -> str:
    """One function score(row) with a branch for each page; the last page's branch takes all later ones. Helpers appear once.

    views: for each variable the name under which the caller's row has it. thresholds: adds `hot` by page."""
    helpers: set[str] = set()
    branches = []
    pages = sorted(models, key=lambda p: p or 0)
    for p in pages:
        lines = []
        for stage in models[p].stages:
            line, needs = stage_js(stage, decimals)
            helpers |= needs
            lines.append("    " + line)
        if thresholds:
            lines.append(f"    row.hot = row.probability >= {thresholds[min(len(thresholds), p or 1) - 1]};")
        test = "true" if p is None else f"row.page {'>=' if p == pages[-1] else '==='} {p}"
        branches.append(f"if ({test}) {{\n" + "\n".join(lines) + "\n  }")
    renames = "".join(f"  row[{js(k)}] = row[{js(v)}];\n" for k, v in (views or {}).items())
    code = "\n".join(HELPERS[h] for h in sorted(helpers)) + f"\nfunction score(row) {{\n{renames}  " + " else ".join(branches) + "\n  return row;\n}\n"
    if thresholds:  # one rule over all pages, for a row that has been scored
        limit = [thresholds[min(len(thresholds), p or 1) - 1] for p in pages]
        rules = [f"(row.probability >= {t}" + ("" if p is None else f" && row.page {'>=' if p == pages[-1] else '==='} {p}") + ")" for p, t in zip(pages, limit)]
        code += "function isHot(row) { return " + " || ".join(rules) + "; }\n"
    return code


def busiest_date(df: DataFrame, date: str) -> object:
    row = df.groupBy(date).agg(F.count("*").alias("n")).orderBy(F.desc("n"), date).first()
    return row[0] if row else None


def sample_visitors(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """All rows of the first n visitors in the order of their keys."""
    return df.join(df.select(*keys).distinct().orderBy(*keys).limit(n), list(keys), "left_semi")


def positive_probability(probability: str = "probability") -> Column:
    return F.get(vector_to_array(probability), 1)


def qa_data(scored: DataFrame, source: DataFrame, keys: Sequence[str], n: int, date: str | None = None, probability: str = "probability", visitor: Sequence[str] | None = None) -> DataFrame:
    """Inputs of the first n visitors (their rows of the busiest date, if there is a date) with their positive probability. keys: what a row is joined by; visitor: those of them that name a visitor, all if not given."""
    rows = source.where(F.col(date) == F.lit(busiest_date(source, date))) if date else source
    return sample_visitors(rows, visitor or keys, n).join(scored.select(*keys, positive_probability(probability).alias("positive_probability")), list(keys))
