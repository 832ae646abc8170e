import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import CountVectorizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from millrace.operators import binning, drift, journey, metrics, models, publish, ranks, sampling, stages


def test_random_variable_known_values(spark):
    rows = spark.createDataFrame([("ffffffff-x",), ("00000000",), ("80000000",)], "v string")
    got = [r.x for r in rows.select(sampling.random_variable(F.col("v")).alias("x")).collect()]
    assert got[0] == 100 and got[1] == 0 and abs(got[2] - 50) < 1e-6
    again = sampling.with_random_variable(spark.createDataFrame([("a", None), ("b", 3)], "v string, rv int"), "v", "RV")
    assert all(r.RV is not None and r.RV != 3 for r in again.collect())
    kept = sampling.with_random_variable(spark.createDataFrame([("a", 7)], "v string, rv int"), "v", "rv").first()
    assert kept.rv == 7.0


def test_splits(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(90)], "i int, y int")
    train, test = sampling.stratified_split(df, "y", 0.75, F.col("i"))
    assert [r["count"] for r in train.groupBy("y").count().orderBy("y").collect()] == [23, 23, 23] and test.count() == 21
    rounded, _ = sampling.stratified_split(df, "y", 0.75, F.col("i"), tenths=True)
    assert rounded.count() == 72
    twice = df.unionAll(df)
    assert sampling.remaining(twice, train).count() == 21 and sampling.remaining(twice, train, ["i"]).count() == 42
    parts = sampling.random_split(df, [0.5, 0.5])
    assert sum(p.count() for p in parts) == 90
    stable = sampling.stabilize_classes(spark.createDataFrame([("a",)] * 5 + [("b",), (None,)], "y string"), "y", 3, "rest")
    assert sorted(r.y for r in stable.collect()) == ["a"] * 5 + ["rest"] * 2


@pytest.mark.parametrize("percent,want", [(20, (0, 10 / 90 * 4)), (10, (1, 0.0)), (4, (2, 10 / 4 / 90 * 100 - 2))])
def test_balance_plan(percent, want):
    copies, fraction = sampling.balance_plan(10, 100, percent)
    assert copies == want[0] and math.isclose(fraction, want[1], abs_tol=1e-9)


def test_balance(spark):
    df = spark.createDataFrame([(i, int(i < 10), float(i)) for i in range(100)], "i int, y int, rv double")
    out = sampling.balance_conditional(df, "y", 20, "rv")
    assert out.where("y = 1").count() == 10 and abs(out.where("y = 0").count() - 40) <= 1
    assert sampling.balance_random(df, "y", 4).where("y = 0").count() >= 180
    with pytest.raises(ValueError):
        sampling.balance_plan(1, 10, 50)


def test_metrics_against_counting(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), rng.randrange(3), round(rng.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, p int, s double")
    by = {r["class"]: r for r in metrics.by_class(df, "y", "p").collect()}
    for c in range(3):
        tp = sum(y == p == c for y, p, _ in rows)
        assert by[c].tp == tp and by[c].fp == sum(p == c != y for y, p, _ in rows)
        assert math.isclose(by[c].recall, tp / sum(y == c for y, _, _ in rows))
    assert math.isclose(metrics.weighted(df, "y", "p").first().accuracy, sum(y == p for y, p, _ in rows) / 300)
    pos, neg = [s for y, _, s in rows if y], [s for y, _, s in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert math.isclose(metrics.auroc(df, "s", "y").first().auroc, want)
    best = metrics.best_threshold(metrics.threshold_curve(df, "s", "y")).first()
    brute = []
    for t in {s for _, _, s in rows}:
        tp, n = sum(y > 0 and s >= t for y, _, s in rows), sum(s >= t for _, _, s in rows)
        p, r = tp / n, tp / len(pos)
        brute.append((5 * p * r / (4 * p + r) if tp else 0, t))
    assert math.isclose(best.f2, max(brute)[0])
    assert metrics.per_intent_report(df, "y", "p").count() == 3
    assert metrics.weighted(df.limit(0), "y", "p").first().accuracy is None


def test_stability(spark):
    rows = [(k, float(i)) for k in (1, 2) for i in range(50)]
    base = spark.createDataFrame(rows, "page int, score double")
    same = {r.page: r for r in drift.psi(base, base, "score", ["page"]).collect()}
    assert abs(same[1].psi) < 1e-9 and same[2].buckets == 10
    moved = drift.psi(base, base.where("score < 25"), "score").first()
    assert moved.buckets == 6 and moved.psi > 0
    r = drift.vsi(spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "v string"), spark.createDataFrame([("a",), ("b",), ("b",), ("d",)], "v string"), ["v"]).first()
    assert (r.n_common, r.n_missing, r.n_new) == (2, 1, 1) and math.isclose(r.vsi, 100 * 2 * (2 / 3 - 1 / 3) * math.log(2))


def test_journey(spark):
    rows = [("a", 1, 0, 0.1, 0.0), ("a", 2, 1, 0.9, 5.0), ("b", 1, 0, 0.8, 9.0), ("c", 7, 1, 0.95, 30.0)]
    df = spark.createDataFrame(rows, "v string, page int, y int, p double, spent double")
    assert [r.top for r in journey.time_on_page(df, ["v"], "page", "spent", "top").orderBy("v", "page").collect()] == [5.0, None, None, None]
    hot = journey.is_hot(F.col("p"), F.col("page"), [0.7, 0.9])
    found = {r.page: r for r in journey.hot_leads(df, ["v"], "page", "y", hot, 2).collect()}
    assert found[1].hot_leads == 1 and found[1].captured == 0 and found[2].hot_leads == 2 and found[2].captured == 2 and found[2].visitors == 3 and found[2].capture_rate == 1.0
    assert journey.first_pages(df, "page", 2).count() == 2 and journey.page_part(df, "page", 2, 2).count() == 2
    strict = journey.is_hot(F.col("p"), F.col("page"), [0.7], F.col("spent"), [6.0])
    assert df.where(strict).count() == 2


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        y = i % 3
        rows.append((i, float(y), [rng.gauss(2 * (y == 1), 0.4), rng.gauss(2 * (y == 2), 0.4), float(i % 2)]))
    df = spark.createDataFrame(rows, "id int, label double, x array<double>").select("id", "label", F.get("x", 0).alias("a"), F.get("x", 1).alias("b"), F.get("x", 2).alias("t"))
    return models.assembler(["a", "b", "t"]).transform(df).cache()


def test_one_vs_rest_platt_and_top(spark, points):
    for base in (models.classifier("svm", maxIter=20), models.classifier("logistic_regression", maxIter=20)):
        out = stages.OneVsRest({"classes": 3}, [base]).fit(points).transform(points)
        assert metrics.weighted(out, "label", "prediction").first().accuracy > 0.8
        platt = stages.Platt({"classes": 3}).fit(out).transform(out)
        assert metrics.weighted(platt, "label", "prediction").first().accuracy > 0.8
        top = platt.select("prediction", models.top_intents(vector_to_array("probability"), ["x", "y", "z"], 2).alias("k")).first()
        assert len(top.k) == 2 and top.k[0].label == "xyz"[int(top.prediction)]


def test_binary_platt_is_monotone(spark, points):
    two = points.where("label < 2")
    scored = models.classifier("svm", maxIter=20).fit(two).transform(two)
    out = stages.Platt({"classes": 2}).fit(scored).transform(scored)
    rows = out.select(F.get(vector_to_array("rawPrediction"), 1).alias("r"), publish.positive_probability().alias("p")).orderBy("r").collect()
    assert all(a.p <= b.p + 1e-12 for a, b in zip(rows, rows[1:]))


def test_soft_labels_equal_newton(spark):
    rng = random.Random(5)
    rows = [(x := rng.random(), 0.997 if rng.random() < x else 0.025) for _ in range(500)]
    df = models.assembler(["x"]).transform(spark.createDataFrame(rows, "x double, y double"))
    m = models.fit_soft_labels(df, "y", maxIter=100)
    a = b = 0.0
    for _ in range(50):
        p = [1 / (1 + math.exp(-(a * x + b))) for x, _ in rows]
        g = [sum((q - y) * x for q, (x, y) in zip(p, rows)), sum(q - y for q, (_, y) in zip(p, rows))]
        w = [q * (1 - q) for q in p]
        h = [sum(v * x * x for v, (x, _) in zip(w, rows)), sum(v * x for v, (x, _) in zip(w, rows)), sum(w)]
        d = h[0] * h[2] - h[1] ** 2
        a, b = a - (h[2] * g[0] - h[1] * g[1]) / d, b - (h[0] * g[1] - h[1] * g[0]) / d
    assert abs(m.coefficients[0] - a) < 1e-3 * abs(a) and abs(m.intercept - b) < 1e-2


def test_uplift_is_the_difference_of_two_scores(spark, points):
    two = points.where("label < 2")
    model = models.classifier("logistic_regression", maxIter=10).fit(two)
    r = models.uplift(two, model, 2).first()
    c, b = model.coefficients, model.intercept
    x = r.features
    s = lambda t: 1 / (1 + math.exp(-(c[0] * x[0] + c[1] * x[1] + c[2] * t + b)))
    assert math.isclose(r.probability[1], s(1) - s(0), abs_tol=1e-9) and r.prediction == 1.0 and "modelProbability" in r


def test_nested_stages_are_saved_with_what_is_inside(spark, points, tmp_path):
    two = points.where("label < 2")
    ovr = Pipeline(stages=[stages.OneVsRest({"classes": 3}, [models.classifier("svm", maxIter=5)]), stages.Platt({"classes": 3}), stages.TopStage({"labels": ["x", "y", "z"], "k": 2})]).fit(points)
    up = PipelineModel(stages=[stages.UpliftModel({"treatment": -1}, [models.classifier("svm", maxIter=5).fit(two), stages.PlattModel({"pairs": [[1.0, 0.0]]})]), stages.HotLeadStage({"page": None, "thresholds": [0.1]})])
    for k, m in enumerate((ovr, up)):
        m.write().overwrite().save(f"{tmp_path}/{k}")
        again = PipelineModel.load(f"{tmp_path}/{k}")
        rows = points if m is ovr else two
        assert sorted(map(str, again.transform(rows).collect())) == sorted(map(str, m.transform(rows).collect()))
    top = ovr.transform(points).first()
    assert top.prediction_label == top.top_intents[0].label and "svm_prediction" in top


def test_one_vs_rest_is_tuned_with_its_calibration(spark, points):
    base, held = models.classifier("svm", maxIter=3), []
    whole = Pipeline(stages=[stages.OneVsRest({"classes": 3}, [base]), stages.Platt({"classes": 3})])
    best, table = models.cross_validate(points, whole, models.grid("svm", base, {"regParam": [0.01, 100.0]}), ["id"], folds=2, sink=lambda df: held.append(df.count()))
    assert sum(held) == 400 and len(table) == 4 and "probability" in best.transform(points).columns
    assert models.draw({"a": {"min": 2, "max": 5}, "b": {"min": 0.0, "max": 1.0}}, random.Random(1), lambda n: n == "a")["a"] in (2, 3, 4, 5)
    tree = models.classifier("gradient_boosted_trees")
    assert models.whole_number(tree, "maxDepth") and not models.whole_number(tree, "stepSize")
    _, _, log = models.hyperband(points.where("label < 2"), tree, {"maxDepth": {"min": 1, "max": 2}}, budget=3, multiplier=2, stratified=True, key=["id"])
    assert all(x["maxDepth"] in (1, 2) for x in log)


@pytest.mark.parametrize("parts", [2, 7, 50])
def test_running_sums_are_those_of_one_window(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randrange(40)), float(i)]), rng.randrange(5), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o double, v int, i int").groupBy("k", "o").agg(F.sum("v").alias("v"))
    for keys in ([], ["k"]):
        one = df if keys else df.groupBy("o").agg(F.sum("v").alias("v"))
        for down in (False, True):
            found = {(r.k if keys else 0, r.o): r.s for r in ranks.before(one, F.col("o"), {"s": F.col("v")}, keys, descending=down, parts=parts).collect()}
            rest = one.collect()
            place = lambda r: (r.o is not None, r.o or 0.0)
            want = {(r.k if keys else 0, r.o): sum(x.v for x in rest if (not keys or x.k == r.k) and (place(x) > place(r) if down else place(x) < place(r))) for r in rest}
            assert found == want


def test_exact_and_sketched_borders(spark):
    rng = random.Random(2)
    values = [float(rng.randrange(1000)) for _ in range(999)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    want = np.quantile(values, [0.25, 0.5, 0.75]).tolist()
    assert np.allclose(binning.exact_splits(df, "v", 4), want)
    assert np.allclose(binning.sketched_splits(df, "v", 4), want, atol=10)
    assert binning.exact_splits(df.limit(0), "v", 4) == [] and binning.equidistant_splits(df.limit(0), "v", 4) == []


def test_hash_split_and_copies(spark):
    df = spark.createDataFrame([(i, int(i < 300)) for i in range(1000)], "i int, y int")
    parts = sampling.hash_split(df, [50, 30, 20], ["i"])
    assert [p.count() for p in parts] == [p.count() for p in sampling.hash_split(df, [50, 30, 20], ["i"])] and sum(p.count() for p in parts) == 1000
    assert abs(parts[0].count() - 500) < 60 and not parts[0].join(parts[1], "i").count()
    copied = sampling.balance_random(df, "y", 10, ["i"]).groupBy("i", "y").count().collect()
    assert {r["count"] for r in copied if r.y} == {1} and {r["count"] for r in copied if not r.y} == {4, 5}


def test_tuning(spark, points):
    lr = models.classifier("logistic_regression", maxIter=5)
    best, table = models.cross_validate(points, lr, models.grid("logistic_regression", lr, {"regParam": [0.0, 1.0]}), ["id"], folds=2)
    assert {(x["fold"], x["map"]) for x in table} == {(0, 0), (0, 1), (1, 0), (1, 1)} and best.hasSummary is not None
    assert models.brackets(81, 3)[0] == [(81, 1.0), (27, 3.0), (9, 9.0), (3, 27.0), (1, 81.0)]
    _, params, log = models.hyperband(points, lr, {"regParam": {"min": 0.0, "max": 0.1}}, budget=3, multiplier=3)
    assert 0 <= params["regParam"] <= 0.1 and len(log) >= 4
    with pytest.raises(ValueError):
        models.hyperband(points, models.classifier("naive_bayes"), {})
    pages = models.page_models(points.withColumn("page", F.col("id") % 3 + 1), "page", [1, 2], lr.fit)
    assert set(pages) == {1, 2}


def murmur3(data, seed=42):
    """What the published script does, step by step."""
    h, whole = seed, 0xFFFFFFFF
    mixed = lambda k: (((k := k * 0xCC9E2D51 & whole) << 15 | k >> 17) & whole) * 0x1B873593 & whole
    for i in range(0, len(data) - 3, 4):
        h ^= mixed(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & whole) * 5 + 0xE6546B64 & whole
    if tail := data[len(data) // 4 * 4 :]:
        h ^= mixed(int.from_bytes(tail, "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & whole
    h = (h ^ h >> 13) * 0xC2B2AE35 & whole
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_published_script_of_a_whole_pipeline(spark):
    words = ["tea", "river stone", "é漢字", "a", "", "abcd", "abcde"]
    df = spark.createDataFrame([(w, [w], float(i % 2), i, "s" if i else None) for i, w in enumerate(words)], "text string, w array<string>, label double, n int, c string")
    slots = [r.f.indices[0] for r in models.vectorizer("hashingtf", "w", "f", 1000).transform(df).select("f").collect()]
    assert [int(x) for x in slots] == [murmur3(w.encode()) % 1000 for w in words]
    first = [stages.TextStage({"input": "text", "output": "t", "chain": [stages.resolved({"type": k, **p}) for k, p in (("case_normalization", {}), ("stopwords", {}), ("tokenizer", {}))]}), stages.GramStage({"input": "t", "output": "g", "type": "ngram", "parameter": [2]}), stages.CategoricalStage({"inputs": ["c"], "output": "cats"}), stages.IntervalStage({"input": "n", "output": "bin", "splits": [1.0, 3.0]}), models.vectorizer("hashingtf", "g", "tf", 16), models.assembler(["n", "bin", "tf"])]
    rows = PipelineModel(stages=first).transform(df)
    svm = models.classifier("svm", maxIter=2).fit(rows)
    lr = models.classifier("logistic_regression", maxIter=2)
    platt = stages.PlattModel({"pairs": [[1.0, 0.5]]})
    up = PipelineModel(stages=[*first, stages.UpliftModel({"treatment": -1}, [svm, platt]), stages.HotLeadStage({"page": None, "thresholds": [0.2]})])
    many = PipelineModel(stages=[*first, stages.OneVsRest({"classes": 2}, [lr]).fit(rows), stages.PlattModel({"pairs": [[1.0, 0.0], [0.5, 0.1]]}), stages.TopStage({"labels": ["x", "y"], "k": 2})])
    for m, has in ((up, ["modelProbability", "is_hot", "hashedCounts", "toLowerCase"]), (many, ["normalized", "top_intents", "svm_prediction", "nGrams"])):
        code = publish.javascript({None: m}, thresholds=[0.5])
        assert all(x in code for x in has) and "function isHot" in code and code.count("{") == code.count("}") and code.count("(") == code.count(")")
    with pytest.raises(ValueError):
        publish.stage_js(models.label_names("label", ["x", "y"], "name"), 3)


def test_publish(spark, points, tmp_path):
    tokens = RegexTokenizer(inputCol="text", outputCol="w", pattern=r"\s")
    df = spark.createDataFrame([("a b", 0.0), ("b c", 1.0), ("c c", 1.0)], "text string, label double")
    cv = CountVectorizer(inputCol="w", outputCol="tf").fit(tokens.transform(df))
    rows = models.assembler(["tf"]).transform(cv.transform(tokens.transform(df)))
    lr = models.classifier("logistic_regression", maxIter=5).fit(rows)
    whole = publish.complete_pipeline(PipelineModel(stages=[tokens, cv]), PipelineModel(stages=[models.assembler(["tf"]), lr]))
    code = publish.javascript({1: whole, 2: whole}, {"text": "view"}, [0.5, 0.7], decimals=3)
    assert code.count("function tokens") == 1 and "row.page === 1" in code and "row.page >= 2" in code and "row.hot" in code
    paths = publish.save_native({None: whole}, str(tmp_path))
    again = PipelineModel.load(paths[0]).transform(df).select("prediction").collect()
    assert again == whole.transform(df).select("prediction").collect()
    with pytest.raises(ValueError):
        publish.text_stage("stemming", "t")
    assert "toLowerCase" in publish.text_stage("case_normalization", "t")[0]
    visits = spark.createDataFrame([("a", "d1"), ("b", "d1"), ("c", "d2")], "v string, d string")
    assert publish.busiest_date(visits, "d") == "d1" and publish.sample_visitors(visits, ["v"], 2).count() == 2


def test_word_vectors_are_learned_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(models, "WORDS", 1000)
    rows = [([f"w{(i * j) % 7}" for j in range(20)],) for i in range(120)] + [([],), (["rare"],)]
    df = spark.createDataFrame(rows, "t array<string>")
    estimator = models.vectorizer("word2vec", "t", "v", 8)
    model, whole = estimator.fit(df), estimator.copy({estimator.numPartitions: 1}).fit(df)
    assert model.getNumPartitions() == 3 and whole.getNumPartitions() == 1 and not estimator.isSet(estimator.numPartitions)
    size = lambda m: {r.word: float(r.vector.norm(2)) for r in m.getVectors().collect()}
    got, want = size(model), size(whole)
    assert got.keys() == want.keys() == {f"w{i}" for i in range(7)}
    assert all(0.3 * want[w] < got[w] < 1.7 * want[w] for w in want)  # a mean of the parts, not their sum
    filled = [r.v.numNonzeros() > 0 for r in model.transform(df).collect()]
    assert filled == [True] * 120 + [False] * 2
