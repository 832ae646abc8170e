import json

import pytest
from conftest import DATA
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from millrace.operators import stages
from millrace.plans import config, pipeline
from millrace.sources import readers
from millrace.streaming import scoring


def settings(spark, tmp_path, **more):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").join(spark.read.parquet(f"{DATA}/sf0.001/labels.parquet"), "doc_id")
    docs.withColumnRenamed("quality", "good").write.mode("overwrite").json(f"{tmp_path}/input.json")
    return {
        "project": "p",
        "model": "m",
        "method": "multi_intent",
        "input": {"source": f"file://{tmp_path}/input.json", "format": "json", "queries": ["select * from input where text is not null"]},
        "roles": {"keys": ["doc_id"], "response": "lang", "text": ["text"], "numerical": ["n_chars"]},
        "preprocessing": [{"input": "text", "output": "clean", "transformations": [{"type": "case_normalization"}, {"type": "regex_removal", "parameter": ["[0-9]+"]}, {"type": "stopwords"}, {"type": "tokenizer"}]}],
        "grams": [{"input": "clean", "output": "grams", "type": "ngram", "parameter": [2]}],
        "binning": [{"input": "n_chars", "output": "size", "type": "intervals", "parameter": [100, 1000]}],
        "vectorization": [{"input": "grams", "output": "tf", "method": "hashingtf", "slots": 256}],
        "algorithm": {"type": "logistic_regression", "parameters": {"maxIter": 8}},
        "steps": ["read", "sampling", "modelling", "scoring", "metrics", "publish"],
    } | more


def test_configured_run_and_stream(spark, tmp_path):
    out = pipeline.run(spark, settings(spark, tmp_path), f"file://{tmp_path}/root")
    measured = spark.read.json(f"file://{tmp_path}/root/p/m/0/model/metrics/standard0.json").first()
    assert measured.accuracy > 0.8 and len(out["scored"]) == 2
    model = readers.SavePoints(spark, f"file://{tmp_path}/root", "p", "m").load_pipeline("modelling")
    assert isinstance(model, PipelineModel)
    out["parts"][1].write.parquet(f"{tmp_path}/stream")
    rows = scoring.read_stream(spark, f"{tmp_path}/stream", out["parts"][1].schema)
    done = scoring.score_stream(rows, model, f"{tmp_path}/scores", f"{tmp_path}/state", ["doc_id", "prediction"], once=True)
    done.awaitTermination(120)
    want = model.transform(spark.read.parquet(f"{tmp_path}/stream")).select("doc_id", "prediction")
    assert sorted(spark.read.parquet(f"{tmp_path}/scores").collect()) == sorted(want.collect())


def raw_scores(spark, root, rows, page=None):
    """Raw rows by the published pipeline, which has no label indexer and reads no file of the run."""
    model = PipelineModel.load(f"{root}/p/m/0/model/publish/{'noPage' if page is None else f'page{page}'}")
    return {r.doc_id: (r.prediction, str(r.probability)) for r in model.transform(rows).select("doc_id", "prediction", "probability").collect()}


TEXTS = [{"input": "text", "output": "clean", "transformations": [{"type": "case_normalization"}, {"type": "stopwords"}, {"type": "tokenizer"}]}]


def single(spark, tmp_path, method, **more):
    """good or bad documents, with numbers, a category that has nulls, a page, and a treatment."""
    good = settings(spark, tmp_path)
    pages = "page" in method
    return good | {
        "method": method,
        "input": good["input"] | {"queries": ["select doc_id, text, n_chars, nullif(source, 'src1') as source, good, cast(doc_id % 4 + 1 as int) as page, cast(doc_id % 2 as double) as treated from input where text is not null"]},
        "roles": {"keys": ["doc_id"], "response": "good", "text": ["text"], "numerical": ["n_chars"], "categorical": ["source"]} | ({"page": "page"} if pages else {}) | ({"treatment": "treated"} if "uplift" in method else {}),
        "preprocessing": TEXTS,
        "grams": [],
        "binning": [{"input": "n_chars", "output": "size", "type": "equidistant", "parameter": 4}],
        "vectorization": [{"input": "clean", "output": "tf", "method": "hashingtf", "slots": 64}, {"input": "categorical_array", "output": "cat", "method": "count_vectorizer", "slots": 50}],
        "algorithm": {"type": "svm", "calibrate": True, "parameters": {"maxIter": 4}} if "uplift" in method else {"type": "logistic_regression", "parameters": {"maxIter": 4}},
        "steps": list(config.STEPS),
    } | ({"pages": 2} if pages else {}) | more


@pytest.mark.parametrize("method", ["single_intent", "single_intent_uplift", "single_intent_page_level", "single_intent_page_level_uplift"])
def test_raw_rows_are_scored_as_in_the_run(spark, tmp_path, method):
    root = f"file://{tmp_path}/root"
    out = pipeline.run(spark, single(spark, tmp_path, method, hotlead={"thresholds": [0.4, 0.6]}), root)
    want = {r.doc_id: (r.prediction, str(r.probability)) for r in out["scored"][1].collect()}
    raw = out["parts"][1]
    found = {}
    for page in pipeline.pages_of(out["config"]):
        found |= raw_scores(spark, root, pipeline.page_filter(out["config"], raw, page), page)
    assert found == want and found
    assert {"is_hot", "label"} <= set(out["scored"][1].columns) and "features" not in out["scored"][1].columns
    if "uplift" in method:
        assert {"modelProbability", "modelPrediction"} <= set(out["scored"][1].columns) and {r.prediction for r in out["scored"][1].collect()} == {1.0}
    measured = spark.read.json(f"{root}/p/m/0/model/metrics/pages1.json").collect()
    assert len(measured) == (2 if "page" in method else 1) and any(r.auroc is not None for r in measured)
    if "page" in method:
        assert spark.read.json(f"{root}/p/m/0/model/metrics/web1.json").count() >= 0


@pytest.mark.parametrize("algorithm", [{"type": "svm", "build": "ovr", "calibrate": True, "parameters": {"maxIter": 3}}, {"type": "logistic_regression", "build": "ovr", "parameters": {"maxIter": 3}}])
def test_one_vs_rest_is_what_the_run_trains(spark, tmp_path, algorithm):
    root = f"file://{tmp_path}/root"
    out = pipeline.run(spark, settings(spark, tmp_path, algorithm=algorithm, top_intents=2, steps=list(config.STEPS)), root)
    assert any(isinstance(x, stages.OneVsRestModel) for x in out["models"][None].stages)
    row = out["scored"][1].first()
    assert len(row.top_intents) == 2 and row.prediction_label == row.top_intents[0].label
    assert raw_scores(spark, root, out["parts"][1]) == {r.doc_id: (r.prediction, str(r.probability)) for r in out["scored"][1].collect()}


def test_rows_of_the_test_part_move_no_border(spark, tmp_path):
    """The largest value is in the test part: bins fitted on all rows would have another border."""
    conf = config.load_config(single(spark, tmp_path, "single_intent"))
    rows = spark.createDataFrame([(i, "a b", 100 + i, "s", i % 2) for i in range(40)], "doc_id long, text string, n_chars long, source string, good int")
    model = pipeline.fit(conf, rows)
    bins = next(x for x in model.stages if isinstance(x, stages.IntervalStage))
    assert bins.values["splits"][-1] == 139.0
    far = rows.limit(1).withColumn("n_chars", F.lit(10**6).cast("long"))
    assert pipeline.publish.complete_pipeline(model).transform(far).count() == 1 and bins.transform(far).first()["size"] == 5.0


def test_predict_monitoring_and_restart(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    conf = single(spark, tmp_path, "single_intent", savepoints=True)
    out = pipeline.run(spark, conf, root)
    want = sorted((r.doc_id, r.prediction) for s in out["scored"] for r in s.collect())
    first = out["scored"][0].count()
    assert "features" in spark.read.parquet(f"{root}/p/m/0/model/noPage/noSegment/data/vectorization0").columns
    # steps that aren't named are read
    again = pipeline.run(spark, conf | {"steps": ["scoring", "metrics"]}, root)
    assert sorted((r.doc_id, r.prediction) for s in again["scored"] for r in s.collect()) == want
    assert pipeline.run(spark, conf | {"steps": ["metrics"]}, root)["scored"][0].count() == first
    assert pipeline.run(spark, conf | {"steps": ["scoring"]}, root)["classes"][0] in (0, 1)
    refit = pipeline.run(spark, conf | {"steps": ["modelling", "scoring"]}, root)
    assert sorted((r.doc_id, r.prediction) for s in refit["scored"] for r in s.collect()) == want
    new = conf | {"job": "predict", "roles": conf["roles"], "scoring": {"filter": "doc_id < 100"}}
    new["input"] = conf["input"] | {"queries": [q.replace(" good,", "") for q in conf["input"]["queries"]]}
    predicted = pipeline.run(spark, new, root)["scored"][0]
    assert sorted((r.doc_id, r.prediction) for r in predicted.collect()) == [x for x in want if x[0] < 100] and "good" not in predicted.columns
    seen = pipeline.run(spark, conf | {"job": "monitoring"}, root)
    assert seen["psi"].first().buckets > 1 and {r.variable for r in seen["vsi"].collect()} == {"source"} and {r.kind for r in seen["values"].collect()} <= {"common", "new", "missing"}
    assert spark.read.json(f"{root}/p/m/0/monitoring/metrics/psi.json").count() == 1


def test_cross_validation_in_the_run_keeps_predictions_and_publishes_a_sample(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    conf = single(spark, tmp_path, "single_intent", cv={"folds": 2}, publish={"qa_visitors": 5})
    conf["algorithm"] = {"type": "svm", "calibrate": True, "parameters": {"maxIter": 3, "regParam": [0.1, 1.0]}}
    out = pipeline.run(spark, conf, root)
    held = spark.read.parquet(f"{root}/p/m/0/model/predictions/cv")
    assert held.select("doc_id").distinct().count() == out["parts"][0].where("good is not null").count() and {r.fold for r in held.collect()} == {0, 1}
    assert spark.read.json(f"{root}/p/m/0/model/qa").count() == 5 and spark.read.json(f"{root}/p/m/0/model/metrics/cv.json").count() == 4


def test_bad_configurations_name_every_problem(spark, tmp_path):
    good = settings(spark, tmp_path)
    config.load_config(good)
    bad = good | {"method": "single_intent_uplift", "sampling": {"type": "stratified", "split": [80, 30]}, "vectorization": [{"input": "nowhere", "method": "bag", "slots": 0}], "algorithm": {"type": "naive_bayes"}, "hyperparameters": "hyperband"}
    with pytest.raises(config.ConfigError) as e:
        config.load_config(bad)
    for part in ("roles.treatment", "stratified", "percent", "nowhere", "bag" if False else "method", "slots", "hyperband"):
        assert part in str(e.value)
    for wrong, part in (
        ({"algorithm": {"type": "svm"}}, "ovr"),
        ({"algorithm": {"type": "logistic_regression", "parameters": {"regParam": [0.1, 0.2]}}}, "several values"),
        ({"algorithm": {"type": "random_forest", "build": "multinomial"}}, "family"),
        ({"colour": 1}, "unknown setting colour"),
        ({"cv": {"fold": 3}}, "unknown setting cv.fold"),
        ({"top_intents": 3, "algorithm": {"type": "svm", "build": "ovr"}}, "top_intents"),
        ({"hotlead": {"thresholds": [0.5]}}, "hotlead"),
        ({"steps": ["publish"], "publish": {"qa_visitors": 3}}, "scoring step"),
    ):
        with pytest.raises(config.ConfigError) as e:
            config.load_config(good | wrong)
        assert part in str(e.value), wrong
    path = tmp_path / "c.json"
    path.write_text(json.dumps(good))
    assert config.load_config(str(path)).get("algorithm.parameters.maxIter") == 8 == config.load_config(f"file://{path}").get("algorithm.parameters.maxIter")


def test_database_sources(spark):
    """A table of an embedded database, and a chain whose first query runs there."""
    at = {"url": "jdbc:derby:memory:millrace;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.createDataFrame([(i, float(i % 3)) for i in range(30)], "k int, v double").write.jdbc(at["url"], "numbers", mode="overwrite", properties={"driver": at["driver"]})
    assert readers.read(spark, "jdbc://numbers", jdbc=at).count() == 30
    chain = ['select "v" as v, count(*) as n from numbers group by "v"', "select sum(N) as total, max(V) as top from part1"]
    assert readers.read(spark, "jdbc://", queries=chain, prefix="part", jdbc=at).first()[:] == (30, 2.0)
    assert readers.read(spark, "jdbc://", queries=chain[:1], jdbc=at).count() == 3
    for wrong in ([], ["delete from numbers"]):
        with pytest.raises(ValueError):
            readers.read(spark, "jdbc://", queries=wrong, jdbc=at)


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "a.tsv").write_text("x\ty\n1\t2\n")
    (tmp_path / "b.json").write_text('{"x": 1}\n{"x": 2}\n')
    assert readers.read(spark, f"file://{tmp_path}/a.csv", "csv").collect()[0].y == "2"
    assert readers.read(spark, f"file://{tmp_path}/a.tsv", "tsv").columns == ["x", "y"]
    assert readers.read(spark, f"file://{tmp_path}/b.json", "json", ["select sum(x) as s from b", "select s + 1 as s from t1"], "t").first().s == 4
    spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("a_view")
    assert readers.read(spark, "hive://a_view").count() == 1 and readers.read(spark, "hive://", queries=["select * from a_view"]).count() == 1
    for wrong in ("nothing", "ftp://x"):
        with pytest.raises(ValueError):
            readers.read(spark, wrong)
    with pytest.raises(ValueError):
        readers.run_sql_chain(spark, ["drop table x"], "t")
    assert readers.select_roles(spark.createDataFrame([(1, None), (2, 3)], "a int, y int"), {"k": ["a"], "r": ["y", "a"]}, "y").collect() == [(2, 3)]


def test_save_points(spark, tmp_path):
    s = readers.SavePoints(spark, f"file://{tmp_path}", "p", "m", job="predict")
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    assert s.save(df, "step", 1, 2).collect() == df.collect() and "predict/page2/noSegment/data/step1" in s.data("step", 1, 2)
    assert s.save_input(df).count() == 1 and s.load_pipeline("none", missing=True) is None
    s.save_metrics(df, "m")
    s.save_sample(df, "json")
    s.append_predictions(df)
    s.append_predictions(df)
    assert spark.read.parquet(f"{s.base}/predictions/cv").count() == 2 and spark.read.option("header", True).csv(f"{s.base}/metrics/m.csv").first().y == "a"
    assert "/model/" in s.pipeline("x")
