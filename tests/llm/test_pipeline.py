"""The pipeline's stages over a small corpus with planted cases, each held against brute force on its own input."""

import random

import corpus_pipeline
import pytest
from cases import components, hard, prose, words
from test_joins import brute_lines, grams, jaccard
from test_texts import pack

from millrace.llm import token_counts


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    rng = random.Random(21)
    items = [(i, prose(rng, 30)) for i in range(6)]
    rows = []
    for i in range(80):
        lines = [prose(rng, rng.randrange(20, 60)) for _ in range(rng.randrange(1, 4))]
        if i % 10 == 3:
            lines[0] = items[i % 6][1]
        if i % 10 == 7:
            lines.append("all rights reserved by the owners of this very page of text")
        rows.append((i, "\n".join(lines)))
    for i in range(80, 90):  # near copies
        w = rows[i - 80][1].split(" ")
        w[5] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(90, " ".join("".join(rng.choice("qxzjkvwy") for _ in range(6)) for _ in range(60))), (91, None), (92, "")]
    d = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, items


def test_stages(spark, folder):
    d, rows, items = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    names = list(stages)
    out = {}
    for name in names:
        before, made = docs, stages[name](spark, docs, d)
        docs = spark.createDataFrame(made.collect(), made.schema)
        out[name] = ([(r.doc_id, r.text) for r in before.collect()], docs.collect())
        if name != names[-1]:
            assert docs.columns == before.columns
    kept = {r.doc_id for r in out[names[0]][1]}
    assert set(range(90)) <= kept and 90 not in kept
    given, got = out[names[1]]
    want = brute_lines(sorted(x for x in given if x[1] is not None))
    assert {r.doc_id: r.text for r in got if r.text is not None} == want
    given, got = out[names[2]]
    sets = {i: grams(t) for i, t in given if t}
    root = components(sets, [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.5])
    assert {r.doc_id for r in got if r.text} == set(root.values())
    given, got = out[names[3]]
    leaked = {i for i, t in given if t and any(f" {' '.join(words(x))} " in f" {' '.join(words(t))} " for _, x in items)}
    assert leaked and {r.doc_id for r in got} == {i for i, _ in given} - leaked
    given, got = out[names[4]]
    counts = token_counts.token_counts(spark.createDataFrame(given, "doc_id long, text string")).where("n_tokens is not null").orderBy("doc_id").collect()
    assert {r.window_id: list(zip(r.positions, r.doc_ids, r.doc_starts, r.lengths)) for r in got} == pack([(r.doc_id, r.n_tokens + 1) for r in counts], 2048)


def test_run_is_the_stages_in_order(spark, folder):
    d, _, _ = folder
    assert corpus_pipeline.run(spark, d).columns == ["window_id", "n_tokens", "doc_ids", "doc_starts", "lengths", "positions"]


def test_stages_bear_hard_rows(spark, folder, tmp_path):
    """What stays of nulls, blank and very long texts, repeats and clashing names, stage by stage on the same rows."""
    d, _, _ = folder
    docs = hard(spark)
    every = sorted(str(r.doc_id) for r in docs.collect())
    stages = dict(corpus_pipeline.STAGES)
    kept = {name: stage(spark, docs, d) for name, stage in stages.items() if name != "packing"}
    ids = {name: sorted(str(r.doc_id) for r in df.collect()) for name, df in kept.items()}
    assert all(df.columns == docs.columns for df in kept.values())
    assert ids["language_id"].count("1") == 2 and {"2", "6", "10"} <= set(ids["language_id"]) and "7" not in ids["language_id"] and set(ids["language_id"]) <= set(every)
    assert ids["line_dedup"] == sorted(["1", "3", "4", "5", "6", "7", "8", "9", "10", "None", "None"])
    assert ids["ngram_jaccard_join"] == sorted(["1", "3", "4", "5", "6", "7", "8", "9", "10", "None", "None"])
    assert ids["benchmark_decontamination"] == every
    windows = stages["packing"](spark, docs, d).collect()
    assert [w.window_id for w in sorted(windows)] == list(range(len(windows))) and sum(list(w.doc_ids).count(1) > 0 for w in windows)
    for stage in stages.values():
        assert stage(spark, docs.limit(0), d).count() == 0
