import math
import random
from collections import Counter

import numpy as np
import pytest
from cases import documents, empty, hard, prose, words

from millrace.llm import decontaminate, suffix_dedup


def brute(rows, least):
    texts = [(i, words(t)) for i, t in rows if t is not None]
    seen = Counter(tuple(w[k : k + least]) for _, w in texts for k in range(len(w) - least + 1))
    out = []
    for i, w in texts:
        covered = np.zeros(len(w) + 1, bool)
        starts = [k for k in range(len(w) - least + 1) if seen[tuple(w[k : k + least])] > 1]
        merged = []
        for k in starts:
            if merged and k <= merged[-1][1]:
                merged[-1][1] = k + least
            else:
                merged.append([k, k + least])
        out += [(i, a, b - a) for a, b in merged]
    return sorted(out)


@pytest.mark.parametrize("least", [6, 17, 50])
def test_repeats_equal_brute_force(spark, least):
    rng = random.Random(least)
    shared = [prose(rng, rng.randrange(least - 2, 3 * least)) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [prose(rng, rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(shared), prose(rng, rng.randrange(0, 3 * least))]
        rows.append((i, " ".join(parts)))
    rows += [(40, rows[3][1]), (41, "la " * (2 * least + 1)), (42, "la " * (least + 1))]
    found = sorted((r.doc_id, r.first_word, r.n_words) for r in suffix_dedup.repeated_passages(documents(spark, rows), least=least, shard_bytes=4000).collect())
    assert found == brute(rows, least) and found


def test_repeats_bear_hard_rows(spark):
    found = sorted((r.doc_id, r.first_word, r.n_words) for r in suffix_dedup.repeated_passages(hard(spark)).collect())
    assert found == [(1, 0, 80), (1, 0, 80), (2, 0, 80), (10, 0, 300)]
    assert suffix_dedup.repeated_passages(empty(spark)).count() == 0


def benchmark(spark, rows, answers=None):
    if answers:
        return spark.createDataFrame([(i, t, answers.get(i)) for i, t in rows], "item_id long, text string, answer string")
    return spark.createDataFrame(rows, "item_id long, text string")


def planted(rng):
    items = [(i, prose(rng, rng.randrange(15, 60))) for i in range(20)]
    rows, want = [], set()
    for i in range(120):
        t = prose(rng, rng.randrange(10, 300))
        if i % 4 == 0:
            k = rng.randrange(20)
            w = items[k][1].split()
            if i % 8 == 0:  # a paraphrase: a fifth of the words are others
                for x in rng.sample(range(len(w)), len(w) // 5):
                    w[x] = f"other{rng.randrange(10**6)}"
            t, want = f"{t} {' '.join(w)} {prose(rng, 40)}", want | {(i, k)}
        rows.append((i, t))
    return items, rows, want


def heaviest(text, item, weight):
    """The heaviest common subsequence by the textbook table."""
    best = [0.0] * (len(item) + 1)
    for w in text:
        last = 0.0
        for j, x in enumerate(item):
            old = best[j + 1]
            best[j + 1] = max(best[j + 1], best[j], last + weight[x] if w == x else 0.0)
            last = old
    return best[-1]


def brute_leaks(rows, items, answers=None, strong=0.6, weak=0.4, share=0.75):
    """Every window of every document against every item, by a table of its own."""
    texts, wanted = [(i, words(t)) for i, t in rows], [(k, words(t)) for k, t in items]
    known, df = {w for _, t in wanted for w in t} | {w for a in (answers or {}).values() for w in words(a)}, Counter(w for _, t in texts for w in set(t))
    weight = {w: math.log((len(texts) + 1) / (df[w] + 1)) + 0.05 for w in known}
    out = {}
    for k, item in wanted:
        blocks = 2
        while blocks * 8 < len(item) + 7:
            blocks *= 2
        total = sum(weight[w] for w in item)
        answer = words((answers or {}).get(k) or "") or item[len(item) - len(item) // 4 :]
        for i, t in texts:
            for at in range(0, len(t), 8):
                window = t[max(0, at - 8) : at + 8 * (blocks + 1)]
                if sum(weight[w] for w in item if w in window) < weak * total - 1e-9:
                    continue
                s = heaviest(window, item, weight) / total
                if s >= strong or s >= weak and heaviest(window, answer, weight) >= share * sum(weight[w] for w in answer):
                    out[i, k] = max(s, out.get((i, k), 0))
    return out


def test_leaks_are_found_and_clean_documents_left_alone(spark):
    items, rows, want = planted(random.Random(9))
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(spark, rows), benchmark(spark, items)).collect()}
    assert found <= want and len(found) >= 0.9 * len(want)
    assert {p for p in want if p[0] % 8} <= found


def test_leaks_are_those_of_every_window_by_another_way(spark):
    """In documents of the benchmark's own vocabulary: verbatim items, strong shares, and weak ones with the answer."""
    rng = random.Random(12)
    vocabulary = [f"word{k}" for k in range(600)]
    draw = lambda n: rng.choices(vocabulary, [1 / (k + 3) ** 0.8 for k in range(600)], k=n)
    items = [(i, " ".join(draw(rng.randrange(10, 40)))) for i in range(30)]
    rows = []
    for i, t in items:
        for kind in range(3):
            w = t.split()
            last = len(w) - len(w) // 4 if kind == 2 else len(w)
            for x in rng.sample(range(last), (0, len(w) * 3 // 10, len(w) * 11 // 20)[kind]):
                w[x] = f"other{rng.randrange(10**6)}"
            host, at = draw(100), rng.randrange(100)
            rows.append((3 * i + kind, " ".join(host[:at] + w + host[at:])))
    df = documents(spark, rows)
    for answers in (None, {i: " ".join(t.split()[-3:]) for i, t in items if i % 2}):
        want = brute_leaks(rows, items, answers)
        bench = benchmark(spark, items, answers)
        found = {(r.doc_id, r.item_id): r.share for r in decontaminate.leaks(df, bench, near=2.0).collect()}
        assert set(found) == set(want) and all(abs(found[p] - want[p]) < 1e-3 for p in want) and {(3 * i, i) for i, _ in items} <= set(found)
        kept = {r.doc_id for r in decontaminate.without_leaks(df, bench, near=2.0).collect()}
        assert kept == {d for d, _ in rows} - {d for d, _ in want}


def test_a_paraphrase_in_words_outside_the_benchmark_is_found_by_its_cosine(spark):
    """Topics have words that keep company; a paraphrase takes other words of its item's topic, and too few of the item's own for the word checks."""
    rng = random.Random(5)
    topics = [[f"topic{t}x{k}" for k in range(200)] for t in range(12)]
    rows = [(i, " ".join(rng.choices(topics[i % 12], k=60))) for i in range(1200)]
    items, asks = [], []
    for t in range(12):
        own, others = topics[t][:100], topics[t][100:]
        item = rng.sample(own, 16)
        items.append((t, " ".join(item)))
        said = [rng.choice(others) for _ in item]
        for x in (4, 12, 13, 14, 15):
            said[x] = item[x]
        asks.append((1000 + t, " ".join(said)))
        # the same words of the item in company of another topic
        asks.append((2000 + t, " ".join(x if x in item else rng.choice(topics[(t + 5) % 12]) for x in said)))
    df, bench = documents(spark, rows + asks).repartition(4), benchmark(spark, items)
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()}
    by_words = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench, near=2.0).collect()}
    assert len({(1000 + t, t) for t in range(12)} & found) >= 10 and not {d for d, _ in by_words if d >= 1000}
    assert len({d for d, _ in found if d >= 2000}) <= 8


def test_answers_decide_between_the_thresholds(spark):
    rng = random.Random(3)
    item = [f"question{k}" for k in range(20)]
    half = item[:10] + [f"else{k}" for k in range(4)]
    rows = [(1, " ".join(half)), (2, " ".join(half + ["answer1", "answer2"])), *[(100 + i, prose(rng, 50)) for i in range(30)]]
    found = {r.doc_id for r in decontaminate.leaks(documents(spark, rows), benchmark(spark, [(0, " ".join(item))], {0: "answer1 answer2"})).collect()}
    assert found == {2}


def test_a_benchmark_beyond_the_bound_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BENCHMARK", 100)
    with pytest.raises(ValueError):
        decontaminate.leaks(documents(spark, [(1, "a")]), benchmark(spark, [(0, "b " * 100)]))


def test_leaks_bear_hard_rows(spark):
    docs = hard(spark)
    text = docs.where("doc_id = 2").first().text
    bench = benchmark(spark, [(0, text), (1, None), (2, ""), (None, text), (3, "one")])
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert {(1, 0), (2, 0), (1, None), (2, None), (9, 3)} <= found and not {d for d, _ in found} & {3, 4, 5, 7}
    assert decontaminate.leaks(empty(spark), bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and {3, 4, 5, 6, 7, 10} <= {r.doc_id for r in kept.collect()}
    assert not {1, 2} & {r.doc_id for r in kept.collect()}
    assert decontaminate.without_leaks(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.without_leaks(empty(spark), bench).count() == 0


def test_latent_factors_are_those_of_the_whole_decomposition():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((300, 6)) @ rng.standard_normal((6, 40))
    g = decontaminate.gaussian(40, 12).astype(float)
    f = decontaminate.factors(a.T @ (a @ g), g)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    want = vt[:6].T / s[:6]
    # the same up to signs
    got = f[:, :6]
    assert np.allclose(np.abs((want / np.linalg.norm(want, axis=0)).T @ (got / np.linalg.norm(got, axis=0))), np.eye(6), atol=1e-3)
