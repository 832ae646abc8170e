import random
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest
from cases import SCHEMA, components, documents, empty, hard, prose, words

from millrace.llm import line_dedup, ngram_join


def grams(text, n=3):
    w = words(text or "")
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def corpus(rng, n=60):
    rows = []
    for i in range(n):
        if i % 3 and rows:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 14)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, prose(rng, rng.randrange(5, 90))))
    return rows


def brute_classes(rows, least=0.5):
    """{(id, class, links)} of documents with links, by comparing all pairs."""
    sets = {i: grams(t) for i, t in rows if grams(t)}
    pairs = [p for p in combinations(sets, 2) if jaccard(sets[p[0]], sets[p[1]]) >= least]
    root, links = components(sets, pairs), Counter(i for p in pairs for i in p)
    return {(i, root[i], n) for i, n in links.items()}


def prints(rows):
    """The id of each set by its fingerprint, for texts without equal sets."""
    return {ngram_join.fingerprint(v): i for (i, _), v in zip(rows, ngram_join.text_sets(pa.array([t for _, t in rows]), 3))}


@pytest.mark.parametrize("least,most", [(0.5, 4096), (0.5, 4), (0.8, 4096), (0.3, 8)])
def test_join_equals_brute_force(spark, least, most):
    """Small `most`: tiles are cut into blocks that meet in pairs."""
    rows = corpus(random.Random(1), 70)
    found = {tuple(r) for r in ngram_join.ngram_join(documents(spark, rows), least=least, most=most).collect()}
    assert found == brute_classes(rows, least) and found


def test_pairs_have_the_similarity_of_brute_force(spark):
    rows = list({t: (i, t) for i, t in corpus(random.Random(4))}.values())
    sets, names = {i: grams(t) for i, t in rows}, prints(rows)
    want = {(a, b): round(jaccard(sets[a], sets[b]), 9) for a, b in combinations(sets, 2) if jaccard(sets[a], sets[b]) >= 0.5}
    found = {tuple(sorted((names[r.left_print], names[r.right_print]))): round(r.jaccard, 9) for r in ngram_join.ngram_pairs(documents(spark, rows)).collect()}
    assert found == want and want


def test_boilerplate_and_large_groups_of_copies(spark):
    """A passage in all documents, a text of 300 copies, and 60 near copies of one text."""
    rng = random.Random(7)
    passage, copied, near = prose(rng, 60), prose(rng, 70), prose(rng, 80).split()
    rows = [(i, f"{prose(rng, 90)} {passage} {prose(rng, 10)}") for i in range(60)] + [(100 + i, copied.upper() if i % 2 else copied) for i in range(300)]
    for i in range(60):
        w = list(near)
        for k in rng.sample(range(80), i % 9):
            w[k] = f"other{rng.randrange(10**6)}"
        rows.append((500 + i, " ".join(w)))
    rows += [(600 + i, f"{passage} {prose(rng, 12)}") for i in range(20)]
    for most in (4096, 16):
        assert {tuple(r) for r in ngram_join.ngram_join(documents(spark, rows), most=most).collect()} == brute_classes(rows)


def test_join_bears_hard_rows(spark):
    assert [tuple(r) for r in ngram_join.ngram_join(hard(spark)).orderBy("doc_id").collect()] == [(1, 1, 1), (2, 1, 1)]
    assert ngram_join.ngram_join(empty(spark)).count() == 0
    two = documents(spark, [(1, "a b c d e f"), (1, "g h i j k l"), (2, "a b c d e f"), (2, "A, b c d e f")])
    assert sorted(map(tuple, ngram_join.ngram_join(two).collect())) == [(1, 1, 1), (2, 1, 1)]


def test_near_copies_stage_keeps_one_of_each_group(spark):
    rows = corpus(random.Random(2))
    sets = {i: grams(t) for i, t in rows}
    root = components(sets, [p for p in combinations(sets, 2) if jaccard(sets[p[0]], sets[p[1]]) >= 0.5])
    kept = ngram_join.stage(spark, documents(spark, rows, clashing=True), "")
    assert kept.columns == documents(spark, rows, clashing=True).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))


def test_near_copies_stage_bears_hard_rows(spark):
    kept = [(r.doc_id, r.text) for r in ngram_join.stage(spark, hard(spark), "").collect()]
    assert sorted(str(i) for i, _ in kept) == sorted(map(str, [1, 3, None, None, 4, 5, 6, 7, 8, 9, 10]))
    assert ngram_join.stage(spark, empty(spark), "").count() == 0


def test_of_repeated_rows_the_least_stays_whatever_the_order(spark):
    text = prose(random.Random(1), 40)
    rows = [(1, text, "en", s, 1) for s in "cab"] + [(2, text, "en", "a", 1), (3, None, "en", "x", 0), (3, None, "en", "x", 0)]
    for r in (rows, rows[::-1]):
        kept = ngram_join.stage(spark, spark.createDataFrame(r, SCHEMA), "").collect()
        assert sorted((k.doc_id, k.source) for k in kept) == [(1, "a"), (3, "x"), (3, "x")]


def shingles(line, k=7):
    line = line.lower()
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def brute_lines(rows, least=0.8):
    """(doc, number) of the lines that stay, by document."""
    lines = [(i, n, x.strip()) for i, t in rows for n, x in enumerate(t.split("\n"))]
    real = [x for x in lines if x[2]]
    sets = [shingles(x[2]) for x in real]
    root = components(range(len(real)), [(a, b) for a, b in combinations(range(len(real)), 2) if jaccard(sets[a], sets[b]) >= least])
    keep = {real[k][:2] for k in set(root.values())} | {x[:2] for x in lines if not x[2]}
    out = {}
    for i, t in rows:
        left = [x for n, x in enumerate(t.split("\n")) if (i, n) in keep]
        if any(x.strip() for x in left) or not t.strip():
            out[i] = "\n".join(left)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    pool = [prose(rng, rng.randrange(4, 30)) for _ in range(25)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            x = rng.choice(pool) if rng.random() < 0.5 else prose(rng, rng.randrange(4, 30))
            if rng.random() < 0.4 and len(x) > 80:
                at = rng.randrange(len(x) - 2)
                x = x[:at] + "Q" + x[at + 1 :]
            lines.append(x if rng.random() < 0.9 else "  ")
        rows.append((i, "\n".join(lines)))
    found = {r.doc_id: r.text for r in line_dedup.line_dedup(documents(spark, rows)).collect()}
    want = brute_lines(rows)
    different = [i for i in set(want) | set(found) if want.get(i) != found.get(i)]
    assert len(different) <= 0.05 * len(rows), different


def test_line_dedup_keeps_the_first_of_many_copies_and_clean_lines(spark):
    line = "this licence line is found in every single document of the corpus"
    rows = [(i, f"{line}{'!' * (i % 3)}\nown text of document number {i * 7919} {prose(random.Random(i), 9)}") for i in range(200)]
    found = {r.doc_id: r.text for r in line_dedup.line_dedup(documents(spark, rows)).collect()}
    assert found[0] == rows[0][1] and all(found[i] == rows[i][1].split("\n")[1] for i in range(1, 200))


def test_line_dedup_bears_hard_rows(spark):
    docs = hard(spark)
    found = line_dedup.stage(spark, docs, "")
    assert found.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in found.collect()]
    ids = [i for i, _ in rows]
    # of the same text one stays; null and blank texts stay; a repeated row collapses
    assert 1 in ids and 2 not in ids and {3, 4, 5, 6, 7, 8, 9, 10} <= set(ids) and ids.count(None) == 2
    assert dict((i, t) for i, t in rows if i)[6] == next(r.text for r in docs.where("doc_id = 6").collect())
    assert line_dedup.stage(spark, empty(spark), "").count() == 0


def test_line_ends_are_trimmed_whatever_the_number_of_blanks(spark):
    rows = [(1, "same line of text here\nfirst tail of this document"), (2, " " * 50_000 + "same line of text here" + "\t" * 50_000 + "\nsecond end of another one")]
    found = {r.doc_id: r.text for r in line_dedup.line_dedup(documents(spark, rows)).collect()}
    assert found == {1: rows[0][1], 2: "second end of another one"}


def test_lines_that_meet_are_sorted_once_however_many_pairs(spark, monkeypatch):
    """A bucket of chains, where each round compares: as brute force says, without sorting any pair."""
    rng = random.Random(12)
    texts = []
    for _ in range(6):
        x = prose(rng, 12)
        for _ in range(rng.randrange(2, 9)):
            at = rng.randrange(len(x) - 12)
            x = x[:at] + "".join(rng.choice("QZ") for _ in range(rng.randrange(1, 12))) + x[at + 9 :]
            texts.append(x)
    texts += ["abc", "abcabcabcabcabc", "é漢 line"]
    names = [bytes([k + 1]) * 16 for k in range(len(texts))]
    blocks = [b"\1" * 16] * 2 + [b"\2" * 16] * (len(texts) - 2)
    batch = pa.record_batch([pa.array(blocks, pa.binary()), pa.array(names, pa.binary()), pa.array(texts)], names=["block", "line", "text"])
    sets = [shingles(x.strip()) for x in texts]
    pairs = [(a, b) for a, b in combinations(range(len(texts)), 2) if blocks[a] == blocks[b] and jaccard(sets[a], sets[b]) >= 0.8]
    want = components(range(len(texts)), pairs)

    def found():
        edges = [(a[0] - 1, b[0] - 1) for out in line_dedup._verify(7, 0.8)(iter([batch])) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
        assert set(edges) <= set(pairs)
        return components(range(len(texts)), edges)

    with monkeypatch.context() as m:
        m.setattr(line_dedup, "MOST_RUNS", 0)
        assert found() == want
    monkeypatch.setattr(line_dedup, "similar_pairs", None)
    assert found() == want and 3 < len(set(want.values())) < len(texts) - 3
