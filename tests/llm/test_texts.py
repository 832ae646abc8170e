import json
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, empty, hard, prose

from millrace.llm import chat_format, language_id, packing, token_counts, url_filter
from millrace.llm.vectext import BYTE_CODE


def greedy(word, pieces):
    n = i = 0
    while i < len(word):
        k = next(k for k in range(len(word) - i, 0, -1) if k == 1 or word[i : i + k] in pieces)
        n, i = n + 1, i + k
    return n


def test_automaton_equals_greedy_matching():
    rng = random.Random(4)
    pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6))) for _ in range(60)}
    auto = token_counts.build_automaton(pieces)
    texts = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    assert auto.lengths(data, ends - [len(t) for t in texts], ends).tolist() == [greedy(t, pieces) for t in texts]


def test_counts_of_the_vocabulary(spark):
    pieces = set(token_counts.read_vocabulary(token_counts.VOCABULARY))
    text = "Hello world,  the quick\nbrown fox é漢"
    parts = [b"Hello", b" world,", b" ", b" the", b" quick", b"\n", b"brown", b" fox", " é漢".encode()]
    row = token_counts.token_counts(documents(spark, [(1, text)]), words="n_words").first()
    assert (row.n_tokens, row.n_words) == (sum(greedy(p, pieces) for p in parts), len(parts))


def test_counts_bear_hard_rows(spark):
    out = token_counts.token_counts(hard(spark), words="n_words")
    rows = {r.doc_id: r for r in out.collect() if r.doc_id}
    assert rows[3]["_n_tokens"] is None and rows[4]["_n_tokens"] == 0 and rows[6]["_n_tokens"] > 30_000 and rows[6]["n_tokens"] == "x"
    assert out.count() == hard(spark).count()
    assert token_counts.token_counts(empty(spark)).count() == 0


def pack(sizes, window):
    """Windows by walking over the stream."""
    out, at = {}, 0
    for i, n in sizes:
        start = 0
        while start < n:
            w = at // window
            take = min(n - start, (w + 1) * window - at)
            out.setdefault(w, []).append((at - w * window, i, start, take))
            at, start = at + take, start + take
    return out


@pytest.mark.parametrize("window", [1, 7, 100])
def test_packing_equals_a_walk(spark, window):
    rng = random.Random(window)
    sizes = [(i, rng.choice([0, 1, 3, 50, 401])) for i in range(60)]
    df = spark.createDataFrame(rng.sample(sizes, len(sizes)), "doc_id long, n_tokens long").repartition(5)
    found = {r.window_id: list(zip(r.positions, r.doc_ids, r.doc_starts, r.lengths)) for r in packing.pack(df, window).collect()}
    assert found == pack([x for x in sizes if x[1]], window)


def test_packing_bears_hard_rows(spark):
    rows = packing.pack_texts(hard(spark), 512).collect()
    counts = token_counts.token_counts(hard(spark, False)).where("n_tokens is not null").selectExpr("sum(n_tokens + 1)").first()[0]
    assert sum(r.n_tokens for r in rows) == counts and sorted(r.window_id for r in rows) == list(range(len(rows)))
    assert all(r.n_tokens == 512 for r in rows if r.window_id < len(rows) - 1)
    assert packing.pack_texts(empty(spark)).count() == 0


def test_chat_flattens_typed_parts(spark):
    parts = [
        {"type": "text", "text": "look <|image|> "},
        {"type": "image", "url": "a.png", "width": 500, "height": 224},
        {"type": "document", "url": "d.pdf", "parts": [{"type": "text", "text": "inside"}, {"type": "audio", "url": "s.wav", "seconds": 2.5}]},
        {"type": "document", "url": "e.pdf", "pages": 3},
        {"type": "video", "url": "v"},
        {"type": "text"},
    ]
    rows = [(1, 1, "assistant", "fine"), (1, 0, "user", json.dumps(parts))]
    r = chat_format.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert r.prompt == "<|user|>\nlook <\\|image|> <|image|><|document|>inside<|audio|><|document|><|end|>\n<|assistant|>\nfine<|end|>\n"
    assert [(a.number, a.message, a.kind, a.url, a.n_tokens) for a in r.attachments] == [(0, 0, "image", "a.png", 48), (1, 0, "document", "d.pdf", 0), (2, 0, "audio", "s.wav", 63), (3, 0, "document", "e.pdf", 768)]
    assert all(r.prompt[a.place :].startswith(f"<|{a.kind}|>") for a in r.attachments)
    assert r.n_tokens == r.n_text_tokens + 48 + 63 + 768 + 4 + 4 and r.n_messages == 2


def brute_chat(messages, pieces):
    """A conversation by recursion over its parts, with tokens matched one by one."""
    text, spoken, tokens, attached = "", [], 0, []

    def tokens_of(t):
        return sum(greedy(w, pieces) for w in re.findall(rb" ?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+(?= )|[\t-\r ]+", t.encode()))

    def walk(p, message):
        nonlocal text, tokens
        kind = p.get("type")
        if kind == "text" and isinstance(p.get("text"), str):
            spoken.append(p["text"])
            text += p["text"].replace("<\\", "<\\\\").replace("<|", "<\\|")
        elif kind in ("image", "audio", "document"):
            n = {"image": 16 * math.ceil(p.get("width", 1) / 224) * math.ceil(p.get("height", 1) / 224), "audio": math.ceil(25 * p.get("seconds", 1)), "document": 0 if "parts" in p else 256 * p.get("pages", 1)}[kind]
            attached.append((len(attached), message, kind, p.get("url"), len(text), n))
            tokens += n + 1
            text += f"<|{kind}|>"
            for x in p.get("parts", []) if kind == "document" else []:
                walk(x, message)

    for k, (_, role, content) in enumerate(sorted(messages)):
        text += f"<|{role}|>\n"
        for p in json.loads(content) if content.startswith("[{") else [{"type": "text", "text": content}]:
            walk(p, k)
        text, tokens = text + "<|end|>\n", tokens + 2
    return text, len(messages), tokens, attached, spoken


def test_chat_equals_recursion_over_the_parts(spark):
    rng, pieces = random.Random(6), set(token_counts.read_vocabulary(token_counts.VOCABULARY))

    def part(depth=0):
        kind = rng.choice(["text", "text", "image", "audio", "document", "document"])
        if kind == "document" and depth < 3 and rng.random() < 0.6:
            return {"type": kind, "url": f"d{rng.randrange(9)}", "parts": [part(depth + 1) for _ in range(rng.randrange(3))]}
        return {"text": {"type": kind, "text": rng.choice(["some words", "<|image|> x", "é<\\漢", ""])}, "image": {"type": kind, "width": rng.randrange(1, 900), "height": rng.randrange(1, 900)}, "audio": {"type": kind, "url": "a", "seconds": rng.randrange(1, 50) / 4}, "document": {"type": kind, "pages": rng.randrange(1, 9)}}[kind]

    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["plain <|text|>", "two words", json.dumps([part() for _ in range(rng.randrange(1, 5))])])) for c in range(40) for t in range(rng.randrange(1, 5))]
    rows = rng.sample(rows, len(rows))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    counts = {}
    for r in chat_format.format_chat(df).collect():
        text, n, more, attached, spoken = brute_chat([x[1:] for x in rows if x[0] == r.conv_id], pieces)
        assert (r.prompt, r.n_messages, [tuple(a) for a in r.attachments]) == (text, n, attached) and r.n_tokens - r.n_text_tokens == more
        counts[r.conv_id] = (spoken, r.n_text_tokens)
    texts = [(i, t) for i, (spoken, _) in counts.items() for t in spoken]
    by_id = {r.doc_id: r.n for r in token_counts.token_counts(documents(spark, texts)).groupBy("doc_id").sum("n_tokens").toDF("doc_id", "n").collect()}
    assert all(by_id.get(i, 0) == n for i, (_, n) in counts.items()) and len(counts) == 40


def test_chat_moves_a_content_once_and_joins_over_batches(spark):
    picture = json.dumps([{"type": "text", "text": "é漢"}, {"type": "image", "url": "a"}])
    rows = [(c, t, "user", picture if (c + t) % 3 == 0 else f"words {c} {t}") for c in range(12) for t in range(c % 7 + 1)]
    df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "conv_id long, turn long, role string, text string")
    found = chat_format.format_chat(df)
    plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]", plan)
    assert [{x.split("#")[0] for x in m.split(", ")} for m in moved] == [{"id", "turn", "role", "content", "alone"}]
    whole = sorted(found.collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert sorted(chat_format.format_chat(df).collect()) == whole and len(whole) == 12
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for r in whole:
        assert r.n_messages == r.conv_id % 7 + 1 and [a.number for a in r.attachments] == list(range(len(r.attachments)))
        assert [a.message for a in r.attachments] == [t for t in range(r.n_messages) if (r.conv_id + t) % 3 == 0] and all(r.prompt[a.place :].startswith("<|image|>") for a in r.attachments)


def test_pages_become_conversations_with_all_kinds_of_parts(spark):
    pages = spark.createDataFrame([(1, "http://a.b/1", "<html><title>Tea</title><script>no()</script><p>Some <b>text</b>"), (2, None, None), (None, "http://c", "<p>x")], "page_id long, url string, html string")
    rows = {r.conv_id: r for r in chat_format.format_chat(chat_format.page_conversations(pages, 100)).collect() if r.conv_id}
    assert [a.kind for a in rows[101].attachments] == ["document", "image", "audio"] and "Some  text" in rows[101].prompt and "no()" not in rows[101].prompt
    assert rows[101].prompt.startswith("<|user|>\nTea<|document|>") and rows[101].n_messages == 2 and rows[102].n_messages == 2


def test_very_long_words_are_walked_to_their_end():
    rng = random.Random(8)
    pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6))) for _ in range(60)}
    auto = token_counts.build_automaton(pieces)
    texts = [bytes(rng.choice(b"abcd") for _ in range(n)) for n in (5000, 1, 400, 3000, 7, 299)]
    ends = np.cumsum([len(t) for t in texts])
    assert auto.lengths(np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends).tolist() == [greedy(t, pieces) for t in texts]
    one = np.frombuffer(rng.randbytes(2_000_000).replace(b" ", b"x"), np.uint8)
    assert auto.lengths(one, np.array([0]), np.array([len(one)]))[0] > 0


def test_chat_escapes_round_trip():
    rng = random.Random(1)
    for _ in range(500):
        t = "".join(rng.choice("<|\\a>") for _ in range(rng.randrange(12)))
        assert chat_format.unescape(chat_format.escape(t)) == t and "<|" not in chat_format.escape(t)


def test_chat_bears_hard_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x"), (1, 0, "user", ""), (1, 0, "user", ""), (1, None, "system", "first"), (2, 0, "user", "[1, 2]"), (3, 0, "user", "[" * 100_000), (4, 0, "user", "w " * 200_000), (5, 0, "user", '[{"type": "image", "width": "wide", "height": -1}, {"type": "audio", "seconds": null}]')]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as id", "'x' as m", "'x' as prompt")
    found = {r.conv_id: r for r in chat_format.format_chat(df).collect()}
    alone = sorted(r.prompt for r in chat_format.format_chat(df).where("conv_id is null").collect())
    assert alone == ["<|unknown|>\n<|end|>\n", "<|user|>\nx<|end|>\n"]
    assert found[1].prompt.startswith("<|system|>") and found[1].n_messages == 3 and found[2].prompt == "<|user|>\n[1, 2]<|end|>\n"
    assert found[4].n_text_tokens >= 200_000 and [a.n_tokens for a in found[5].attachments] == [16, 25]
    assert chat_format.format_chat(df.limit(0)).count() == 0


def test_url_filter_on_held_out_hosts():
    bad = [f"https://www.{a}-{b}.{e}/{k}" for k, (a, b, e) in enumerate((a, b, e) for a in ("mega", "our", "sunny") for b in ("casino", "betting", "pills", "porn", "spam-farm") for e in ("com", "xyz"))]
    good = [f"https://www.{a}-{b}.{e}/{k}" for k, (a, b, e) in enumerate((a, b, e) for a in ("mega", "our", "sunny") for b in ("library", "museum", "school", "garden", "qrvwak") for e in ("com", "xyz"))]
    held = [x for x in url_filter.LABELLED if "mega" not in x[0]]
    w, b = url_filter.fit(held)
    scores = url_filter.margins(pa.array(bad + good), w) + b
    assert ((scores > 0) == np.array([True] * len(bad) + [False] * len(good))).mean() >= 0.9
    # names of random letters, of which the model knows nothing
    rng = random.Random(77)
    unknown = ["http://" + "".join(rng.choice("aeioubdgklmnprst") for _ in range(rng.randrange(4, 12))) + ".example.net/en/12" for _ in range(300)]
    assert (url_filter.margins(pa.array(unknown), w) + b > 0).mean() <= 0.05


def brute_margin(url, weights):
    """The margin from n-grams taken one by one, with whole numbers of any size for the hash."""
    whole, half, total, count = 1 << 64, len(weights) // 2, 0.0, 0
    bits = half.bit_length() - 1
    rest = re.sub(r"^([a-z][a-z0-9+.-]*://|//)?([^/?#@]*@)?((www|m)[.])?", "", url.lower(), count=1)
    host = re.match(r"[^/?#:]*", rest).group()
    path = re.match(r"(:[0-9]*)?([^?#]*)", rest[len(host) :]).group(2)
    for salt, part in enumerate((f"^{host}$", path)):
        data = part.encode()
        for n in (3, 4, 5):
            for i in range(len(data) - n + 1):
                h = 0
                for c in data[i : i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + int(BYTE_CODE[c])) % whole
                h = (h + salt * 0x51ED270B + n) % whole
                h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % whole
                h = (h ^ h >> 27) * 0x94D049BB133111EB % whole
                total += weights[((h ^ h >> 31) >> 64 - bits) + salt * half]
                count += 1
    return total / max(count, 1) ** 0.5


def test_url_scores_equal_brute_force(spark):
    rng = random.Random(3)
    urls = ["http://a.b", "https://www.casino.example.com:8080/x/y?q=1#f", "user@host.org/path", "//m.plain.net", "ü.example/漢字", "x"]
    urls += [f"http://{''.join(rng.choice('abc-.') for _ in range(rng.randrange(1, 20)))}/{''.join(rng.choice('ab/') for _ in range(rng.randrange(9)))}" for _ in range(60)]
    w, b = url_filter.fit(url_filter.LABELLED[:400])
    want = {u: round(1 / (1 + math.exp(-(brute_margin(u, w) + b))), 6) for u in urls}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    found = {r.url: r.score for r in url_filter.url_filter(df, url_filter.LABELLED[:400]).collect()}
    assert all(abs(found[u] - want[u]) < 2e-6 for u in want)


def test_url_filter_bears_hard_rows(spark):
    rows = [(1, None), (2, ""), (3, "free-casino.com"), (3, "free-casino.com"), (None, "https://city-library.org/about"), (4, "http://" + "a" * 100_000 + ".com/" + "b" * 100_000), (5, "::::"), (6, "http://[é/漢?#")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' as score", "1 as blocked")
    found = url_filter.url_filter(df)
    assert found.columns == ["page_id", "url", "score", "blocked", "_score", "_blocked"]
    by = {(r.page_id, r.url): (r["_score"], r["_blocked"]) for r in found.collect()}
    assert by[1, None] == (None, False) and by[2, ""] == (None, False) and by[3, "free-casino.com"][1] and not by[None, "https://city-library.org/about"][1]
    assert found.count() == 8 and url_filter.url_filter(df.limit(0)).count() == 0
    assert url_filter.fit([])[1] == 0 and url_filter.fit([("a.com", 1)])[1] > 0
    assert url_filter.labels_of(spark.createDataFrame([("a.com", 1), ("a.com", 1), (None, 1), ("b.com", None), ("c.com", 0)], "u string, y int"), "u", "y") in ([("a.com", 1), ("c.com", 0)], [("c.com", 0), ("a.com", 1)])


TONGUES = {"aa": "kalo mine tura veso pani".split(), "bb": "schrund gewicht flocht strumpf zwerg".split(), "cc": "ouelle ainteau rouex viennois eaulle".split()}


def spoken(rng, lang, n):
    return " ".join(rng.choice(TONGUES[lang]) for _ in range(n))


def test_languages_on_held_out_texts(spark):
    rng = random.Random(8)
    rows = [(i, spoken(rng, lang, 30), lang) for i, lang in enumerate(random.Random(1).choices(list(TONGUES), k=150))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_text_model(df.where("doc_id < 100"), "text", "lang")
    found = language_id.identify(df.where("doc_id >= 100"), model).collect()
    assert np.mean([r.language == r.lang for r in found]) >= 0.95 and all(r.accepted for r in found)


def test_evidence_beside_the_text_decides_without_one(spark):
    rng = random.Random(8)
    rows = [(i, spoken(rng, lang, 30), lang, f"www.{lang}site.{lang}", lang) for i, lang in enumerate(random.Random(1).choices(list(TONGUES), k=120))]
    rows += [(1000, "", None, "www.bbsite.bb", "bb"), (1001, None, None, None, None), (1002, "", None, "other.cc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string, declared string")
    model = language_id.fit_text_model(df, "text", "lang")
    found = {r.doc_id: r for r in language_id.identify(df, model, declared="declared", host="host").collect()}
    assert found[1000].language == "bb" and found[1000].accepted and not found[1001].accepted and found[1002].language == "cc"


def test_language_stage_bears_hard_rows(spark):
    docs = hard(spark)
    kept = language_id.stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert {1, 2, 6} <= {r.doc_id for r in kept.collect()}
    assert language_id.stage(spark, empty(spark), "").count() == 0
    clean = documents(spark, [(i, prose(random.Random(i), 50)) for i in range(30)])
    assert language_id.stage(spark, clean, "").count() == 30


def test_one_letter_again_and_again_is_no_language_whatever_its_label(spark):
    rng = random.Random(3)
    rows = [(i, spoken(rng, "aa", 200), "aa") for i in range(12)] + [(100, "k" * 50_000, "aa"), (101, "kalo " * 300, "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language_id.identify(df, language_id.fit_text_model(df, "text", "lang"), declared="lang").collect()}
    assert found[100].language == "und" and all(r.accepted for i, r in found.items() if i != 100)


def test_rare_languages_stay_beside_many_rows_and_copies_count_once(spark):
    """Above the sample's size: a language of six rows is in the model, and a text of thousands of copies doesn't make it."""
    rng = random.Random(21)
    rows = [(i, spoken(rng, "aa", 30), "aa") for i in range(2000)] + [(2000 + i, spoken(rng, "bb", 30), "bb") for i in range(6)]
    rows += [(3000 + i, f"copied {'zzz ' * 40}", "cc") for i in range(3000)] + [(6000 + i, spoken(rng, "cc", 30), "cc") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_text_model(df, "text", "lang", sample=400)
    assert model.languages == ("aa", "bb", "cc")
    asked = spark.createDataFrame([(i, spoken(rng, lang, 30), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 10)], df.schema)
    assert all(r.language == r.lang and r.accepted for r in language_id.identify(asked, model).collect())
    few = language_id.fit_text_model(df.where("lang != 'bb' or doc_id < 2004"), "text", "lang", sample=400)
    assert few.languages == ("aa", "cc")


def test_all_pages_of_a_document_are_evidence(spark):
    rows = [(1, "http://a.aa/7", "<html>"), (2, "http://b.bb/7", "<html lang=bb>"), (3, "http://b.bb/x/7", "<html lang='bb'>"), (4, "http://c.cc/7.html", "<html lang=aa>"), (5, "http://d.dd/8", "<html>")]
    found = {r.page_doc: (r.page_lang, r.page_host) for r in language_id.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {7: ("bb", "b.bb"), 8: (None, "d.dd")}


def test_a_longer_text_counts_more_whatever_its_length():
    n = np.array([1, 100, 240, 1000, 10**5, 10**7])
    grown = language_id.effective(n, 0.25, 60.0)
    assert (np.diff(grown) > 0).all() and abs(grown[0] - 0.25) < 0.01


def brute_language(rows, model, smooth=20.0):
    """Judgements by loops over all rows, from the text scores on."""
    sums, n = language_id.text_sums(pa.array([r[1] for r in rows]), model.table)
    gain = (sums + (n * model.bits * math.log(2))[:, None]) * (language_id.effective(n, 0.25, 60.0) / np.maximum(n, 1))[:, None]
    k = len(model.languages)
    guess = [int(np.argmax(g)) if g.max() > 0 else None for g in gain]
    low = lambda x: x.lower() if x is not None else None
    host, declared = [low(r[2]) for r in rows], [low(r[3]) for r in rows]
    suffix = [h.rsplit(".", 1)[1] if h and "." in h else None for h in host]
    domain = [".".join(h.split(".")[-2:]) if h is not None else None for h in host]

    def counts(values, value):
        return np.array([sum(1.0 for v, g in zip(values, guess) if v == value and g == j) for j in range(k)])

    total = np.array([float(sum(g == j for g in guess)) for j in range(k)])
    prior = (total + 1) / (total.sum() + k)
    out = []
    for i in range(len(rows)):
        logs, und, seen = gain[i] + np.log(prior), math.log(0.02), bool(rows[i][1])
        if host[i] is not None and (c := counts(host, host[i])).sum():
            d = counts(domain, domain[i])
            pd = (d + smooth * prior) / (d.sum() + smooth)
            logs, seen = gain[i] + np.log((c + smooth * pd) / (c.sum() + smooth)), True
        for values in (declared, suffix):
            if values[i] is not None and (c := counts(values, values[i])).sum():
                own = np.log((c + smooth * c.sum() / total.sum()) / (total + smooth))
                logs, und, seen = logs + own, und + own.mean(), True
        every = np.append(logs, und)
        p = 1 / np.exp(every - every.max()).sum()
        best = int(np.argmax(every))
        out.append(([*model.languages, "und"][best], round(float(p), 5), best < k and p >= 0.5 and seen))
    return out


def test_judgements_equal_brute_force(spark):
    rng = random.Random(14)
    hosts = ["a.aa", "www.a.aa", "b.bb", "c.cc", "localhost", None]
    rows = []
    for i in range(150):
        lang = rng.choice(list(TONGUES))
        text = rng.choice([spoken(rng, lang, rng.randrange(1, 30)), spoken(rng, lang, 40), "", None, "".join(rng.choice("qxzj ") for _ in range(60))])
        rows.append((i, text, rng.choice(hosts), rng.choice([lang, lang.upper(), "zz", None]), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, declared string, lang string")
    model = language_id.fit_text_model(df, "text", "lang")
    want = brute_language(rows, model)
    found = {r.doc_id: (r.language, round(r.probability, 5), r.accepted) for r in language_id.identify(df, model, declared="declared", host="host").collect()}
    for i, w in enumerate(want):
        assert found[i][0] == w[0] and abs(found[i][1] - w[1]) < 2e-5 and found[i][2] == w[2], (rows[i], found[i], w)


def test_pages_of_odd_shapes_are_evidence_or_none(spark):
    rows = [(1, "http://a.aa/7", None), (2, None, "<html lang=bb>"), (3, "http://b.bb/", "<html lang=bb>"), (None, "http://c.cc/en/9?x=1", "<HTML LANG='EN-us'>"), (5, "http://d.dd/9", "<html lang=de>"), (5, "http://d.dd/9", "<html lang=de>"), (6, "http://e.ee/99999999999999999999", "<html lang=fr>")]
    found = {r.page_doc: (r.page_lang, r.page_host) for r in language_id.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {7: (None, "a.aa"), 9: ("de", "d.dd")}
