"""Rows that every operator must bear: nulls, empty and very long texts, repeats, ties, clashing names."""

import random
import re

from pyspark.sql import types as T

WORDS = "river stone garden market winter letter bridge candle forest harbor signal mirror basket copper meadow thunder village window ladder silver".split()
CLASHING = ["id", "k1", "key_1", "_kept", "kept_numbers", "print", "root", "line", "bands", "language", "text_scores", "accepted", "score", "blocked", "n_tokens", "n_words", "_h", "_e", "dropped", "first", "kind", "starts", "shard"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(rng, n, vocabulary=WORDS):
    return " ".join(rng.choice(vocabulary) + str(rng.randrange(400)) for _ in range(n))


def documents(spark, texts, clashing=False, lang="en"):
    """texts: (doc_id, text) pairs."""
    rows = [(i, t, lang, "src", len(t) if t is not None else None) for i, t in texts]
    df = spark.createDataFrame(rows, SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("x").alias(c) for c in CLASHING])
    return df


def hard(spark, clashing=True):
    rng = random.Random(5)
    long_text = prose(rng, 30_000)
    same = prose(rng, 80)
    rows = [(1, same), (1, same), (2, same), (3, None), (None, prose(rng, 60)), (None, None), (4, ""), (5, " \n\t \n"), (6, long_text), (7, "a" * 200_000), (8, "é ü 漢字 \U0001f600 \x00"), (9, "one"), (10, "word " * 300)]
    return documents(spark, rows, clashing)


def empty(spark, clashing=False):
    return documents(spark, [], clashing)


def words(text):
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower()) if w]


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}
