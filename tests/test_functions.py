import pytest
from pyspark.sql import functions as F

from millrace.functions import dictionaries as D
from millrace.functions import text as T
from millrace.functions.stemmer import stem
from millrace.operators import binning


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t")).alias("x")).first().x


def test_text_stages(spark):
    assert one(spark, "ÀB c", T.lower_case) == "àb c"
    assert one(spark, "hi", T.mark_sentence) == "_class_ss hi _class_se"
    assert one(spark, "a1 b22", lambda t: T.replace_patterns(t, [(r"([a-z])\d+", "$1#"), ("#", "!")])) == "a! b!"
    assert one(spark, "a1b2", lambda t: T.remove_patterns(t, [r"\d"])) == "ab"
    assert one(spark, "I can't go now", lambda t: T.substitute_words(t, {"can't": "can not"})) == "I~SP~can~SP~not~SP~go~SP~now"
    assert one(spark, "The cat~SP~and the dog ", lambda t: T.remove_stop_words(t, ["the", "and"])) == "cat~SP~dog"
    assert one(spark, "The the", lambda t: T.remove_stop_words(t, ["the"], case_sensitive=True)) == "The"
    assert one(spark, " a  b~SP~c ", T.tokenize) == ["a", "b", "c"]
    assert one(spark, "running ponies _class_x", lambda t: T.stem_words(t, ["ponies"])) == "run~SP~ponies~SP~_class_x"
    assert one(spark, None, lambda t: T.fill_null(t, "none", "string")) == "none"
    for stage in (T.lower_case, T.mark_sentence, T.tokenize, T.stem_words, lambda t: T.remove_stop_words(t, ["a"]), lambda t: T.substitute_words(t, {"a": "b"})):
        assert one(spark, None, stage) is None


def test_word_classes(spark):
    classes = {"_card": ["credit card", "card"], "_brand": ["visa", "visa credit card"]}
    rules = T.plan_word_classes(classes)
    flat = [w for p, _ in rules for w in p[p.index("(?:") + 3 : p.index(")'?s")].split("|")]
    assert all(flat.index(long) < flat.index(short) for short in flat for long in flat if short != long and short in long)
    assert one(spark, "my Visa credit cards, a visa and a credit card's card", lambda t: T.replace_word_classes(t, classes)) == "my _brand, a _brand and a _card _card"
    assert T.plan_word_classes({}) == [] and T.plan_word_classes({"a": ["x"], "b": ["x"]})[0][1] == "b"


def test_grams(spark):
    t = ["a", "b", "c", "a", "d"]
    assert one(spark, t, lambda c: T.ngrams(c, 2), "array<string>") == ["a b", "b c", "c a", "a d"]
    assert one(spark, ["a"], lambda c: T.ngrams(c, 2), "array<string>") == []
    assert one(spark, t, lambda c: T.skip_grams(c, 4), "array<string>") == ["a & c", "b & a", "c & d", "b & d"]
    assert one(spark, t, lambda c: T.assemble_grams(c, T.ngrams(c, 5)), "array<string>") == [*t, "a b c a d"]
    with pytest.raises(ValueError):
        T.skip_grams(F.col("x"), 2)


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("Adoption", "adopt"), ("triplicate", "triplic"), ("controll", "control"), ("agreed", "agr"), ("replacement", "replac")])
def test_stemmer(word, want):
    assert stem(word) == want


def test_stemmer_bears_anything():
    assert [stem(w) for w in ("", "s", "ed", "y", "ion", "éèing")] is not None


def test_dictionaries(tmp_path):
    (tmp_path / "w").write_text("a\n\n b \n")
    (tmp_path / "p").write_text("can't,can not\nbad line\n")
    (tmp_path / "r").write_text("a b\tlabel x\n\\d+\t\n")
    (tmp_path / "c").write_text('{"x": ["y"]}')
    assert D.word_list(str(tmp_path / "w")) == ["a", "b"] and D.pairs(str(tmp_path / "p")) == {"can't": "can not"}
    assert D.rules(str(tmp_path / "r")) == [("a b", "label x"), ("\\d+", "")] and D.word_classes(str(tmp_path / "c")) == {"x": ["y"]}
    with pytest.raises(ValueError):
        D.stop_words("latin")


def test_bins(spark):
    df = spark.createDataFrame([(x,) for x in (1, 5, 10, None)], "v int")
    assert [r.b for r in df.select(binning.intervals(F.col("v"), [5, 8]).alias("b")).collect()] == [0.0, 1.0, 2.0, None]
    assert [r.b for r in binning.equidistant(df, "v", 3, "b").collect()] == [1.0, 2.0, 4.0, None]
    assert [r.b for r in binning.equidistant(df.limit(0), "v", 3, "b").collect()] == []
    assert [r.b for r in binning.equiarea(df, "v", 2, "b", exact=True).collect()] == [0.0, 1.0, 1.0, None]
    assert binning.equiarea(df, "v", 2, "b").where("v is not null").select("b").distinct().count() == 2
