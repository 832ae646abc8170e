"""The library's queries over the standard tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import binning, drift, journey, metrics, models, sampling
from ..operators.publish import qa_data
from ..operators import stages
from ..sources.readers import read, run_sql_chain, select_roles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- reading, projection, SQL chains, journeys


@query("select doc_id, lang, source, quality from documents join labels using (doc_id) where quality is not null and n_chars > 500")
def project_filter_response(spark, d):
    docs = table(spark, d, "documents").where("n_chars > 500").select("doc_id", "lang", "source")
    return docs.join(table(spark, d, "labels").where("quality is not null").select("doc_id", "quality"), "doc_id")


@query("""with m as (select user_id, max(value) as value from events where event_type <> 'x' group by user_id)
select e.event_id, e.user_id, e.value from events e join m on e.user_id = m.user_id and e.value = m.value""")
def sql_view_chain(spark, d):
    table(spark, d, "events").createOrReplaceTempView("chain_events")
    return run_sql_chain(spark, ["select event_id, user_id, value from chain_events where event_type <> 'x'", "select user_id, max(value) as value from step1 group by user_id", "select a.event_id, a.user_id, a.value from step1 a join step2 b on a.user_id = b.user_id and a.value = b.value"], "step")


_VISITS = """select event_id, user_id, event_type, value, row_number() over (partition by user_id order by ts, event_id) as page,
  sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding) as spent from events"""


def visits(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.row_number().over(w).alias("page"), F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("spent"))


@query(f"select event_id, user_id, page::int as page, round(lead(spent) over (partition by user_id order by page) - spent, 4) as top from ({_VISITS})")
def time_on_page_lead(spark, d):
    return journey.time_on_page(visits(spark, d), ["user_id"], "page", "spent", "top").select("event_id", "user_id", "page", F.round("top", 4).alias("top"))


@query(f"select least(page, 5)::int as bucket, count(*) as n, count(distinct user_id) as visitors from ({_VISITS}) group by 1")
def page_bucket_split(spark, d):
    return visits(spark, d).groupBy(journey.page_bucket(F.col("page"), 5).alias("bucket")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("visitors"))


@query(f"""with v as (select user_id, least(page, 4) as b, event_type = 'purchase' as label, value / 100 as p, page from ({_VISITS})),
h as (select user_id, min(case when p >= [0.9, 0.8, 0.7, 0.95][b] then page end) as hot, max(case when p >= [0.9, 0.8, 0.7, 0.95][b] then label::int end) as caught, max(label::int) as label from v group by 1)
select least(hot, 4)::int as page, count(*) as hot_leads, (select count(*) from h) as visitors, round(count(*) / (select count(*) from h), 6) as hot_lead_rate, sum(caught)::bigint as captured,
  (select sum(label) from h)::bigint as total_positives, round(sum(caught) / nullif((select sum(label) from h), 0), 6) as capture_rate from h where hot is not null group by 1""")
def hotlead_journey(spark, d):
    v = visits(spark, d).withColumn("label", (F.col("event_type") == "purchase").cast("int")).withColumn("p", F.col("value") / 100)
    found = journey.hot_leads(v, ["user_id"], "page", "label", journey.is_hot(F.col("p"), F.col("page"), [0.9, 0.8, 0.7, 0.95]), 4)
    return found.withColumns({c: F.round(F.col(c) * 1e6) / 1e6 for c in ("hot_lead_rate", "capture_rate")})  # halves fall as in SQL


@query(f"""with v as (select least(page, 3) as b, event_type = 'purchase' as label, floor(value) as s from ({_VISITS})),
c as (select b, s, count(*) as n, sum(label::int) as p from v where s is not null group by 1, 2),
w as (select b, s, sum(n) over k as n, sum(p) over k as tp, sum(p) over (partition by b) as pos, sum(n) over (partition by b) as total from c window k as (partition by b order by s desc rows unbounded preceding)),
f as (select *, tp / n as prec, coalesce(tp / nullif(pos, 0), 0) as rec from w),
g as (select *, coalesce(5 * prec * rec / nullif(4 * prec + rec, 0), 0) as f2 from f),
m as (select *, row_number() over (partition by b order by f2 desc, s desc) as k from g)
select b::int as page, s as threshold, round(f2, 6) as f2, round(pos / total * (2 * rec - rec / nullif(prec, 0)) + 1 - pos / total, 6) as accuracy from m where k = 1""")
def page_best_threshold(spark, d):
    v = visits(spark, d).withColumn("label", (F.col("event_type") == "purchase").cast("int")).withColumn("s", F.floor("value").cast("double"))
    return journey.page_thresholds(v, "page", "s", "label", 3).select("page", "threshold", F.round("f2", 6).alias("f2"), F.round("accuracy", 6).alias("accuracy"))


# --- text

STOP = ["the", "and", "of", "to", "in", "a", "is", "it", "that", "on", "de", "la", "le", "der", "die", "und"]
CLASSES = {"_class_word": ["that", "with", "from", "and"], "_class_pair": ["and that", "with the"], "_class_que": ["thatwith"]}
WORDS = {"the": "this very", "and": "plus", "is": "be", "der": "ein der"}


def pieces_sql(text: str) -> str:
    p = rf"string_split_regex({text}, '\s|(~SP~)')"
    return f"list_slice({p}, 1, list_max(list_transform({p}, lambda x, i: case when x <> '' then i else 0 end)))"


@query("select doc_id, md5(lower(text)) as h, length(lower(text)) as n from documents")
def case_normalization(spark, d):
    low = T.lower_case(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(low).alias("h"), F.length(low).cast("long").alias("n"))


@query("select conv_id, turn, '_class_ss ' || text || ' _class_se' as text from conversations")
def sentence_marker(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.mark_sentence(F.col("text")).alias("text"))


@query(r"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[0-9]+', '_class_number', 'g'), '[a-zA-Z0-9_.]+@[a-zA-Z0-9.]+', '_class_mail', 'g'), '([!?])[!?]+', '\1', 'g')) as h from documents""")
def regex_replacement(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.replace_patterns(F.col("text"), [("[0-9]+", "_class_number"), ("[a-zA-Z0-9_.]+@[a-zA-Z0-9.]+", "_class_mail"), ("([!?])[!?]+", "$1")])).alias("h"))


@query(r"select doc_id, md5(regexp_replace(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), ' +', '', 'g')) as h from documents")
def regex_removal(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.remove_patterns(F.col("text"), ["[^a-zA-Z ]", " +"])).alias("h"))


def _classes_sql(text: str) -> str:
    for pattern, name in T.plan_word_classes(CLASSES):
        text = "regexp_replace({}, '{}', '{}', 'g')".format(text, pattern.replace("'", "''"), name)
    return text


@query(f"select conv_id, turn, {_classes_sql('text')} as text from (select conv_id, turn, regexp_replace(text, '[^\\x00-\\x7f]', '', 'g') as text from conversations)")
def word_class_replacement(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.replace_word_classes(F.regexp_replace("text", r"[^\x00-\x7f]", ""), CLASSES).alias("text"))


@query("select conv_id, turn, array_to_string(flatten(list_transform({}, lambda w: {})), '~SP~') as text from conversations".format(pieces_sql("lower(text)"), "case w " + " ".join(f"when '{k}' then string_split('{v}', ' ')" for k, v in WORDS.items()) + " when '' then []::varchar[] else [w] end"))
def contraction_substitution(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.substitute_words(F.lower("text"), WORDS).alias("text"))


@query(f"select doc_id, md5(array_to_string(list_filter({pieces_sql('text')}, lambda w: not list_contains({STOP}, lower(w))), '~SP~')) as h from documents")
def stopword_removal(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.remove_stop_words(F.col("text"), STOP)).alias("h"))


@query(r"select lang, sum(len(list_filter(string_split_regex(regexp_replace(lower(text), '[0-9]+', '', 'g'), '\s'), lambda w: w <> '' and not list_contains(" + str(STOP) + r", w))))::bigint as tokens, count(*) as docs from documents group by lang")
def tokenize_counts(spark, d):
    clean = T.remove_patterns(T.lower_case(F.col("text")), ["[0-9]+"])
    tokens = T.tokenize(T.remove_stop_words(clean, STOP))
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(F.size(tokens).cast("long")).alias("tokens"), F.count("*").alias("docs"))


@query("select doc_id, coalesce(quality, -1) as quality, coalesce(toxic, 0) as toxic, 1 as imputerCol_quality from documents left join labels using (doc_id)")
def null_check(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.select("doc_id", T.fill_null(F.col("quality"), -1, "int").alias("quality"), T.fill_null(F.col("toxic"), 0, "int").alias("toxic"), F.lit(1).alias("imputerCol_quality"))


_TOKENS = r"list_filter(string_split_regex(lower(text), '\s'), lambda w: w <> '')"
_NGRAM = "list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])"
_SKIP = "list_filter(flatten(list_transform(range(3, 6), lambda k: list_transform(range(1, len(t) - k + 2), lambda i: case when t[i] <> t[i + k - 1] then t[i] || ' & ' || t[i + k - 1] end))), lambda x: x is not null)"


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.tokenize(F.lower("text")).alias("t"))


@query(f"select conv_id, turn, array_to_string({_NGRAM}, '|') as grams from (select conv_id, turn, {_TOKENS} as t from conversations)")
def ngram_2(spark, d):
    return _tokens(spark, d).select("conv_id", "turn", F.array_join(T.ngrams(F.col("t"), 2), "|").alias("grams"))


@query(f"select conv_id, turn, array_to_string({_SKIP}, '|') as grams from (select conv_id, turn, {_TOKENS} as t from conversations)")
def skip_gram_5(spark, d):
    return _tokens(spark, d).select("conv_id", "turn", F.array_join(T.skip_grams(F.col("t"), 5), "|").alias("grams"))


@query(f"select conv_id, turn, md5(array_to_string(list_concat(t, {_NGRAM}, {_SKIP}), '|')) as h from (select conv_id, turn, {_TOKENS} as t from conversations)")
def gram_assemble(spark, d):
    t = F.col("t")
    return _tokens(spark, d).select("conv_id", "turn", F.md5(F.array_join(T.assemble_grams(t, T.ngrams(t, 2), T.skip_grams(t, 5)), "|")).alias("h"))


@query()
def stemming(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.stem_words(F.col("text"), ["the"]).alias("text"))


@query("""select c_custkey, coalesce('c_mktsegment_' || nullif(c_mktsegment, 'BUILDING'), '-') || '|' || coalesce('c_nationkey_' || nullif(c_nationkey, 3), '-') as words, (c_mktsegment = 'BUILDING')::int + (c_nationkey = 3)::int as empty from customer""")
def categorical_array(spark, d):
    """A third of the rows has a null in one of its columns."""
    rows = table(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"), F.nullif("c_nationkey", F.lit(3)).alias("c_nationkey"))
    words = rows.select("c_custkey", T.categorical_array(["c_mktsegment", "c_nationkey"]).alias("w"))
    return words.select("c_custkey", F.array_join("w", "|", "-").alias("words"), F.size(F.filter("w", lambda x: x.isNull())).alias("empty"))


# --- bins


@query("select bin, count(*) as n from (select case when l_quantity < 10 then 0.0 when l_quantity < 20 then 1.0 when l_quantity < 40 then 2.0 else 3.0 end::double as bin from lineitem) group by 1")
def bin_intervals(spark, d):
    return table(spark, d, "lineitem").groupBy(binning.intervals(F.col("l_quantity"), [10, 20, 40]).alias("bin")).agg(F.count("*").alias("n"))


@query("""with m as (select min(p_size)::double as lo, max(p_size)::double as hi from part)
select p_partkey, (list_sum(list_transform(range(0, 5), lambda i: case when p_size >= lo + i * ((hi - lo) / 5) then 1 else 0 end)) + case when p_size >= hi then 1 else 0 end)::double as bin from part, m""")
def bin_equidistant(spark, d):
    return binning.equidistant(table(spark, d, "part"), "p_size", 5, "bin").select("p_partkey", "bin")


@query("""with q as (select list_distinct(quantile_cont(o_totalprice, [0.25, 0.5, 0.75])) as s from orders)
select bin, count(*) as n from (select list_sum(list_transform(s, lambda x: case when o_totalprice >= x then 1 else 0 end))::double as bin from orders, q) group by 1""")
def bin_equiarea_exact(spark, d):
    return binning.equiarea(table(spark, d, "orders"), "o_totalprice", 4, "bin", exact=True).groupBy("bin").agg(F.count("*").alias("n"))


# --- sampling


def rv_sql(key: str) -> str:
    return f"(('0x' || substr(md5({key}::varchar), 1, 8))::bigint::double * 100 / 4294967295)"


def rv(key: str):
    return sampling.random_variable(F.md5(F.col(key).cast("string")))


@query(f"select doc_id, round({rv_sql('doc_id')}, 6) as rv from documents")
def random_variable_hex(spark, d):
    return sampling.with_random_variable(table(spark, d, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("h")), "h", "rv").select("doc_id", F.round("rv", 6).alias("rv"))


@query(f"select event_id, case when {rv_sql('event_id')} <= 80 then 'train' else 'test' end as part from events")
def split_conditional(spark, d):
    rows = table(spark, d, "events").select("event_id", rv("event_id").alias("rv"))
    train, test = sampling.conditional_split(rows, ["rv <= 80", "rv > 80"])
    return train.select("event_id", F.lit("train").alias("part")).unionByName(test.select("event_id", F.lit("test").alias("part")))


@query("""select doc_id, toxic, case when k <= ceil(n * 0.75) then 'train' else 'test' end as part from
(select doc_id, toxic, row_number() over (partition by toxic order by md5(doc_id::varchar), doc_id) as k, count(*) over (partition by toxic) as n from labels)""")
def stratified_rank_split(spark, d):
    rows = table(spark, d, "labels").select("doc_id", "toxic", F.struct(F.md5(F.col("doc_id").cast("string")), "doc_id").alias("by"))
    train, test = sampling.stratified_split(rows, "toxic", 0.75, F.col("by"), coarse=sampling.random_variable(F.md5(F.col("doc_id").cast("string"))))
    return train.select("doc_id", "toxic", F.lit("train").alias("part")).unionByName(test.select("doc_id", "toxic", F.lit("test").alias("part")))


@query("select doc_id, case when count(*) over (partition by lang || '_' || source) < 10 then 'other' else lang || '_' || source end as label from documents")
def class_stabilizer(spark, d):
    return sampling.stabilize_classes(table(spark, d, "documents").select("doc_id", F.concat_ws("_", "lang", "source").alias("label")), "label", 10, "other")


@query(f"""with r as (select doc_id, toxic, {rv_sql('doc_id')} as rv from labels),
c as (select toxic, count(*) as n, row_number() over (order by count(*), toxic) as k from r group by 1),
a as (select (select toxic from c where k = 1) as rare, (select n from c where k = 1) as m, (select toxic from c where k = 2) as freq, (select n from c where k = 2) as most),
b as (select min(rv) as lo, max(rv) as hi from r, a where toxic = freq)
select doc_id, toxic from r, a, b where toxic = rare or rv < lo + m / most * 70.0::double / 30 * (hi - lo)""")
def balance_conditional(spark, d):
    rows = table(spark, d, "labels").select("doc_id", "toxic", rv("doc_id").alias("rv"))
    return sampling.balance_conditional(rows, "toxic", 30, "rv").select("doc_id", "toxic")


@query(f"""select lang, source, n_chars // 1000 as size from documents except select lang, source, n_chars // 1000 from documents where {rv_sql('doc_id')} <= 50""")
def except_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.expr("n_chars div 1000").alias("size"))
    return sampling.remaining(docs.drop("doc_id"), docs.where(rv("doc_id") <= 50).drop("doc_id"))


@query("select quality, count(*) as count from labels group by quality")
def class_counts(spark, d):
    return sampling.class_counts(table(spark, d, "labels"), "quality")


@query("select min_by(quality, n * 10 + quality) as minority, max_by(quality, n * 10 + quality) as majority from (select quality, count(*) as n from labels group by quality)")
def minority_majority(spark, d):
    rare, frequent, _, _ = sampling.minority_majority(table(spark, d, "labels"), "quality")
    return spark.createDataFrame([(rare, frequent)], "minority int, majority int")


def hash_sql(key: str) -> str:
    return f"(('0x' || substr(md5('{sampling.SEED}|' || {key}::varchar), 1, 8))::bigint::double * 100 / 4294967295)"


@query(f"""with c as (select toxic, count(*) as n, row_number() over (order by count(*), toxic) as k from labels group by 1),
a as (select (select toxic from c where k = 1) as rare, (select n from c where k = 1) as m, (select toxic from c where k = 2) as freq, (select n from c where k = 2) as most)
select doc_id, toxic from labels, a where toxic = rare or {hash_sql('doc_id')} < m / most * 70.0::double / 30 * 100""")
def balance_random(spark, d):
    return sampling.balance_random(table(spark, d, "labels"), "toxic", 30, ["doc_id"]).select("doc_id", "toxic")


@query("""with r as (select doc_id, quality % 2 as y from labels union all select doc_id + 1000000, 1 from labels),
c as (select y, count(*) as n from r group by 1), a as (select min_by(y, n) as rare, min(n) as m, max(n) as most, sum(n) as total from c),
k as (select rare, floor((100.0::double * m / total) * total / 5 / most) as copies from a)
select r.y as y, count(*) * case when r.y = rare then 1 else copies end::bigint as least_rows from r, k group by r.y, rare, copies""")
def balance_copies(spark, d):
    """The rare class is too frequent for what is asked for, so the other one is copied whole; what is drawn beyond whole copies is left out here."""
    labels = table(spark, d, "labels")
    rows = labels.select("doc_id", (F.col("quality") % 2).alias("y")).unionAll(labels.select(F.col("doc_id") + 1000000, F.lit(1)))
    rare, _, m, n = sampling.minority_majority(rows, "y")
    copies, _ = sampling.balance_plan(m, n, 5)
    counts = sampling.balance_random(rows, "y", 5, ["doc_id"]).groupBy("doc_id", "y").agg(F.count("*").alias("n"))
    return counts.groupBy("y").agg(F.sum(F.when(F.col("y") == F.lit(rare), F.col("n")).otherwise(F.least("n", F.lit(copies)))).alias("least_rows"))


@query(f"select doc_id, quality, toxic, case when {hash_sql('doc_id')} < 80 then 'train' else 'test' end as part from labels")
def random_split(spark, d):
    train, test = sampling.hash_split(table(spark, d, "labels"), [80, 20], ["doc_id"])
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(f"select distinct page::int as page from ({_VISITS}) order by 1 limit 3")
def first_pages(spark, d):
    return journey.first_pages(visits(spark, d), "page", 3)


@query("select c_mktsegment as segment, c_nationkey as nation, count(*) as n, grouping(c_mktsegment, c_nationkey)::int as level from customer group by cube (c_mktsegment, c_nationkey)")
def cube_counts(spark, d):
    return table(spark, d, "customer").cube(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


@query("select r_name as region, n_name as nation, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def rollup_counts(spark, d):
    """Small tables are broadcast by their sizes."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count("*").alias("n"))


@query("with a as (select c_nationkey, c_acctbal from customer where c_acctbal > 100), b as (select c_nationkey, sum(c_acctbal) as s from a group by 1) select c_nationkey, round(s, 2) as s from b where s > 1000")
def source_file_chain(spark, d):
    """A file by its address, and a chain of queries over it and one another."""
    rows = read(spark, f"file://{d}/customer.parquet", "parquet", ["select c_nationkey, c_acctbal from customer where c_acctbal > 100", "select c_nationkey, sum(c_acctbal) as s from file_step1 group by c_nationkey", "select c_nationkey, round(s, 2) as s from file_step2 where s > 1000"], "file_step")
    return select_roles(rows, {"keys": ["c_nationkey"], "numerical": ["s", "c_nationkey"]}, "s")


# --- drift and metrics


@query(f"""with e as (select event_type, value, {rv_sql('event_id')} < 60 as base from events where value is not null),
r as (select event_type, value, row_number() over (partition by event_type order by value) as k, count(*) over (partition by event_type) as n from e where base),
s as (select event_type, list_distinct(list(value)) as splits from r where list_contains(list_transform(range(1, 10), lambda i: greatest(ceil((i * 0.1::double) * n)::bigint, 1)), k) group by 1),
c as (select event_type, len(list_filter(splits, lambda x: x <= value)) as bucket, sum(base::int) as b, sum((not base)::int) as n from e join s using (event_type) group by 1, 2 having sum(base::int) > 0 and sum((not base)::int) > 0),
h as (select event_type, b / sum(b) over (partition by event_type) as b, n / sum(n) over (partition by event_type) as n from c)
select event_type, round(sum((n - b) * ln(n / b) * 100), 6) as psi, count(*) as buckets from h group by 1""")
def psi_exact(spark, d):
    rows = table(spark, d, "events").select("event_type", "value", rv("event_id").alias("rv"))
    return drift.psi(rows.where("rv < 60"), rows.where("rv >= 60"), "value", ["event_type"]).select("event_type", F.round("psi", 6).alias("psi"), "buckets")


@query(f"""with e as (select event_type, value, {rv_sql('event_id')} < 60 as base from events where value is not null and ({rv_sql('event_id')} < 60 or value < 50)),
r as (select event_type, value, row_number() over (partition by event_type order by value) as k, count(*) over (partition by event_type) as n from e where base),
s as (select event_type, list_sort(list_distinct(list(value))) as splits from r where list_contains(list_transform(range(1, 10), lambda i: greatest(ceil((i * 0.1::double) * n)::bigint, 1)), k) group by 1),
b as (select event_type, splits, unnest(range(0, len(splits) + 1)) as bucket from s),
c as (select event_type, len(list_filter(splits, lambda x: x <= value)) as bucket, sum(base::int) as b, sum((not base)::int) as n from e join s using (event_type) group by 1, 2 having sum(base::int) > 0 and sum((not base)::int) > 0)
select event_type, round(case when bucket = 0 then 0.0 else splits[bucket] end, 6)::double as from_value, round(case when bucket = len(splits) then 1.0 else splits[bucket + 1] end, 6)::double as to_value from b anti join c using (event_type, bucket)""")
def psi_ranges(spark, d):
    """The ranges of which the new rows have none, as they stop at 50."""
    rows = table(spark, d, "events").select("event_type", "value", rv("event_id").alias("rv"))
    found = drift.psi(rows.where("rv < 60"), rows.where("rv >= 60 and value < 50"), "value", ["event_type"]).select("event_type", F.explode("excluded").alias("x"))
    return found.select("event_type", F.round("x.from", 6).alias("from_value"), F.round("x.to", 6).alias("to_value"))


@query("""with v as (select unnest([{'variable': 'c_mktsegment', 'value': c_mktsegment}, {'variable': 'nation', 'value': (c_nationkey + c_custkey % 2)::varchar}]) as x, c_custkey % 3 > 0 as base from customer where c_custkey % 3 > 0 or c_nationkey < 20)
select x.variable as variable, x.value as value, case when count(case when not base then 1 end) = 0 then 'missing' when count(case when base then 1 end) = 0 then 'new' else 'common' end as kind, count(case when base then 1 end) as base_rows, count(case when not base then 1 end) as new_rows from v group by 1, 2""")
def vsi_values(spark, d):
    rows = table(spark, d, "customer").select("c_mktsegment", "c_nationkey", (F.col("c_nationkey") + F.col("c_custkey") % 2).alias("nation"), (F.col("c_custkey") % 3 > 0).alias("base"))
    return drift.values_by_kind(rows.where("base"), rows.where("not base and c_nationkey < 20"), ["c_mktsegment", "nation"])


@query("""with v as (select unnest([{'variable': 'c_mktsegment', 'value': c_mktsegment}, {'variable': 'nation', 'value': (c_nationkey + c_custkey % 2)::varchar}]) as x, c_custkey % 3 > 0 as base from customer),
c as (select x.variable as variable, x.value as value, sum(base::int) as b, sum((not base)::int) as n from v group by 1, 2),
s as (select *, b / sum(case when b > 0 and n > 0 then b end) over (partition by variable) as sb, n / sum(case when b > 0 and n > 0 then n end) over (partition by variable) as sn from c)
select variable, round(sum(case when b > 0 and n > 0 then (sn - sb) * ln(sn / sb) * 100 end), 6) as vsi, count(case when b > 0 and n > 0 then 1 end) as n_common, count(case when n = 0 then 1 end) as n_missing, count(case when b = 0 then 1 end) as n_new from s group by 1""")
def vsi(spark, d):
    rows = table(spark, d, "customer").select("c_mktsegment", (F.col("c_nationkey") + F.col("c_custkey") % 2).alias("nation"), (F.col("c_custkey") % 3 > 0).alias("base"))
    return drift.vsi(rows.where("base"), rows.where("not base"), ["c_mktsegment", "nation"]).withColumn("vsi", F.round("vsi", 6))


@query(f"""with v as (select least(page, 3)::int as b, event_type = 'purchase' as label, floor(value) as s from ({_VISITS}) where value is not null),
c as (select b, s, count(*) as n, sum(label::int) as p from v group by 1, 2),
w as (select b, s, n as own, p as own_p, sum(n) over k as n, sum(p) over k as tp, sum(p) over (partition by b) as pos, sum(n) over (partition by b) as total from c window k as (partition by b order by s desc rows unbounded preceding)),
f as (select *, coalesce(5 * (tp / n) * coalesce(tp / nullif(pos, 0), 0) / nullif(4 * (tp / n) + coalesce(tp / nullif(pos, 0), 0), 0), 0) as f2 from w),
m as (select *, row_number() over (partition by b order by f2 desc, s desc) as k from f),
a as (select b, sum(own_p * ((total - pos) - (n - tp) + (own - own_p) / 2)) / nullif(sum(own_p) * (any_value(total) - any_value(pos)), 0) as auroc from f group by b)
select m.b as page, round(auroc, 6) as auroc, s as threshold, round(f2, 6) as f2, round((total - pos - n + 2 * tp) / total, 6) as accuracy from m join a using (b) where k = 1""")
def binary_pages(spark, d):
    v = visits(spark, d).withColumn("label", (F.col("event_type") == "purchase").cast("int")).withColumn("s", F.floor("value").cast("double"))
    found = metrics.binary_by_page(v, "page", "s", "label", 3)
    return found.select("page", F.round("auroc", 6).alias("auroc"), "threshold", F.round("f2", 6).alias("f2"), F.round("accuracy", 6).alias("accuracy"))


_JUDGED = "(select quality, (n_chars > 1500)::int as pred, n_chars % 100 / 100.0::double as score from documents join labels using (doc_id))"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return rows.select("quality", (F.col("n_chars") > 1500).cast("int").alias("pred"), (F.col("n_chars") % 100 / 100.0).alias("score"))


@query(f"select quality, pred, count(*) as n from {_JUDGED} group by 1, 2")
def confusion(spark, d):
    return metrics.confusion(_judged(spark, d), "quality", "pred")


_BY_CLASS = f"""(with j as (select * from {_JUDGED}), k as (select quality as c from j union select pred from j)
select c, count(case when quality = c then 1 end) as s, count(case when quality = c and pred = c then 1 end) as tp, count(case when pred = c and quality <> c then 1 end) as fp,
  coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(s, 0), 0) as r, coalesce(fp / nullif(count(*) - s, 0), 0) as fpr from k, j group by c)"""


@query(f"select c as class, s as support, tp, fp, round(p, 6) as precision, round(r, 6) as recall, round(fpr, 6) as fpr from {_BY_CLASS}")
def intent_report(spark, d):
    return metrics.by_class(_judged(spark, d), "quality", "pred").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "fpr")})


@query(f"""select round(sum(tp) / sum(s), 6) as accuracy, round(sum(p * s) / sum(s), 6) as weighted_precision, round(sum(r * s) / sum(s), 6) as weighted_recall,
  round(sum(coalesce(2 * p * r / nullif(p + r, 0), 0) * s) / sum(s), 6) as weighted_f1, round(sum(coalesce(5 * p * r / nullif(4 * p + r, 0), 0) * s) / sum(s), 6) as weighted_f2,
  round(sum(r * s) / sum(s), 6) as weighted_tpr, round(sum(fpr * s) / sum(s), 6) as weighted_fpr from {_BY_CLASS}""")
def weighted_prf(spark, d):
    rows = metrics.weighted(_judged(spark, d), "quality", "pred")
    return rows.select(*[F.round(c, 6).alias(c) for c in rows.columns])


@query(f"""with c as (select score as s, count(*) as n, sum(quality) as p from {_JUDGED} group by 1),
w as (select s, sum(n) over k as n, sum(p) over k as tp, sum(p) over () as pos from c window k as (order by s desc rows unbounded preceding)),
f as (select s, tp / n as p, tp / pos as r from w)
select s as threshold, round(p, 6) as precision, round(r, 6) as recall, round(coalesce(5 * p * r / nullif(4 * p + r, 0), 0), 6) as f2 from f""")
def threshold_curve_f2(spark, d):
    rows = metrics.threshold_curve(_judged(spark, d), "score", "quality")
    return rows.select("threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f2")])


@query(f"""with c as (select score as s, sum(quality) as p, sum(1 - quality) as n from {_JUDGED} group by 1),
r as (select p, n, sum(n) over (order by s rows unbounded preceding) - n as below from c)
select round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) as auroc from r""")
def auroc(spark, d):
    return metrics.auroc(_judged(spark, d), "score", "quality").select(F.round("auroc", 6).alias("auroc"))


# --- scores

_LABELS = [f"c{i}" for i in range(64)]


@query("""select vec_id, array_to_string(list_transform(list_slice(list_sort(list_transform(embedding, lambda p, i: {'p': -p, 'i': i})), 1, 3), lambda x: 'c' || (x.i - 1)), '|') as top from embeddings""")
def topk_intents(spark, d):
    best = models.top_intents(F.col("embedding"), _LABELS, 3)
    return table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(best, lambda x: x["label"]), "|").alias("top"))


@query("select o_orderkey, round(1 / (1 + exp(-(1.7 * (o_totalprice / 100000) - 2.5))), 6) as probability from orders")
def platt_apply(spark, d):
    """A calibration of two classes on given raw scores."""
    x = F.col("o_totalprice") / 100000
    rows = table(spark, d, "orders").select("o_orderkey", array_to_vector(F.array(-x, x)).alias("rawPrediction"))
    return stages.PlattModel({"pairs": [[1.7, -2.5]]}).transform(rows).select("o_orderkey", F.round(F.get(vector_to_array("probability"), 1), 6).alias("probability"))


_PAIRS = [[1.5, -0.2], [0.7, 0.1], [2.0, -1.0]]


@query("""with r as (select vec_id, embedding[1]::double as a, embedding[2]::double as b, embedding[3]::double as c from embeddings),
p as (select *, 1 / (1 + exp(-(1.5 * a - 0.2))) as x, 1 / (1 + exp(-(0.7 * b + 0.1))) as y, 1 / (1 + exp(-(2.0 * c - 1.0))) as z from r)
select vec_id, case when x >= y and x >= z then 0.0 when y >= z then 1.0 else 2.0 end::double as prediction, case when a >= b and a >= c then 0.0 when b >= c then 1.0 else 2.0 end::double as svm_prediction,
  round(x / (x + y + z), 5) as p0, round(z / (x + y + z), 5) as p2 from p""")
def platt_classes(spark, d):
    """A calibration of three classes: the most probable class is the prediction, the other one is kept."""
    scores = F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", array_to_vector(scores).alias("rawPrediction"), (F.array_position(scores, F.array_max(scores)) - 1).cast("double").alias("prediction"))
    p = vector_to_array("probability")
    return stages.PlattModel({"pairs": _PAIRS}).transform(rows).select("vec_id", "prediction", "svm_prediction", F.round(F.get(p, 0), 5).alias("p0"), F.round(F.get(p, 2), 5).alias("p2"))


_LINES = [([1.0, -0.5, 0.2], 0.1), ([-0.3, 0.8, 0.4], 0.0), ([0.2, 0.2, -0.9], -0.1)]


@query("""with r as (select vec_id, embedding[1]::double as a, embedding[2]::double as b, embedding[3]::double as c from embeddings),
m as (select *, a - 0.5 * b + 0.2 * c + 0.1 as x, -0.3 * a + 0.8 * b + 0.4 * c as y, 0.2 * a + 0.2 * b - 0.9 * c - 0.1 as z from r),
p as (select *, 1 / (1 + exp(-x)) as px, 1 / (1 + exp(-y)) as py, 1 / (1 + exp(-z)) as pz from m)
select vec_id, case when x >= y and x >= z then 0.0 when y >= z then 1.0 else 2.0 end::double as prediction, round(y, 5) as raw_1, round(py / (px + py + pz), 5) as p1 from p""")
def one_vs_rest_apply(spark, d):
    """A binary model for each of three classes, of given coefficients: raw scores, probabilities, and the class of the largest score."""
    rows = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double"))).alias("features"))
    out = stages.OneVsRestModel({}, [stages.LinearModel({"weights": w, "intercept": b}) for w, b in _LINES]).transform(rows)
    return out.select("vec_id", "prediction", F.round(F.get(vector_to_array("rawPrediction"), 1), 5).alias("raw_1"), F.round(F.get(vector_to_array("probability"), 1), 5).alias("p1"))


@query("select l_orderkey, l_linenumber, l_partkey, round(1 / (1 + exp(-(0.05 * l_quantity - 1.2 + 0.4))) - 1 / (1 + exp(-(0.05 * l_quantity - 1.2))), 6) as delta, 1.0::double as prediction from lineitem")
def uplift_delta(spark, d):
    """A model of given coefficients with its last feature at 0 and at 1."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", array_to_vector(F.array("l_quantity", F.lit(0.0))).alias("features"))
    out = stages.UpliftModel({"treatment": -1}, [stages.LinearModel({"weights": [0.05, 0.4], "intercept": -1.2})]).transform(rows)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.get(vector_to_array("probability"), 1), 6).alias("delta"), "prediction")


@query("select doc_id, case lang when 'de' then 0 when 'en' then 1 when 'es' then 2 when 'fr' then 3 end::double as label, lang as name from documents where lang is not null")
def label_names(spark, d):
    """Labels to places in the alphabet, and back."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    model = models.label_indexer("lang", "label", multi=True).fit(docs)
    return models.label_names("label", model.labels, "name").transform(model.transform(docs)).select("doc_id", "label", "name")


@query("""with b as (select ts::date as day from events group by 1 order by count(*) desc, 1 limit 1),
v as (select distinct user_id from events, b where ts::date = day order by user_id limit 20)
select event_id, user_id, event_type, round(value / 100, 6) as probability from events, b where ts::date = day and user_id in (select user_id from v)""")
def qa_sample(spark, d):
    """Inputs of sampled visitors of the busiest day, joined with their scores."""
    events = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    p = F.col("value") / 100
    scored = events.select("event_id", "user_id", array_to_vector(F.array(1 - p, p)).alias("probability"))
    rows = qa_data(scored, events, ["user_id", "event_id"], 20, "day", visitor=["user_id"])
    return rows.select("event_id", "user_id", "event_type", F.round("positive_probability", 6).alias("probability"))


# --- models


def document_features(docs: DataFrame, slots: int = 1024) -> DataFrame:
    """Hashed words in place of the text."""
    tokens = docs.withColumn("tokens", T.tokenize(T.lower_case(F.col("text")))).drop("text")
    return models.vectorizer("hashingtf", "tokens", "features", slots).transform(tokens).drop("tokens")


def _scored(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.select(key, "label", "prediction", F.round(F.get(vector_to_array("probability"), 1), 4).alias("probability"))


@query()
def quality_model(spark, d):
    """A classifier of document quality on hashed words, with its scores. Only labelled texts become features, and once for fit and scores."""
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    rows = document_features(table(spark, d, "documents").select("doc_id", "text").join(labels, "doc_id")).persist()
    return _scored(models.classifier("logistic_regression", maxIter=20, regParam=0.01).fit(rows).transform(rows))


@query()
def language_one_vs_rest(spark, d):
    """A support vector machine for each language, calibrated."""
    rows = document_features(table(spark, d, "documents").select("doc_id", "text", "lang"), 256)
    rows = models.label_indexer("lang", "label", multi=True).fit(rows).transform(rows).select("doc_id", "label", "features").persist()
    whole = Pipeline(stages=[stages.OneVsRest({"classes": 4}, [models.classifier("svm", maxIter=10)]), stages.Platt({"classes": 4})]).fit(rows)
    return whole.transform(rows).select("doc_id", "label", "prediction", "svm_prediction")


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 100000).alias("price"), (F.month("o_orderdate") / 12).alias("month"), (F.col("o_custkey") % 2).cast("double").alias("treated"), (F.col("o_orderstatus") == "F").cast("double").alias("label"))
    return models.assembler(["price", "month", "treated"]).transform(rows)


@query()
def soft_label_regression(spark, d):
    rows = _numbers(spark, d).withColumn("soft", 0.1 + 0.8 * F.col("label"))
    return _scored(models.fit_soft_labels(rows, "soft", maxIter=25).transform(rows), "o_orderkey")


@query()
def svm_platt_uplift(spark, d):
    """A support vector machine, its calibration, and the difference that treatment makes to the calibrated probability."""
    rows = _numbers(spark, d)
    chain = Pipeline(stages=[models.classifier("svm", maxIter=15), stages.Platt({"classes": 2})]).fit(rows).stages
    return stages.UpliftModel({"treatment": 2}, chain).transform(rows).select("o_orderkey", "modelPrediction", "prediction", F.round(F.get(vector_to_array("probability"), 1), 6).alias("delta"))


@query()
def tree_models(spark, d):
    rows = _numbers(spark, d)
    out = None
    for kind, params in (("decision_tree", {"maxDepth": 4}), ("random_forest", {"numTrees": 5, "maxDepth": 4}), ("gradient_boosted_trees", {"maxIter": 3, "maxDepth": 3}), ("naive_bayes", {}), ("multilayer_perceptron", {"layers": [4], "maxIter": 20})):
        scored = models.classifier(kind, 2, 3, **params).fit(rows).transform(rows)
        part = metrics.weighted(scored, "label", "prediction").select(F.lit(kind).alias("model"), "accuracy", "weighted_f1")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def cross_validation(spark, d):
    rows, lr = _numbers(spark, d), models.classifier("logistic_regression", maxIter=10)
    _, found = models.cross_validate(rows, lr, models.grid("logistic_regression", lr, {"regParam": [0.0, 0.1]}), ["o_orderkey"], folds=3)
    return spark.createDataFrame([(int(x["fold"]), int(x["map"]), float(x["accuracy"]), float(x["weightedPrecision"])) for x in found], "fold int, map int, accuracy double, weighted_precision double")


@query()
def hyperband_search(spark, d):
    rows = _numbers(spark, d)
    _, best, log = models.hyperband(rows, models.classifier("logistic_regression"), {"regParam": {"min": 0.0, "max": 0.3}, "elasticNetParam": [0.0, 0.5]}, budget=9, multiplier=9)
    return spark.createDataFrame([(int(x["bracket"]), int(x["iterations"]), float(x["score"]), float(x["regParam"])) for x in log], "bracket int, iterations int, score double, reg_param double")


@query(f"""with t as (select conv_id, turn, unnest({_TOKENS}) as term from conversations),
c as (select conv_id, turn, term, count(*) as n from t group by 1, 2, 3), f as (select term, count(*) as df from c group by 1), m as (select count(*) as m from conversations)
select conv_id, turn, term, n::double as tf, round(n * ln((m + 1) / (df + 1)), 6) as tfidf from c join f using (term), m""")
def text_vectorizers(spark, d):
    """Counts and TF-IDF of all terms, one row for each; no list of terms goes through the driver."""
    weights = models.term_weights(_tokens(spark, d), ["conv_id", "turn"], "t")
    return weights.select("conv_id", "turn", "term", F.col("n").cast("double").alias("tf"), F.round("tfidf", 6).alias("tfidf"))


@query()
def word_vectors(spark, d):
    tokens = _tokens(spark, d).withColumnRenamed("t", "tokens")
    vectors = models.vectorizer("word2vec", "tokens", "v", 8).fit(tokens).transform(tokens)
    return vectors.select("conv_id", "turn", F.size(vector_to_array("v")).alias("n"), F.exists(vector_to_array("v"), lambda x: x != 0).alias("filled"))


def entry(spark: SparkSession, d: str) -> DataFrame:
    return quality_model(spark, d)


__all__ = ["ORACLE", "QUERIES", "entry"]
