"""Every query of the catalog against its SQL, on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from conftest import DATA

from millrace.plans import catalog

FOLDER = f"{DATA}/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    found = duck.execute(catalog.ORACLE[name])
    columns = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = Counter(str([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in found.fetchall())
    assert Counter(str([plain(r[c]) for c in sorted(columns)]) for r in df.collect()) == want


def test_entry(spark):
    df = catalog.entry(spark, FOLDER)
    assert df.columns == ["doc_id", "label", "prediction", "probability"] and df.count() > 0


def test_every_query_is_registered_and_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalog.QUERIES) <= set(e.queries())


def rows_and_sql(spark, name, folder, tables):
    """The rows of a query on made tables (name: SELECT) and those of its SQL, as plain values."""
    c = duckdb.connect()
    for t, sql in tables.items():
        c.execute(f"copy ({sql}) to '{folder}/{t}.parquet' (format parquet)")
        c.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, str(folder))
    found = c.execute(catalog.ORACLE[name])
    want = Counter(tuple(plain(dict(zip([x[0] for x in found.description], r))[k]) for k in df.columns) for r in found.fetchall())
    return Counter(tuple(plain(list(r))) for r in df.collect()), want


def test_text_vectorizers_keeps_all_terms_of_large_vocabularies(spark, tmp_path):
    """More terms than 2**18, a key that two rows share, a text without terms and none at all."""
    long = "select k as conv_id, 0 as turn, (select string_agg('w' || (k * 70000 + i), ' ') from range(70000) s(i)) || ' the the' as text from range(4) t(k)"
    got, want = rows_and_sql(spark, "text_vectorizers", tmp_path, {"conversations": f"{long} union all select * from (values (0, 0, 'the W1'), (7, 1, ' '), (7, 2, null))"})
    assert len(want) == 4 * 70001 and got == want


def test_hotlead_journey_with_visitors_that_are_never_hot(spark, tmp_path):
    """3200 visitors, 201 of them hot on their first page, 64 on their fifth: a rate that ends in a half, and no other visitor in the last bucket."""
    first = "select range as event_id, timestamp '2024-01-01' as ts, range as user_id, if(range % 2 = 0, 'purchase', 'view') as event_type, if(range < 201, 95.0, 10.0)::double as value from range(3200)"
    later = "select 10000 + u * 10 + k, timestamp '2024-01-02', 1000 + u, 'purchase', if(k = 3, 99.0, 10.0)::double from range(64) a(u), range(4) b(k)"
    got, want = rows_and_sql(spark, "hotlead_journey", tmp_path, {"events": f"{first} union all {later}"})
    assert sum(n for n in want.values()) == 2 and got == want
