"""Every query with SQL against DuckDB on the smallest tables, and every other one for rows."""

import duckdb
import pytest

from echotable.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    df = registry.queries()[name](spark, DATA)
    assert df.schema == registry.queries()[name](spark, DATA).schema
    df.collect()


def test_similarity_of_whole_texts(spark, tmp_path):
    import difflib

    same = " ".join(f"word{k}" for k in range(80))
    a, b = same + " and then one end" * 9, same + " but quite another close" * 7
    rows = [(1, 0, "user", a), (1, 1, "assistant", b)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [r["similarity"] for r in registry.queries()["text_similarity"](spark, str(tmp_path)).collect()]
    assert got == [round(difflib.SequenceMatcher(None, a, b).ratio(), 6)] and got[0] < 1
