"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import claimweave.plans  # noqa: F401
from claimweave.plans import ORACLES, QUERIES, bind

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def ordered(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    df = bind(name)(spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert got and len(set(df.columns)) == len(df.columns)
        return
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema} == {d[0]: str(d[1]) for d in want.description}
    assert ordered(df.columns, got) == ordered(columns, want.fetchall())


def test_few_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == {"embed_text", "link_embedded_texts", "predict_verdict"}


def test_whole_tables_are_read(spark, sf):
    v = claimweave.plans.views.views(spark, sf)
    todo = {r.user_id for r in bind("frontier_timelines_whole")(spark, sf).collect()}
    assert todo.isdisjoint({r.user_id for r in v.posted.select("user_id").distinct().collect()})
    stored = {(r.reply_id, r.user_id, r.post_id) for r in v.replies.collect()}
    got = bind("upsert_graph_replies")(spark, sf).collect()
    assert got and {(r.reply_id, r.user_id, r.post_id) for r in got}.isdisjoint(stored)
