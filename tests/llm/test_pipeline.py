"""The registered queries of the subpackage, and the corpus pipeline."""

import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from claimweave.llm import decontaminate, mixing, ngram_join, toxicity
from claimweave.llm.queries import ORACLES, QUERIES, table, training_labels

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    got, want = df.collect(), con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    key = sorted(names)
    assert sorted((tuple(r[k] for k in key) for r in got), key=repr) == sorted(
        (tuple(r[names.index(k)] for k in key) for r in want.fetchall()), key=repr
    )


@pytest.mark.parametrize("name, truth", [("op2_toxicity", "toxic"), ("op9_quality", "quality")])
def test_scores_of_all_documents(spark, sf, name, truth):
    got = {r.doc_id: r for r in QUERIES[name](spark, sf).collect()}
    docs = table(spark, sf, "documents").select("doc_id").collect()
    assert sorted(got) == sorted(r.doc_id for r in docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    labels = {r.doc_id: r[truth] for r in table(spark, sf, "labels").collect()}
    assert np.mean([got[i].predicted == y for i, y in labels.items()]) > 0.85


def test_language_of_held_out_documents(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op5_language"](spark, sf).collect()}
    langs = {r.doc_id: r.lang for r in table(spark, sf, "documents").collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert np.mean([got[i].lang_pred == langs[i] for i in held]) > 0.9


def test_stages_keep_the_columns_and_do_their_work(spark, sf):
    docs = table(spark, sf, "documents")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == columns
        if name == "toxicity":
            assert rows * 0.5 < out.count() < rows
        elif name == "n-gram Jaccard join":
            found = ngram_join.similar_components(docs)
            assert out.count() == found.select("component_id").distinct().count()
        elif name == "benchmark decontamination":
            bad = {r.doc_id for r in decontaminate.contaminated(docs, table(spark, sf, "benchmark")).collect()}
            assert bad and {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - bad
        else:
            assert out.count() == mixing.mixed_sizes(docs).selectExpr("sum(if(size = 0, 0, taken div size))").first()[0]
        docs = out
    last = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in docs.collect())
    at = 0
    for r in sorted(last, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_toxicity_is_learned_outside_the_fold(spark, sf):
    ids = [r.doc_id for r in training_labels(spark, sf).collect()]
    assert ids and all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    assert toxicity.TRAIN_DOCS > 0
