"""Versions of tables: commits at the same time, killed runs, tidying up; the audit of keys; one embedding space."""

import itertools
import threading

import pytest
from pyspark.sql import functions as F

from claimweave import jobs, tables
from claimweave.functions.text import clean_plain
from claimweave.operators import models
from claimweave.operators.keyed import broken_keys
from claimweave.tables import Conflict, Tables


def people(spark, ids, **columns):
    return spark.createDataFrame([(i,) for i in ids], "id bigint").select("id", *[F.lit(v).alias(k) for k, v in columns.items()])


def at_once(*works):
    """Run all at the same time; errors come out."""
    errors, gate = [], threading.Barrier(len(works))

    def run(work):
        try:
            gate.wait()
            work()
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=run, args=(w,)) for w in works]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors, errors


def test_writers_at_once_lose_nothing(spark, tmp_path):
    root = str(tmp_path)
    Tables(spark, root).replace("p", people(spark, range(10), a="x"))

    def inserts(start):
        return lambda: [Tables(spark, root).insert("p", people(spark, [0, 500, start + k], a="new"), ["id"]) for k in range(3)]

    def updates(start):
        return lambda: [Tables(spark, root).update("p", people(spark, [start + k], b=str(start)), ["id"]) for k in range(3)]

    at_once(inserts(100), inserts(200), updates(0), updates(5))
    rows = {r.id: r for r in Tables(spark, root).read("p").collect()}
    assert sorted(rows) == sorted([*range(10), 500, 100, 101, 102, 200, 201, 202])
    assert Tables(spark, root).read("p").count() == 17
    assert [rows[i].b for i in (0, 1, 2, 5, 6, 7, 3)] == ["0", "0", "0", "5", "5", "5", None] and rows[0].a == "x"


def test_first_versions_at_once(spark, tmp_path):
    root = str(tmp_path)
    at_once(*[lambda k=k: Tables(spark, root).insert("p", people(spark, [k, 99]), ["id"]) for k in range(4)])
    assert sorted(r.id for r in Tables(spark, root).read("p").collect()) == [0, 1, 2, 3, 99]


def test_a_killed_run_leaves_the_version_before(spark, tmp_path, monkeypatch):
    t = Tables(spark, str(tmp_path))
    t.replace("p", people(spark, range(3), a="old"))
    before = t.read("p")
    with pytest.raises(Exception):
        t.rewrite("p", lambda p: p.withColumn("a", F.raise_error(F.lit("lost"))))

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(t, "_publish", killed)
    with pytest.raises(KeyboardInterrupt):
        t.insert("p", people(spark, range(9), a="new"), ["id"])
    monkeypatch.undo()
    assert t.read("p").count() == before.count() == 3
    assert t.vacuum("p", older_than_hours=1) == 0 and t.vacuum("p", older_than_hours=0) >= 1
    assert t.read("p").count() == 3


def test_the_number_is_taken_once(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    t.replace("p", people(spark, [1]))
    with pytest.raises(Conflict):
        t._publish("p", 1, {"folders": [], "schema": {}})
    assert t.read("p").count() == 1


def test_many_inserts_become_one_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "MANY", 4)
    t = Tables(spark, str(tmp_path))
    for k in range(7):
        t.insert("p", people(spark, [k]), ["id"])
        assert len(t._newest("p")[1]["folders"]) <= 4
    assert t.read("p").count() == 7 and len(t._numbers("p")) == tables.KEEP
    with pytest.raises(FileNotFoundError):
        t.rewrite("q", lambda q: q)
    assert t.rewrite("q", lambda q: q, "id bigint").count() == 0


def test_broken_keys(spark):
    frames = {
        "a": spark.createDataFrame([("x",), ("x",), (None,), (None,), ("y",)], "v string"),
        "b": spark.createDataFrame([(1,), (2,)], "v bigint"),
        "c": spark.createDataFrame([(7,), (7,), (7,), (3,), (3,)], "v bigint"),
    }
    assert sorted(map(tuple, broken_keys(spark, frames).collect())) == [("a", 1, 2, "x"), ("c", 2, 5, "3")]
    assert broken_keys(spark, {}).count() == 0


def test_all_twelve_keys_are_named(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    jobs.check_keys(t)
    for name in {n for n, _ in jobs.UNIQUE.values()}:
        columns = [c for n, c in jobs.UNIQUE.values() if n == name]
        t.replace(name, spark.createDataFrame([("k",) * len(columns)] * 2, ", ".join(f"{c} string" for c in columns)))
    with pytest.raises(ValueError) as e:
        jobs.check_keys(t)
    assert len(jobs.UNIQUE) == 12 and all(f"{k}: 1" in str(e.value) for k in jobs.UNIQUE if k != "user_name")
    assert {r.key for r in t.read("broken_keys").collect()} == set(jobs.UNIQUE)


# Embeddings in one space.

TEXTS = ["green cheese on the moon", "water is wet today", "the king says nothing", ""]


def cosines(t):
    vectors = {("p", r.post_id): r.embedding for r in t.read("post").collect()} | {("c", r.claim_id): r.embedding for r in t.read("claim").collect()}
    return lambda a, b: sum(x * y for x, y in zip(vectors[a], vectors[b]))


@pytest.mark.parametrize("order", list(itertools.permutations(["claim", "post", "more"])))
def test_equal_texts_meet_in_any_order_of_passes(spark, tmp_path, order):
    t = Tables(spark, str(tmp_path))
    t.insert("claim", spark.createDataFrame([(1, TEXTS[0])], "claim_id bigint, claim_en string"), ["claim_id"])
    t.insert("post", spark.createDataFrame(list(enumerate(TEXTS)), "post_id bigint, text_en string"), ["post_id"])
    for step in order:
        if step == "claim":
            assert jobs.embed_claims(t) == 1
            assert any(t.read("claim").first().embedding)
        else:
            if step == "more":
                t.insert("post", spark.createDataFrame([(9, TEXTS[0]), (10, "moon rocks are grey")], "post_id bigint, text_en string"), ["post_id"])
            jobs.embed_posts(t)
    jobs.refresh_embeddings(t)
    assert jobs.refresh_embeddings(t) == 0
    near = cosines(t)
    for a in (("p", 0), ("p", 9), ("c", 1)):
        for b in (("p", 0), ("p", 9), ("c", 1)):
            assert near(a, b) == pytest.approx(1)
    assert near(("p", 0), ("p", 1)) < 0.5 and near(("p", 3), ("p", 3)) == 0
    # The vectors are those of all texts counted at once.
    whole = t.read("post").select(F.col("text_en").alias("doc")).union(t.read("claim").select("claim_en"))
    weights = models.term_weights(models.count_terms(whole, "doc"))
    want = {r.post_id: r.embedding for r in models.embed(t.read("post").select("post_id", "text_en"), "text_en", clean_plain, weights=weights).collect()}
    for r in t.read("post").collect():
        assert r.embedding == pytest.approx(want[r.post_id], abs=1e-9)


def test_counts_add_up_and_are_taken_back(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    t.insert("post", spark.createDataFrame(list(enumerate(TEXTS)), "post_id bigint, text_en string"), ["post_id"])
    jobs.embed_posts(t)
    first = models.term_weights(t.read("embedding_counts"))
    jobs.embed_posts(t, start_from_scratch=True)
    assert models.term_weights(t.read("embedding_counts")) == pytest.approx(first)
    assert t.read("post").filter("embedding_version IS NULL").count() == 0
    at_once(*[lambda k=k: jobs.add_embedding_counts(t, models.count_terms(people(spark, [k]).select(F.lit("moon").alias("d")), "d"), "x") for k in range(3)])
    versions = [r.version for r in t.read("embedding_counts").collect()]
    assert len(versions) == len(set(versions)) == 6
    empty = models.count_terms(people(spark, []).select(F.lit("a").alias("d")), "d", 8).first()
    assert empty.n_docs == 0 and list(empty.n_with) == [0] * 8
