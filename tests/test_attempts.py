"""Failures are noted, tried again, and then left."""

import json

from pyspark.sql import functions as F

from claimweave import jobs
from claimweave.operators import attempts
from claimweave.tables import Tables


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_fold(spark):
    ledger = spark.createDataFrame([("a", "1", 2, "old"), ("a", "2", 1, "old"), ("b", "1", 1, "old")], attempts.LEDGER)
    results = spark.createDataFrame(
        [("a", "1", "new"), ("a", "2", None), ("a", "2", "x"), ("a", "3", "e"), ("a", "3", "f"), ("a", None, "no key"), ("c", "9", None)],
        "job string, key string, error string",
    )
    got = attempts.fold(ledger, results)
    assert rows(got, "job", "key", "tries", "error") == [("a", "1", 3, "new"), ("a", "3", 2, "f"), ("b", "1", 1, "old")]
    assert rows(attempts.given_up(got), "key") == [("1",)]
    inputs = spark.createDataFrame([(1,), (2,), (3,), (None,)], "id bigint")
    assert rows(attempts.open_work(inputs, "id", got, "a"), "id") == [(2,), (3,), (None,)]
    assert attempts.open_work(inputs, "id", got, "b").count() == 4


def test_a_run_with_failures_ends(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    texts = ["gut", "schlecht", "kaputt"]
    t.insert("post", spark.createDataFrame(list(enumerate(texts)), "post_id bigint, text string"), ["post_id"])
    none = spark.createDataFrame([], "text string, target string, translated string")
    log = tmp_path / "calls"

    def backend(batch, target):
        if "kaputt" in batch:
            with log.open("a") as f:
                f.write(f"{len(batch)} ")
            raise OSError("cannot read kaputt")
        return [x.upper() for x in batch]

    for k in range(5):
        jobs.translate_posts(t, none, backend)
        assert rows(t.read("post"), "post_id", "text_en") == [(0, "GUT"), (1, "SCHLECHT"), (2, None)]
        assert rows(t.read("attempts"), "job", "key", "tries", "error") == [("translate_post_text", "2", min(k + 1, 3), "cannot read kaputt")]
    asked = len(log.read_text().split())
    assert rows(jobs.rejects(t), "key") == [("2",)]
    jobs.translate_posts(t, none, backend)
    assert len(log.read_text().split()) == asked
    # A text that works at last leaves the ledger.
    t.rewrite("attempts", lambda a: a.withColumn("tries", F.lit(1).cast("long")))
    jobs.translate_posts(t, none, lambda batch, target: ["x"] * len(batch))
    assert t.read("attempts").isEmpty() and t.read("post").filter("text_en IS NULL").isEmpty()


def test_an_encoder_that_fails(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    t.insert("post", spark.createDataFrame([(1, "a"), (2, "bad")], "post_id bigint, text_en string"), ["post_id"])

    def encode(texts):
        if "bad" in texts:
            raise ValueError("bad text")
        return [[1.0, 0.0] for _ in texts]

    assert [jobs.embed_posts(t, encoder=encode) for _ in range(4)] == [2, 1, 1, 0]
    assert rows(t.read("post").filter("embedding IS NULL"), "post_id") == [(2,)]
    assert rows(jobs.rejects(t), "job", "key", "error") == [("embed_post", "2", "bad text")]


def test_unexpected_pages_are_tried_again(spark, tmp_path):
    page = lambda **x: json.dumps(x)
    good = page(data=[{"id": "1", "author_id": "1", "text": "x", "created_at": "2021-01-01T00:00:00Z"}], includes={"users": [{"id": "1", "username": "a"}]}, meta={"result_count": 1})
    bad = page(errors=[{"detail": "the service is on fire"}])
    landed = spark.createDataFrame([("fine", 0, good), ("burning", 0, bad)], "query string, page_no bigint, page string")
    root = str(tmp_path / "a")
    assert [jobs.fetch_posts(landed, root) for _ in range(4)] == [1, 0, 1, 0]
    t = Tables(spark, root)
    assert rows(jobs.rejects(t), "job", "key", "error") == [("fetch_posts", "-burning", "the service is on fire")]
    assert rows(t.read("done"), "query") == [("-burning",), ("-fine",)]
