import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.operators import linking

T = dt.datetime
CLAIMS = "claim_id bigint, date timestamp, embedding array<float>"
ITEMS = "item_id bigint, created_at timestamp, embedding array<float>"


def pairs(df):
    return sorted((r.item_id, r.claim_id, round(r.score, 6)) for r in df.collect())


def test_threshold_is_strict_and_zero_vectors_never_link(spark):
    claims = spark.createDataFrame([(1, T(2021, 1, 5), [1.0, 0.0])], CLAIMS)
    items = spark.createDataFrame(
        [
            (1, T(2021, 1, 5), [1.0, 0.0]),
            (2, T(2021, 1, 5), [0.69, 0.7238]),
            (3, T(2021, 1, 5), [0.71, 0.70420167]),
            (4, T(2021, 1, 5), [0.0, 0.0]),
            (5, T(2021, 1, 5), None),
            (6, None, [1.0, 0.0]),
        ],
        ITEMS,
    )
    assert [p[0] for p in pairs(linking.link_by_cosine(claims, items))] == [1, 3]


def test_window_is_closed_at_both_ends(spark):
    claims = spark.createDataFrame([(1, T(2021, 1, 5), [1.0, 0.0])], CLAIMS)
    times = [T(2021, 1, 2), T(2021, 1, 1, 23, 59, 59), T(2021, 1, 5), T(2021, 1, 5, 0, 0, 1)]
    items = spark.createDataFrame([(i, t, [1.0, 0.0]) for i, t in enumerate(times)], ITEMS)
    assert [p[0] for p in pairs(linking.link_by_cosine(claims, items))] == [0, 2]


@pytest.mark.parametrize("block_rows", [3, 4096])
def test_against_brute_force_with_a_hot_day(spark, block_rows):
    rng = random.Random(7)
    vec = lambda: [rng.gauss(0, 1) for _ in range(4)]
    # A third of all rows falls on one day.
    when = lambda: T(2021, 3, 1, rng.randrange(24)) if rng.random() < 0.34 else T(2021, 3, rng.randrange(1, 20), rng.randrange(24))
    claims = [(i, when(), vec()) for i in range(40)]
    items = [(i, when(), vec()) for i in range(60)]
    got = pairs(
        linking.link_by_cosine(
            spark.createDataFrame(claims, CLAIMS), spark.createDataFrame(items, ITEMS), 0.3, block_rows=block_rows
        )
    )
    want = []
    for cid, date, c in claims:
        for iid, at, p in items:
            a, b = np.float32(c).astype(float), np.float32(p).astype(float)
            s = float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
            if date - dt.timedelta(days=3) <= at <= date and s > 0.3:
                want.append((iid, cid, round(s, 6)))
    assert got == sorted(want) and len(got) > 20


def test_existing_pairs_are_left_out(spark):
    claims = spark.createDataFrame([(1, T(2021, 1, 5), [1.0])], CLAIMS)
    items = spark.createDataFrame([(1, T(2021, 1, 5), [1.0]), (2, T(2021, 1, 5), [1.0])], ITEMS)
    known = spark.createDataFrame([(1, 1)], "item_id bigint, claim_id bigint")
    assert [p[0] for p in pairs(linking.link_by_cosine(claims, items, existing=known))] == [2]


def test_unlinked_counts_the_bound_itself(spark):
    claims = spark.createDataFrame([(1,), (2,), (3,)], "claim_id bigint")
    links = spark.createDataFrame([(9, 1, 0.7), (9, 2, 0.69)], "post_id bigint, claim_id bigint, score double")
    assert sorted(r.claim_id for r in linking.unlinked_claims(claims, links).collect()) == [2, 3]


def test_links_through_articles(spark):
    links_to = spark.createDataFrame([(1, "u"), (1, "u2"), (2, "x")], "post_id bigint, url string")
    is_article = spark.createDataFrame([("u", 5), ("u2", 6)], "url string, article_id bigint")
    scores = spark.createDataFrame([(5, 7, 0.8), (6, 7, 0.9), (6, 8, 0.75)], "article_id bigint, claim_id bigint, score double")
    got = sorted(tuple(r) for r in linking.links_via_articles(links_to, is_article, scores).collect())
    assert got == [(1, 7, 0.9), (1, 8, 0.75)]


def test_plan_has_no_nested_loop_or_cross_product(spark):
    claims = spark.range(10).select(F.col("id").alias("claim_id"), F.timestamp_seconds("id").alias("date"), F.array(F.lit(1.0)).alias("embedding"))
    items = spark.range(10).select(F.col("id").alias("item_id"), F.timestamp_seconds("id").alias("created_at"), F.array(F.lit(1.0)).alias("embedding"))
    plan = linking.link_by_cosine(claims, items)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_counts_stand_for_vectors(spark):
    """512 doubles of a text went to each block of each of four days; its counts are whole numbers."""
    from claimweave.operators import models

    words = "ash birch cedar dogwood elm fir ginkgo holly".split()
    texts = [(i, dt.datetime(2024, 1, 1 + i % 5), " ".join(words[j] for j in range(8) for _ in range((i * (j + 3)) % 4))) for i in range(30)]
    docs = spark.createDataFrame([*texts, (30, dt.datetime(2024, 1, 2), ""), (31, dt.datetime(2024, 1, 2), None)], "item_id bigint, created_at timestamp, text string")
    weights = models.term_weights(models.count_terms(docs, "text", 64))
    docs = models.embed(docs, "text", None, 64, weights=weights, counts="counts")
    assert dict(docs.dtypes)["counts"] == "array<int>"

    def linked(vectors, **how):
        items = docs.select("item_id", "created_at", F.col(vectors).alias("embedding"))
        claims = items.withColumnsRenamed({"item_id": "claim_id", "created_at": "date"})
        return sorted((r.item_id, r.claim_id, round(r.score, 9)) for r in linking.link_by_cosine(claims, items, 0.7, **how).collect())

    want = linked("embedding")
    assert len(want) > 60 and linked("counts", weights=weights) == want


def test_a_full_block_of_links_stays_small():
    """links were kept as three 64-bit columns twice over, in blocks of 16 384 rows."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    n = 4096
    vec = pa.ListArray.from_arrays(np.arange(0, 4 * n + 1, 4, dtype="int32"), np.random.default_rng(1).normal(size=4 * n))
    zero = np.zeros(n, "int64")

    def block(kind, cb):
        same = {"day": zero, "cb": zero + cb, "pb": zero, "kind": zero + kind, "id": np.arange(n), "lo": zero, "hi": zero + kind + 2}
        return pa.RecordBatch.from_pydict({**same, "vec": vec})

    # Two blocks; the claims of the second come in two batches, and a third has no claims.
    second = block(0, 1)
    batches = [block(0, 0), block(1, 0), second.slice(0, 1000), second.slice(1000), block(1, 1), block(1, 2)]
    tracemalloc.start()
    found = [0, 0]
    for links in linking._score_blocks(0.6)(iter(batches)):
        found[0] += links.num_rows
        found[1] += int(links["claim_id"].to_numpy().sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    unit = vec.values.to_numpy().reshape(n, 4)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    at = np.nonzero(unit @ unit.T > 0.6)
    assert found == [2 * len(at[0]), 2 * int(at[1].sum())]
    assert len(at[0]) > n * n / 10
    assert peak < 60e6
