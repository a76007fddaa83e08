"""Links that are scored anew for each step and never written give what written links give."""

import random
from datetime import datetime, timedelta

import pytest

from claimweave import session
from claimweave.operators import ego, expansion, labels, linking

SIZES = {"small": 0.6, "medium": 0.45, "large": 0.3}


def rows(df):
    """Products of blocks of other shapes may differ in the last bit."""
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def graph(spark):
    """Vectors of four numbers over a few days, some ids twice, and links through articles in a second table."""
    rng = random.Random(7)
    start = datetime(2024, 1, 1)

    def some(n, hours):
        ids = [*range(n), 3, 5, 5]
        return [(i, start + timedelta(hours=hours * rng.randrange(200 // hours)), [rng.gauss(0, 1) for _ in range(4)]) for i in ids]

    claims = spark.createDataFrame([*some(60, 24), (70, None, [1.0] * 4), (71, start, None)], "claim_id bigint, date timestamp, embedding array<double>")
    items = spark.createDataFrame([*some(90, 1), (80, start, None)], "item_id bigint, created_at timestamp, embedding array<double>")
    read = spark.createDataFrame([(rng.randrange(60, 120), rng.randrange(9)) for _ in range(40)], "post_id bigint, article_id bigint")
    found = [(rng.randrange(9), rng.randrange(60), rng.uniform(0.3, 1)) for _ in range(30)]
    via = linking.Via(read.distinct(), spark.createDataFrame(found, "article_id bigint, claim_id bigint, score double"))
    scored = linking.Scored(claims, items, 0.3)
    return scored, session.cut_lineage(scored.rows()), via


def test_reductions(spark, graph):
    scored, links, _ = graph
    assert rows(scored.best("claim_id")) == rows(links.groupBy("claim_id").agg({"score": "max"}).toDF("claim_id", "score"))
    assert rows(scored.best("post_id")) == rows(links.groupBy("post_id").agg({"score": "max"}).toDF("post_id", "score"))
    assert rows(scored.pairs()) == rows(linking.best_links(links))
    values = spark.createDataFrame([(s, i, (i * 37) % 101) for s in SIZES for i in range(0, 90, 1 + len(s) % 4)], "size string, id bigint, v bigint")
    for end, other in (("post_id", "claim_id"), ("claim_id", "post_id")):
        mine = values.withColumnRenamed("id", other)
        plain = labels._sized(links, "post_id", SIZES).join(mine, ["size", other])
        assert rows(scored.least(end, mine, "v", SIZES)) == rows(plain.groupBy("size", end).agg({"v": "min"}).toDF("size", end, "v"))


@pytest.mark.parametrize("early, most", [(0, 0), (1, 10_000)])
def test_labels(spark, graph, monkeypatch, early, most):
    """F8 and others: all links were written for the labels."""
    monkeypatch.setattr(labels, "EARLY_ROUNDS", early)
    monkeypatch.setattr(labels, "MOST_WRITTEN", most)
    scored, links, via = graph
    seeds = spark.createDataFrame([(s, c, "factual") for s in SIZES for c in range(0, 62, 2)], "size string, claim_id bigint, verdict string")
    want = [rows(x) for x in labels.propagate_labels(links, seeds, SIZES, via=via)]
    written = []
    monkeypatch.setattr(labels, "cut_lineage", lambda df: (written.append(df.columns), session.cut_lineage(df))[1])
    assert [rows(x) for x in labels.propagate_labels(scored, seeds, SIZES, via=via)] == want
    assert not any("score" in x for x in written)


def test_what_is_read_off_labels(spark, graph):
    """links of labelled claims alone are scored, and pairs are not moved for a maximum of one row."""
    scored, links, via = graph
    has = spark.createDataFrame([(c,) for c in range(0, 60, 3)] * 2, "claim_id bigint")
    assert rows(linking.linked_posts(scored, has, 0.4, via)) == rows(linking.linked_posts(links, has, 0.4, via))
    whole = linking.best_links(links, linking.best_via(via))
    both = linking.Linked(scored, via)
    assert rows(both.pairs()) == rows(whole)
    assert rows(expansion.post_claims(both, has, 0.4)) == rows(expansion.post_claims(whole, has, 0.4))
    articles = linking.Scored(scored.claims, scored.items, 0.3, "article_id")
    known = spark.createDataFrame([(i, f"u{i}") for i in range(90)], "article_id bigint, url string")
    written = links.withColumnRenamed("post_id", "article_id")
    assert rows(expansion.article_claims(articles, has, 0.4)) == rows(expansion.article_claims(written, has, 0.4))
    assert rows(expansion.release_articles(known, articles, has, 0.4)) == rows(expansion.release_articles(known, written, has, 0.4))
    once = linking.Scored(scored.claims.dropDuplicates(["claim_id"]), scored.items.dropDuplicates(["item_id"]))
    assert "Aggregate" not in once.pairs()._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]


def test_clusters(spark, graph):
    """links met the claims of the clusters in a join."""
    scored, links, via = graph
    claims = scored.claims.dropDuplicates(["claim_id"]).selectExpr("claim_id", "claim_id % 5 - 1 AS cluster")
    reviews = spark.createDataFrame([(c, "misinformation") for c in range(50) for _ in range(c % 3)], "claim_id bigint, predicted_verdict string")
    posted = spark.createDataFrame([(p % 7, p) for p in range(100)], "user_id bigint, post_id bigint")
    mentions = spark.createDataFrame([(p, p % 9) for p in range(100)], "post_id bigint, user_id bigint")
    follows = spark.createDataFrame([(u, u % 4) for u in range(9)], "src bigint, tgt bigint")
    got, want = (ego.cluster_scores(claims, reviews, x, posted, mentions, follows, 0.4, via) for x in (scored, links))
    assert rows(got) == rows(want) and got.count() > 1
    verdicts = spark.createDataFrame([("small", c, "misinformation") for c in range(0, 60, 4)], "size string, label_id bigint, verdict string")
    has = verdicts.selectExpr("label_id + 1 AS claim_id", "label_id", "size")
    got, want = (ego.spreaders(claims.select("cluster").distinct(), claims, verdicts, has, x, posted, 0.4, via) for x in (scored, links))
    assert rows(got) == rows(want) and got.count() > 1
