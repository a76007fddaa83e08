"""Links through articles are used in two tables; results equal those over all pairs of posts and claims."""

import random
from datetime import datetime

import pytest

from claimweave import session
from claimweave.operators import ego, frontier, labels, linking

LINKS = "post_id bigint, claim_id bigint, score double"


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(5)
    direct = {(rng.randrange(40), rng.randrange(30)): rng.random() for _ in range(60)}
    read = {(rng.randrange(20, 60), rng.randrange(12)) for _ in range(70)} | {(None, 1)}
    found = {(rng.randrange(14), rng.randrange(30)): rng.random() for _ in range(45)}
    links = spark.createDataFrame([(*k, v) for k, v in direct.items()], LINKS)
    via = linking.Via(
        spark.createDataFrame(list(read), "post_id bigint, article_id bigint"),
        spark.createDataFrame([(*k, v) for k, v in found.items()], "article_id bigint, claim_id bigint, score double"),
    )
    pairs = {}
    for post, article in read:
        for (a, claim), score in found.items():
            if a == article:
                pairs[post, claim] = max(score, pairs.get((post, claim), 0.0))
    return links, via, spark.createDataFrame([(*k, v) for k, v in pairs.items()], LINKS)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def test_pairs(graph):
    links, via, pairs = graph
    assert rows(linking.best_via(via)) == rows(pairs)
    assert rows(linking.posts_of(links, via)) == rows(linking.posts_of(links.unionByName(pairs)))
    assert rows(frontier.posts_above(links, 0.7, via)) == rows(frontier.posts_above(links.unionByName(pairs), 0.7))


def test_pairs_stay_where_their_post_is(spark, graph):
    """the pairs moved by post and claim before."""
    plan = linking.best_via(graph[1])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(post_id" in plan and "claim_id" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x).split("hashpartitioning")[1]


def test_pairs_in_cells(spark, graph, monkeypatch):
    """with more links than can be sent, the join by article moved all pairs to their maximum."""
    _, via, pairs = graph
    monkeypatch.setattr(linking, "SENT_LINKS", 0)
    monkeypatch.setattr(linking, "HELD_LINKS", 15)
    more = linking.Via(via.post_article.union(via.post_article), via.article_links.union(via.article_links.limit(20)))
    found = linking.best_via(more)
    assert rows(found) == rows(pairs)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert linking.best_via(linking.Via(via.post_article.limit(0), via.article_links)).isEmpty()
    got = [x.to_pylist() for x in linking._best_in_cells(2)(iter(_cells()))]
    assert [len(x) for x in got] == [2, 3] and [(r["post_id"], r["claim_id"], r["score"]) for x in got for r in x] == [(1, 7, 0.5), (1, 8, 0.9), (2, 8, 0.4), (None, 7, 0.5), (None, 8, 0.9)]


def _cells():
    """One cell in small batches: three links, then three posts, one across two batches and one without an id."""
    import pyarrow as pa

    links = [(0, 0, 0, 0, 7, 1, 0.5), (0, 0, 0, 0, 8, 1, 0.9), (0, 0, 0, 0, 8, 2, 0.4)]
    posts = [(0, 0, 1, 0, 1, 1, 0.0), (0, 0, 1, 0, 1, 2, 0.0), (0, 0, 1, 0, 2, 2, 0.0), (0, 0, 1, 1, 0, 1, 0.0)]
    names = ("pb", "cb", "kind", "none", "id", "article", "score")
    for part in (links[:2], links[2:] + posts[:1], posts[1:]):
        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*part)))))


def test_labelled_posts(spark, graph):
    links, via, pairs = graph
    has = spark.createDataFrame([(c,) for c in range(0, 30, 4)], "claim_id bigint")
    assert rows(linking.linked_posts(links, has, 0.4, via)) == rows(linking.linked_posts(linking.best_links(links, pairs), has, 0.4))


@pytest.mark.parametrize("early", [0, 1, 3])
@pytest.mark.parametrize("limit", [0, 15, 1_000_000])
def test_labels(spark, graph, monkeypatch, early, limit):
    monkeypatch.setattr(labels, "EARLY_ROUNDS", early)
    links, via, pairs = graph
    sizes = {"small": 0.85, "medium": 0.6, "large": 0.2}
    seeds = spark.createDataFrame([(z, c, "factual") for z in sizes for c in range(30) if c % 3 or z == "large"], "size string, claim_id bigint, verdict string")
    whole = linking.best_links(links, pairs)
    want = [rows(x) for x in labels.propagate_labels(whole, seeds, sizes)]
    assert [rows(x) for x in labels.propagate_labels(links, seeds, sizes, local_rows=limit, via=via)] == want


def test_labels_form_no_pairs(spark, monkeypatch):
    """400 posts that read an article of 300 claims are 120,000 pairs; written are some thousand rows."""
    written = []

    def counted(df):
        out = session.cut_lineage(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(labels, "cut_lineage", counted)
    via = linking.Via(
        spark.createDataFrame([(p, a) for p in range(400) for a in (1, 2)], "post_id bigint, article_id bigint"),
        spark.createDataFrame([(a, c, 0.9) for a in (1, 2) for c in range(300)], "article_id bigint, claim_id bigint, score double"),
    )
    seeds = spark.createDataFrame([("small", c, "factual") for c in range(300)], "size string, claim_id bigint, verdict string")
    _, has = labels.propagate_labels(spark.createDataFrame([], LINKS), seeds, {"small": 0.5}, via=via)
    assert {r.label_id for r in has.collect()} == {0} and has.count() == 300
    assert sum(written) < 10_000


def test_components_are_settled_without_pairs(spark, monkeypatch):
    """the rows of a component were its pairs of claims and readers, 60,000 here."""
    dealt, split = [], labels._by_component

    def counted(state, local_rows):
        local, rest = split(state, local_rows)
        dealt.append(local.count())
        return local, rest

    monkeypatch.setattr(labels, "EARLY_ROUNDS", 0)
    monkeypatch.setattr(labels, "_by_component", counted)
    via = linking.Via(
        spark.createDataFrame([(p, a) for p in range(200) for a in (1, 2)] + [(200, 2), (200, 3)], "post_id bigint, article_id bigint"),
        spark.createDataFrame([(a, c, 0.9) for a in (1, 2) for c in range(150)] + [(3, 150, 0.9), (3, 151, 0.9)], LINKS.replace("post", "article")),
    )
    seeds = spark.createDataFrame([("small", c, "factual") for c in range(152)], "size string, claim_id bigint, verdict string")
    links = spark.createDataFrame([(900, 151, 0.9), (900, 152, 0.9)], LINKS)
    found, has = labels.propagate_labels(links, seeds, {"small": 0.5}, via=via)
    assert [r.label_id for r in found.collect()] == [0] and dealt and max(dealt) < 1_000
    assert rows(has) == rows(labels.propagate_labels(linking.best_links(links, linking.best_via(via)), seeds, {"small": 0.5})[1])


def test_clusters(spark, graph):
    links, via, pairs = graph
    claims = spark.createDataFrame([(c, c % 4 - 1) for c in range(30)], "claim_id bigint, cluster bigint")
    reviews = spark.createDataFrame([(c, v) for c in range(30) for v in ("misinformation", "factual")[: 1 + c % 2]], "claim_id bigint, predicted_verdict string")
    posted = spark.createDataFrame([(p % 9, p) for p in range(0, 60, 2)], "user_id bigint, post_id bigint")
    tags = spark.createDataFrame([(p, p % 7) for p in range(60)], "post_id bigint, user_id bigint")
    users = spark.createDataFrame([(u, (u * 3 + 1) % 9) for u in range(9)], "src bigint, tgt bigint")
    args = (posted, tags, users, 0.3)
    got = ego.cluster_scores(claims, reviews, links, *args, via)
    assert rows(got) == rows(ego.cluster_scores(claims, reviews, links.unionByName(pairs), *args))
    has = spark.createDataFrame([(c, c, "small") for c in range(20)], "claim_id bigint, label_id bigint, size string")
    verdicts = spark.createDataFrame([(c, "small", "misinformation") for c in range(0, 20, 2)], "label_id bigint, size string, verdict string")
    whole = linking.best_links(links, pairs)
    got = ego.spreaders(claims.select("cluster").distinct(), claims, verdicts, has, links, posted, 0.3, via)
    assert rows(got) == rows(ego.spreaders(claims.select("cluster").distinct(), claims, verdicts, has, whole, posted, 0.3))


def test_new_pairs(spark, graph):
    """pairs known through articles are left out without forming all of them."""
    _, via, pairs = graph
    day = datetime(2024, 1, 5)
    claims = spark.createDataFrame([(c, day, [1.0, c / 30]) for c in range(30)], "claim_id bigint, date timestamp, embedding array<double>")
    items = spark.createDataFrame([(p, day, [1.0, p / 60]) for p in range(60)], "item_id bigint, created_at timestamp, embedding array<double>")
    known = pairs.selectExpr("post_id AS item_id", "claim_id")
    want = linking.link_by_cosine(claims, items, 0.7, existing=known)
    got = linking.link_by_cosine(claims, items, 0.7, existing_via=via)
    assert 0 < got.count() < 1800
    assert rows(got.select("item_id", "claim_id")) == rows(want.select("item_id", "claim_id"))


def test_links_meet_founders_in_small_tables_alone(spark, graph):
    """all links were moved once to be compared with the founders after the last minimum."""
    links, via, _ = graph
    seeds = spark.createDataFrame([("large", c, "factual") for c in range(30)], "size string, claim_id bigint, verdict string")
    _, has = labels.propagate_labels(links, seeds, {"large": 0.2}, via=via)
    assert has.count() and "LeftAnti" not in has._jdf.queryExecution().optimizedPlan().toString()


def test_links_read_once_are_not_written(spark, tmp_path):
    """the frontiers wrote every link to a post and to an article."""
    from claimweave.plans import views as plans
    from claimweave.plans.registry import QUERIES

    tables = {
        "embeddings": ([(i, [1.0, i / 40, 0.5], i % 3) for i in range(40)], "vec_id bigint, embedding array<float>, label int"),
        "pages": ([(i, f"http://a.example/{i}") for i in range(40)], "page_id bigint, url string"),
        "events": ([(i, i % 40, ("view", "signup")[i % 7 == 0], f'{{"k": {i * 3 % 40}}}') for i in range(60)], "event_id bigint, user_id bigint, event_type string, props string"),
        "orders": ([(i, i % 50, datetime(2024, 1, 1), "x", "O", 90000.0) for i in range(80)], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_orderpriority string, o_orderstatus string, o_totalprice double"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    v = plans.Views(spark, str(tmp_path))
    got = rows(QUERIES["frontier_follows"](v))
    assert got and not {"similar_edge", "article_links"} & set(vars(v))
    assert v.similar_edge.count() and v.article_links.count()
    assert rows(QUERIES["frontier_follows"](v)) == got
