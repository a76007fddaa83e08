import itertools
import random

import pytest

from claimweave.operators import ego, expansion, frontier

USER_POST = "user_id bigint, post_id bigint"
REPLY = "reply_id bigint, user_id bigint, post_id bigint"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def best(pairs):
    out = {}
    for p, r in pairs:
        out[p] = max(r, out.get(p, 0))
    return sorted(out.items())


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(3)
    hub = lambda n: 0 if rng.random() < 0.34 else rng.randrange(n)
    g = {
        "linked": {p: round(rng.random(), 3) for p in rng.sample(range(30), 12)},
        "posted": {(hub(10), p) for p in range(30)},
        "retweeted": {(rng.randrange(10), hub(30)) for _ in range(25)},
        "follows": {(hub(10), rng.randrange(10)) for _ in range(20)},
        "replies": {(r, rng.randrange(10), hub(30)) for r in range(25)},
        "hashtags": {(rng.randrange(30), f"h{hub(8)}") for _ in range(60)},
    }
    d = {
        "linked": spark.createDataFrame(list(g["linked"].items()), "post_id bigint, relevance double"),
        "posted": spark.createDataFrame(list(g["posted"]), USER_POST),
        "retweeted": spark.createDataFrame(list(g["retweeted"]), USER_POST),
        "follows": spark.createDataFrame(list(g["follows"]), "src bigint, tgt bigint"),
        "replies": spark.createDataFrame(list(g["replies"]), REPLY),
        "hashtags": spark.createDataFrame(list(g["hashtags"]), "post_id bigint, name string"),
    }
    return g, d


def test_two_hop_patterns_against_pairs(graph):
    g, d = graph
    rel = g["linked"]
    want = best((t, rel[n]) for (n, h), (t, k) in itertools.product(g["hashtags"], repeat=2) if h == k and n in rel and t != n)
    assert rows(expansion.posts_by_hashtag(d["linked"], d["hashtags"])) == want

    by = [(t, rel[n]) for (u, n), (w, t) in itertools.product(g["posted"], repeat=2) if u == w and n in rel and t != n]
    by += [(t, rel[n]) for (u, n), (w, t) in itertools.product(g["retweeted"], g["posted"]) if u == w and n in rel]
    assert rows(expansion.posts_by_coposter(d["linked"], d["posted"], d["retweeted"])) == best(by)

    # One edge may not serve twice: with a self-follow the posts must differ.
    for forward, fn in ((True, expansion.posts_by_followee), (False, expansion.posts_by_follower)):
        hits = [
            (t, rel[n])
            for (a, n), (x, y), (u, t) in itertools.product(g["posted"], g["follows"], g["posted"])
            if n in rel and ((x, y) == (a, u) if forward else (x, y) == (u, a)) and (a, n) != (u, t)
        ]
        assert rows(fn(d["linked"], d["posted"], d["follows"])) == best(hits)

    hits = [(t, rel[n]) for (_, u, n), (w, t) in itertools.product(g["replies"], g["posted"]) if u == w and n in rel]
    assert rows(expansion.posts_by_replier(d["linked"], d["posted"], d["replies"])) == best(hits)


def test_a_linked_post_returns_only_over_a_second_edge(spark):
    linked = spark.createDataFrame([(1, 0.9)], "post_id bigint, relevance double")
    posted = spark.createDataFrame([(5, 1)], USER_POST)
    none = spark.createDataFrame([], USER_POST)
    assert rows(expansion.posts_by_coposter(linked, posted, none)) == []
    assert rows(expansion.posts_by_coposter(linked, posted, posted)) == [(1, 0.9)]


def test_best_relevance_per_id(spark):
    a = spark.createDataFrame([(7, 0.71), (7, 0.93), (8, 0.8)], "post_id bigint, relevance double")
    assert rows(expansion.best_per(["post_id"], a, a)) == [(7, 0.93), (8, 0.8)]


def test_replies_of_retweeters_are_dropped(spark):
    linked = spark.createDataFrame([(1, 0.9)], "post_id bigint, relevance double")
    replies = spark.createDataFrame([(10, 5, 1), (11, 6, 1), (12, 6, 2)], REPLY)
    retweeted = spark.createDataFrame([(5, 1), (6, 2)], USER_POST)
    assert rows(expansion.reply_nodes(linked, replies, retweeted)) == [(11, 0.9)]
    assert rows(expansion.rel_replies(linked, replies, retweeted)) == [(11, 1, 0.9)]


def test_users_and_follow_relations(spark):
    linked = spark.createDataFrame([(1, 0.9), (2, 0.8)], "post_id bigint, relevance double")
    posted = spark.createDataFrame([(5, 1), (6, 2)], USER_POST)
    follows = spark.createDataFrame([(5, 7), (8, 5), (6, 5)], "src bigint, tgt bigint")
    retweeted = spark.createDataFrame([(9, 2)], USER_POST)
    assert rows(expansion.release_users(linked, posted, retweeted, follows)) == [
        (5, 0.8), (6, 0.9), (7, 0.9), (8, 0.9), (9, 0.8)]
    assert rows(expansion.rel_follows(linked, posted, follows)) == [(5, 7, 0.9), (6, 5, 0.9), (8, 5, 0.9)]
    assert rows(expansion.rel_retweeted(linked, retweeted)) == [(9, 2, 0.8)]


def chained(reviews, claims, links, posted, pm, um, tau=0.7):
    """The five optional matches, taken literally."""
    scores = {}
    opt = lambda xs: xs or [None]
    for claim, verdict in reviews:
        if verdict != "misinformation" or claims.get(claim, -1) < 0:
            continue
        for post, c, score in links:
            if c != claim or score <= tau:
                continue
            for u1 in opt([u for u, p in posted if p == post]):
                for u2 in opt([u for p, u in pm if p == post]):
                    for u3 in opt([b for a, b in um if a == u1 and u1 is not None]):
                        for u4 in opt([a for a, b in um if b == u1 and u1 is not None]):
                            paths = [v for p, x in pm if x == u1 and u1 is not None for v, q in posted if q == p]
                            for u5 in opt(paths):
                                n = sum(x is not None for x in (u1, u2, u3, u4, u5))
                                scores[claims[claim]] = scores.get(claims[claim], 0) + n
    return scores


def score_frames(spark, reviews, claims, links, posted, pm, um):
    return ego.cluster_scores(
        spark.createDataFrame(list(claims.items()), "claim_id bigint, cluster bigint"),
        spark.createDataFrame(reviews, "claim_id bigint, predicted_verdict string"),
        spark.createDataFrame(links, "post_id bigint, claim_id bigint, score double"),
        spark.createDataFrame(posted, USER_POST),
        spark.createDataFrame(pm, "post_id bigint, user_id bigint"),
        spark.createDataFrame(um, "src bigint, tgt bigint"),
    )


def test_cluster_score_fixture(spark):
    reviews, claims, links = [(1, "misinformation")], {1: 4}, [(10, 1, 0.9)]
    # The post mentions two users; its poster 5 mentions none, is mentioned by 3 and by one post.
    posted = [(5, 10), (7, 11)]
    pm = [(10, 20), (10, 21), (11, 5)]
    um = [(30, 5), (31, 5), (32, 5)]
    got = score_frames(spark, reviews, claims, links, posted, pm, um).collect()
    assert [(r.cluster, r.num_users, r.distinct_users) for r in got] == [(4, 24, 1)]
    got = score_frames(spark, reviews, claims, links, [(7, 11)], pm, um).collect()
    assert [(r.num_users, r.distinct_users) for r in got] == [(2, 0)]


@pytest.mark.parametrize("seed", range(3))
def test_cluster_scores_equal_the_chained_matches(spark, seed):
    rng = random.Random(seed)
    reviews = [(rng.randrange(4), rng.choice(["misinformation", "factual"])) for _ in range(6)]
    claims = {c: rng.randrange(-1, 2) for c in range(4)}
    links = [(rng.randrange(6), rng.randrange(4), rng.choice([0.6, 0.9])) for _ in range(8)]
    posted = sorted({(rng.randrange(5), p) for p in range(5)})
    pm = sorted({(rng.randrange(6), rng.randrange(5)) for _ in range(6)})
    um = sorted({(rng.randrange(5), rng.randrange(5)) for _ in range(6)})
    got = {r.cluster: r.num_users for r in score_frames(spark, reviews, claims, links, posted, pm, um).collect()}
    assert got == chained(reviews, claims, links, posted, pm, um)


def test_ego_and_unrelated_edges(spark):
    users = spark.createDataFrame([(0, 1)], "cluster bigint, user_id bigint")
    posted = spark.createDataFrame([(1, 10), (2, 11), (3, 12), (4, 13)], USER_POST)
    pm = spark.createDataFrame([(10, 5), (11, 1), (12, 6), (13, 5)], "post_id bigint, user_id bigint")
    um = spark.createDataFrame([(1, 7), (8, 1), (3, 9)], "src bigint, tgt bigint")
    edges = ego.ego_edges(users, posted, pm, um)
    assert rows(edges) == [(0, 1, 5), (0, 1, 7), (0, 2, 1), (0, 8, 1)]
    known = spark.createDataFrame([(1, 1, 1, 1), (5, 2, 2, 2)], "user_id bigint, following_count bigint, followers_count bigint, tweet_count bigint")
    assert rows(ego.ego_features(edges, known)) == [(0, 1, 1, 1, 1), (0, 5, 2, 2, 2)] or len(rows(ego.ego_features(edges, known))) == 2
    related = ego.touched_users(edges).select("user_id")
    texts = spark.createDataFrame([(12,), (13,)], "post_id bigint")
    assert rows(ego.unrelated_edges(texts, posted, pm, um, related)) == [(3, 6), (3, 9)]


def test_frontiers(spark):
    linked = spark.createDataFrame([(1,), (2,), (3,)], "post_id bigint")
    posted = spark.createDataFrame([(5, 1), (6, 2), (7, 3), (7, 4)], USER_POST)
    follows = spark.createDataFrame([(9, 5)], "src bigint, tgt bigint")
    assert rows(frontier.follow_frontier(linked, posted, follows)) == [(6,), (7,)]
    posts = spark.createDataFrame(
        [(1, 3, 1, 0), (2, 5, 0, 0), (3, 0, 2, None), (4, 9, 9, 9)],
        "post_id bigint, retweet_count bigint, reply_count bigint, quote_count bigint",
    )
    replies = spark.createDataFrame([(20, 8, 2)], REPLY)
    got = [tuple(r) for r in frontier.reply_frontier(linked, posts, replies).collect()]
    assert got == [(1, 1), (3, None)]
    retweeted = spark.createDataFrame([(8, 1)], USER_POST)
    assert [tuple(r) for r in frontier.retweet_frontier(linked, posts, retweeted).collect()] == [(2, 5)]
    lines = frontier.timelines(linked, posted, retweeted, replies, follows, 1)
    assert rows(lines.select("user_id", "kind", "batch_id")) == [(8, 1, 0), (9, 3, 0)]


def test_inserting_fetched_edges(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id bigint")
    posts = spark.createDataFrame([(10,)], "post_id bigint")
    follows = spark.createDataFrame([(2, 1)], "src bigint, tgt bigint")
    pages = spark.createDataFrame([(2, 1, 1), (3, 1, 1), (3, 1, 1), (4, 9, 9)], "src bigint, tgt bigint, anchor bigint")
    new_users, new_edges = frontier.insert_follows(users, follows, pages)
    assert rows(new_users) == [(3,)] and rows(new_edges) == [(3, 1)]
    got = spark.createDataFrame([(3, 10), (3, 10), (4, 99), (None, 10)], USER_POST)
    new_users, new_edges = frontier.insert_retweets(posts, users, got.limit(0), got)
    assert rows(new_users) == [(3,)] and rows(new_edges) == [(3, 10)]
    page = spark.createDataFrame([(50, 3, 10), (51, 4, 99)], REPLY)
    new_users, new_edges = frontier.insert_replies(posts, users, page.limit(0), page)
    assert rows(new_users) == [(3,), (4,)] and rows(new_edges) == [(50, 3, 10)]
    line = spark.createDataFrame([(10, 1), (11, 1), (12, 9)], "post_id bigint, user_id bigint")
    new_posts, new_edges = frontier.insert_timelines(posts, users, got.limit(0), line)
    assert rows(new_posts) == [(11,), (12,)] and rows(new_edges) == [(1, 10), (1, 11)]


def test_cluster_scores_of_large_degrees(spark):
    n = 60_000
    one = lambda sql: spark.sql(sql)
    got = ego.cluster_scores(
        one("SELECT 1L AS claim_id, 4L AS cluster"), one("SELECT 1L AS claim_id, 'misinformation' AS predicted_verdict"),
        one("SELECT 1L AS post_id, 1L AS claim_id, 0.9D AS score"), one("SELECT 5L AS user_id, 1L AS post_id"),
        spark.range(n).selectExpr("1L AS post_id", "5L AS user_id"),
        spark.range(n).selectExpr("5L AS src", "5L AS tgt"),
    ).first()
    assert (int(got.num_users), got.distinct_users) == (5 * n**4, 1)
