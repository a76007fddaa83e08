"""Linking, labels, expansion, release, ego networks and frontiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.operators import ego, expansion, frontier, graph_sql, keyed, labels, linking
from claimweave.plans.registry import joined, query, score, stamp
from claimweave.plans.views import EGO_TAU, TAU, TOP, Views
from claimweave.session import cut_lineage
from claimweave.sources.release import similarity_scores

# Linking.


@query("link_posts_to_claims", "SELECT post_id, claim_id, round(score, 6) AS score FROM similar_edge", ("similar_edge",))
def _(v: Views):
    return v.similar_posts().select("post_id", "claim_id", score("score"))


@query("link_articles_to_claims", "SELECT article_id, claim_id, round(score, 6) AS score FROM article_links", ("article_links",))
def _(v: Views):
    return v.similar_articles().select("article_id", "claim_id", score("score"))


@query(
    "unlinked_claims",
    "SELECT claim_id, cluster FROM claims WHERE claim_id NOT IN (SELECT claim_id FROM similar_edge WHERE score >= 0.25)",
    ("claims", "similar_edge"),
)
def _(v: Views):
    return linking.unlinked_claims(v.claims, v.similar_edge, 0.25).select("claim_id", "cluster")


@query("similar_via_article", "SELECT post_id, claim_id, round(score, 6) AS score FROM via_article", ("via_article",))
def _(v: Views):
    links = linking.links_via_articles(v.links_to, v.is_article, v.via.article_links)
    return links.select("post_id", "claim_id", score("score"))


@query(
    "link_new_pairs",
    f"""SELECT post_id, claim_id, round(score, 6) AS score FROM similar_edge s
        WHERE NOT EXISTS (SELECT 1 FROM via_article a WHERE a.post_id = s.post_id AND a.claim_id = s.claim_id)""",
    ("similar_edge", "via_article"),
)
def _(v: Views):
    items = v.posts_vec.withColumnRenamed("post_id", "item_id")
    fresh = linking.link_by_cosine(v.claims, items, TAU, existing_via=v.via)
    return fresh.select(F.col("item_id").alias("post_id"), "claim_id", score("score"))


@query("similarity_scores", "SELECT round(score, 6) AS similarity FROM links", ("links",))
def _(v: Views):
    return similarity_scores(v.links.pairs()).select(score("similarity"))


@query(
    "claim_embeddings_linked",
    """SELECT claim_id, cluster, CAST(len(embedding) AS BIGINT) AS dimensions, round(CAST(list_sum(CAST(embedding AS DOUBLE[])) AS DOUBLE), 6) AS total
       FROM claims WHERE claim_id IN (SELECT claim_id FROM similar_edge WHERE score > 0.2)""",
    ("claims", "similar_edge"),
)
def _(v: Views):
    rows = linking.linked_claims(v.claims, v.similar_edge.filter("score > 0.2"))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select(
        "claim_id", "cluster", F.size("embedding").cast("bigint").alias("dimensions"), F.round(total, 6).alias("total")
    )


# Labels and split.


@query("label_seeds", "SELECT size, claim_id, verdict FROM seed", ("seed",))
def _(v: Views):
    return v.seeds()


@query("propagate_labels", "SELECT claim_id, label_id, size FROM has_label", ("has_label",))
def _(v: Views):
    return v.propagate()[1]


@query("propagated_verdicts", "SELECT label_id, size, verdict FROM label", ("label",))
def _(v: Views):
    return v.labels


_SPLIT = """
    , per AS (
        SELECT h.size, c.cluster, count(DISTINCT h.label_id) AS num
        FROM has_label h JOIN claims c ON c.claim_id = h.claim_id GROUP BY ALL),
    quota AS (SELECT size, floor(0.1 * count(*)) AS m FROM label GROUP BY size),
    ordered AS (
        SELECT p.*, q.m,
               coalesce(sum(num) OVER (PARTITION BY p.size ORDER BY num, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM per p JOIN quota q ON q.size = p.size WHERE cluster <> -1),
    totals AS (SELECT size, sum(num) FILTER (before < m) AS v FROM ordered GROUP BY size),
    placed AS (
        SELECT o.size, o.cluster, o.num,
               CASE WHEN before < m THEN 'val' WHEN before - coalesce(v, 0) < m THEN 'test' ELSE 'train' END AS part
        FROM ordered o JOIN totals t ON t.size = o.size
        UNION ALL SELECT size, cluster, num, 'train' FROM per WHERE cluster = -1),
    first_part AS (
        SELECT h.size, h.label_id, arg_min(p.part, (p.num, p.cluster)) AS part
        FROM has_label h JOIN claims c ON c.claim_id = h.claim_id
        JOIN placed p ON p.size = h.size AND p.cluster = c.cluster GROUP BY ALL),
    split AS (
        SELECT l.label_id, l.size, l.verdict, f.part = 'train' AS train_mask, f.part = 'val' AS val_mask, f.part = 'test' AS test_mask
        FROM label l LEFT JOIN first_part f ON f.size = l.size AND f.label_id = l.label_id)
"""


def _split_sql(body: str, *uses: str) -> str:
    from claimweave.plans.views import with_views

    return with_views(_SPLIT + body, "has_label", "label", "claims", *uses)


@query("split_labels")
def _(v: Views):
    return labels.split_labels(v.labels, v.has_label, v.claims)


@query("claim_release")
def _(v: Views):
    split = labels.split_labels(v.labels, v.has_label, v.claims)
    rows = expansion.claim_release(v.claims, v.has_reviewed, split, v.has_label)
    return rows.select("claim_id", "cluster", stamp("date"), "label", joined("reviewers"), *[
        f"{s}_{p}_mask" for s in ("small", "medium", "large") for p in ("train", "val", "test")
    ])


def _late_oracles():
    from claimweave.plans.registry import ORACLES

    ORACLES["split_labels"] = _split_sql("SELECT * FROM split")
    masks = ", ".join(
        f"coalesce(bool_or({p}_mask) FILTER (s.size = '{s}'), false) AS {s}_{p}_mask"
        for s in ("small", "medium", "large")
        for p in ("train", "val", "test")
    )
    ORACLES["claim_release"] = _split_sql(
        f"""SELECT c.claim_id, c.cluster, strftime(c.date, '%Y-%m-%d %H:%M:%S') AS date, l.label, r.reviewers, l.* EXCLUDE (claim_id, label)
            FROM claims c
            JOIN (SELECT h.claim_id, arg_min(s.verdict, (s.label_id, s.size)) AS label, {masks}
                  FROM has_label h JOIN split s ON s.label_id = h.label_id AND s.size = h.size GROUP BY h.claim_id) l
              ON l.claim_id = c.claim_id
            JOIN (SELECT claim_id, string_agg(DISTINCT reviewer, '|' ORDER BY reviewer) AS reviewers FROM has_reviewed
                  WHERE predicted_verdict IN ('misinformation', 'factual') GROUP BY claim_id) r
              ON r.claim_id = c.claim_id""",
        "has_reviewed",
    )


_late_oracles()

# Neighbourhoods. The SQL forms all pairs of a pattern and takes the maximum.

_PATTERNS = {
    "posts_by_hashtag": """
        SELECT b.post_id, l.relevance FROM linked l
        JOIN has_hashtag a ON a.post_id = l.post_id JOIN has_hashtag b ON b.name = a.name AND b.post_id <> a.post_id""",
    "posts_by_coposter": """
        SELECT t.post_id, l.relevance FROM linked l
        JOIN posted a ON a.post_id = l.post_id JOIN posted t ON t.user_id = a.user_id AND t.post_id <> a.post_id
        UNION ALL
        SELECT t.post_id, l.relevance FROM linked l
        JOIN retweeted a ON a.post_id = l.post_id JOIN posted t ON t.user_id = a.user_id""",
    "posts_by_followee": """
        SELECT t.post_id, l.relevance FROM linked l JOIN posted a ON a.post_id = l.post_id
        JOIN follows f ON f.src = a.user_id JOIN posted t ON t.user_id = f.tgt""",
    "posts_by_follower": """
        SELECT t.post_id, l.relevance FROM linked l JOIN posted a ON a.post_id = l.post_id
        JOIN follows f ON f.tgt = a.user_id JOIN posted t ON t.user_id = f.src""",
    "posts_by_replier": """
        SELECT t.post_id, l.relevance FROM linked l JOIN replies r ON r.post_id = l.post_id
        JOIN posted t ON t.user_id = r.user_id""",
}
_GRAPH = ("linked", "has_hashtag", "posted", "retweeted", "follows", "replies")
_KEPT = """
    SELECT r.reply_id, r.post_id, l.relevance FROM linked l JOIN {table} r ON r.post_id = l.post_id
    WHERE NOT EXISTS (SELECT 1 FROM {table} o JOIN retweeted w ON w.user_id = o.user_id AND w.post_id = l.post_id
                      WHERE o.reply_id = r.reply_id AND o.post_id = r.post_id)"""


def _best_sql(key: str, *patterns: str) -> str:
    return f"SELECT {key}, round(max(relevance), 6) AS relevance FROM ({' UNION ALL '.join(patterns)}) GROUP BY ALL"


def _nearby(name: str, plan):
    query(name, _best_sql("post_id", _PATTERNS[name]), _GRAPH)(lambda v: plan(v).select("post_id", score("relevance")))


_nearby("posts_by_hashtag", lambda v: expansion.posts_by_hashtag(v.linked, v.has_hashtag))
_nearby("posts_by_coposter", lambda v: expansion.posts_by_coposter(v.linked, v.posted, v.retweeted))
_nearby("posts_by_followee", lambda v: expansion.posts_by_followee(v.linked, v.posted, v.follows))
_nearby("posts_by_follower", lambda v: expansion.posts_by_follower(v.linked, v.posted, v.follows))
_nearby("posts_by_replier", lambda v: expansion.posts_by_replier(v.linked, v.posted, v.replies))


@query("linked_posts", "SELECT post_id, round(relevance, 6) AS relevance FROM linked", ("linked",))
def _(v: Views):
    return linking.linked_posts(v.scored_posts(), v.has_label, TAU, v.via).select("post_id", score("relevance"))


@query("release_posts", _best_sql("post_id", *_PATTERNS.values()), _GRAPH)
def _(v: Views):
    return expansion.release_posts(v.linked, v.posted, v.retweeted, v.follows, v.replies, v.has_hashtag).select(
        "post_id", score("relevance")
    )


_FOLLOW_USERS = """
    SELECT f.src AS user_id, l.relevance FROM linked l JOIN posted a ON a.post_id = l.post_id JOIN follows f ON f.tgt = a.user_id
    UNION ALL
    SELECT f.tgt, l.relevance FROM linked l JOIN posted a ON a.post_id = l.post_id JOIN follows f ON f.src = a.user_id"""


@query(
    "release_users",
    _best_sql("user_id", "SELECT w.user_id, l.relevance FROM linked l JOIN retweeted w ON w.post_id = l.post_id", _FOLLOW_USERS),
    _GRAPH,
)
def _(v: Views):
    return expansion.release_users(v.linked, v.posted, v.retweeted, v.follows).select("user_id", score("relevance"))


@query("release_replies", _best_sql("reply_id AS post_id", f"SELECT reply_id, relevance FROM ({_KEPT.format(table='replies')})"), _GRAPH)
def _(v: Views):
    return expansion.reply_nodes(v.linked, v.replies, v.retweeted).select("post_id", score("relevance"))


@query(
    "release_articles",
    f"""SELECT a.article_id AS id, a.url, round(max(s.score), 6) AS relevance
        FROM article_links s JOIN articles a ON a.article_id = s.article_id
        WHERE s.score > {TAU} AND s.claim_id IN (SELECT claim_id FROM has_label) GROUP BY ALL""",
    ("article_links", "articles", "has_label"),
)
def _(v: Views):
    return expansion.release_articles(v.articles, v.scored_articles(), v.has_label, TAU).select("id", "url", score("relevance"))


@query(
    "rel_follows",
    _best_sql(
        "src, tgt",
        "SELECT f.src, f.tgt, l.relevance FROM linked l JOIN posted a ON a.post_id = l.post_id JOIN follows f ON f.tgt = a.user_id",
        "SELECT f.src, f.tgt, l.relevance FROM linked l JOIN posted a ON a.post_id = l.post_id JOIN follows f ON f.src = a.user_id",
    ),
    _GRAPH,
)
def _(v: Views):
    return expansion.rel_follows(v.linked, v.posted, v.follows).select("src", "tgt", score("relevance"))


@query(
    "rel_retweeted",
    _best_sql("src, tgt", "SELECT w.user_id AS src, w.post_id AS tgt, l.relevance FROM linked l JOIN retweeted w ON w.post_id = l.post_id"),
    _GRAPH,
)
def _(v: Views):
    return expansion.rel_retweeted(v.linked, v.retweeted).select("src", "tgt", score("relevance"))


def _rel_reply(name: str, table: str):
    sql = _best_sql("reply_id AS src, post_id AS tgt", _KEPT.format(table=table))
    query(name, sql, ("linked", table, "retweeted"))(
        lambda v: expansion.rel_replies(v.linked, getattr(v, table), v.retweeted).select("src", "tgt", score("relevance"))
    )


_rel_reply("rel_reply_to", "reply_to")
_rel_reply("rel_quote_of", "quote_of")


def _rel_claim(name: str, table: str, key: str, plan, links):
    sql = f"""SELECT {key} AS src, claim_id AS tgt, round(max(score), 6) AS relevance FROM {table}
              WHERE score > {TAU} AND claim_id IN (SELECT claim_id FROM has_label) GROUP BY ALL"""
    query(name, sql, (table, "has_label"))(lambda v: plan(links(v), v.has_label, TAU).select("src", "tgt", score("relevance")))


_rel_claim("rel_post_claim", "links", "post_id", expansion.post_claims, lambda v: v.links)
_rel_claim("rel_article_claim", "article_links", "article_id", expansion.article_claims, Views.scored_articles)

# Ego networks. The SQL counts the chained left joins of one post as they stand, then adds
# them up, so that it does not repeat the degree formula.

_SCORES = f"""
    WITH_PLACEHOLDER
    base AS (
        SELECT c.cluster, l.post_id, count(*) AS n
        FROM has_reviewed r JOIN claims c ON c.claim_id = r.claim_id
        JOIN (SELECT post_id, claim_id, score FROM similar_edge UNION ALL SELECT post_id, claim_id, score FROM via_article) l
          ON l.claim_id = c.claim_id
        WHERE r.predicted_verdict = 'misinformation' AND l.score > {EGO_TAU} AND c.cluster >= 0 GROUP BY ALL),
    around AS (
        SELECT t.post_id, p.user_id AS u1, m.user_id AS u2
        FROM (SELECT DISTINCT post_id FROM base) t
        LEFT JOIN posted p ON p.post_id = t.post_id LEFT JOIN post_mentions m ON m.post_id = t.post_id),
    chain AS (
        SELECT a.u1, a.post_id, a.u2, u3.tgt AS u3, u4.src AS u4
        FROM around a
        LEFT JOIN user_mentions u3 ON u3.src = a.u1 LEFT JOIN user_mentions u4 ON u4.tgt = a.u1),
    paths AS (
        SELECT m.user_id AS target, count(*) AS k FROM post_mentions m JOIN posted p ON p.post_id = m.post_id GROUP BY ALL),
    counted AS (
        SELECT c.post_id, min(c.u1) AS poster,
               sum(greatest(coalesce(k, 0), 1) * (if(u1 IS NULL, 0, 1) + if(u2 IS NULL, 0, 1) + if(u3 IS NULL, 0, 1) + if(u4 IS NULL, 0, 1))
                   + coalesce(k, 0)) AS num
        FROM chain c LEFT JOIN paths p ON p.target = c.u1 GROUP BY c.post_id),
    scores AS (
        SELECT b.cluster, sum(CAST(b.n AS HUGEINT) * c.num) AS num_users, count(DISTINCT c.poster) AS distinct_users
        FROM base b JOIN counted c ON c.post_id = b.post_id GROUP BY b.cluster),
    top AS (SELECT * FROM scores ORDER BY num_users DESC, cluster LIMIT {TOP})
"""
_EGO = (
    "has_reviewed", "claims", "similar_edge", "via_article", "posted", "post_mentions", "user_mentions", "links",
    "has_label", "label", "users",
)
_SPREADERS = f""",
    spreader AS (
        SELECT DISTINCT c.cluster, p.user_id
        FROM top t JOIN claims c ON c.cluster = t.cluster
        JOIN has_label h ON h.claim_id = c.claim_id
        JOIN label b ON b.label_id = h.label_id AND b.size = h.size AND b.verdict = 'misinformation'
        JOIN links l ON l.claim_id = c.claim_id AND l.score > {EGO_TAU}
        JOIN posted p ON p.post_id = l.post_id),
    ego_edge AS (
        SELECT s.cluster, s.user_id AS user1_id, m.tgt AS user2_id FROM spreader s JOIN user_mentions m ON m.src = s.user_id
        WHERE s.user_id IN (SELECT user_id FROM posted)
        UNION SELECT s.cluster, s.user_id, m.user_id FROM spreader s JOIN posted p ON p.user_id = s.user_id
              JOIN post_mentions m ON m.post_id = p.post_id
        UNION SELECT s.cluster, m.src, s.user_id FROM spreader s JOIN user_mentions m ON m.tgt = s.user_id
        UNION SELECT s.cluster, p.user_id, s.user_id FROM spreader s JOIN post_mentions m ON m.user_id = s.user_id
              JOIN posted p ON p.post_id = m.post_id),
    touched AS (SELECT cluster, user1_id AS user_id FROM ego_edge UNION SELECT cluster, user2_id FROM ego_edge),
    related AS (SELECT user_id FROM touched WHERE user_id IN (SELECT user_id FROM users))
"""


def _ego_sql(body: str) -> str:
    from claimweave.plans.views import with_views

    return with_views(_SCORES.replace("WITH_PLACEHOLDER", ",") + _SPREADERS + body, *_EGO)


def _ego_edges(v: Views):
    return ego.ego_edges(v.spreaders, v.posted, v.post_mentions, v.user_mentions)


@query("top_clusters")
def _(v: Views):
    return ego.top_clusters(v.cluster_scores(), TOP).withColumn("num_users", F.col("num_users").cast("string"))


@query("cluster_spreaders")
def _(v: Views):
    return v.find_spreaders()


@query("ego_edges")
def _(v: Views):
    return _ego_edges(v)


@query("ego_features")
def _(v: Views):
    return ego.ego_features(_ego_edges(v), v.users)


@query("unrelated_edges")
def _(v: Views):
    related = cut_lineage(ego.ego_features(_ego_edges(v), v.users).select("user_id").distinct())
    return ego.unrelated_edges(v.posts.filter("text IS NOT NULL"), v.posted, v.post_mentions, v.user_mentions, related)


def _ego_oracles():
    from claimweave.plans.registry import ORACLES

    ORACLES["top_clusters"] = _ego_sql("SELECT * REPLACE (CAST(num_users AS VARCHAR) AS num_users) FROM top")
    ORACLES["cluster_spreaders"] = _ego_sql("SELECT * FROM spreader")
    ORACLES["ego_edges"] = _ego_sql("SELECT * FROM ego_edge")
    ORACLES["ego_features"] = _ego_sql(
        """SELECT t.cluster, u.user_id, u.following_count, u.followers_count, u.tweet_count
           FROM touched t JOIN users u ON u.user_id = t.user_id"""
    )
    ORACLES["unrelated_edges"] = _ego_sql(
        """SELECT * FROM (
               SELECT p.user_id AS user1_id, m.tgt AS user2_id FROM posted p JOIN user_mentions m ON m.src = p.user_id
               UNION SELECT p.user_id, m.user_id FROM posted p JOIN post_mentions m ON m.post_id = p.post_id)
           WHERE user1_id NOT IN (SELECT user_id FROM related) AND user2_id NOT IN (SELECT user_id FROM related)"""
    )


_ego_oracles()

# Frontiers.

_STRONG = "strong AS (SELECT DISTINCT post_id FROM links WHERE score > 0.2)"


def _strong_sql(body: str, *uses: str) -> str:
    from claimweave.plans.views import with_views

    return with_views(f", {_STRONG} {body}", "links", *uses)


def _strong(v: Views):
    return cut_lineage(frontier.posts_above(v.scored_posts(0.2).best("post_id"), 0.2, v.via))


@query("frontier_follows")
def _(v: Views):
    return frontier.follow_frontier(_strong(v), v.posted, v.follows)


@query("frontier_replies")
def _(v: Views):
    return frontier.reply_frontier(_strong(v), v.posts, v.replies)


@query("frontier_retweets")
def _(v: Views):
    return frontier.retweet_frontier(_strong(v), v.posts, v.retweeted)


def _silent_follows(v: Views):
    """Follows, and beside them who clicked on a user's page: accounts numbered behind all others, so
    that they have no post of their own."""
    clicks = v.table("events").filter("event_type = 'click'").select((F.col("event_id") + 1_000_000_000).alias("src"), F.col("user_id").alias("tgt"))
    return v.follows.select("src", "tgt").union(clicks)


@query("frontier_timelines")
def _(v: Views):
    return frontier.timelines(v.linked.select("post_id"), v.posted, v.retweeted, v.replies, _silent_follows(v), 10).select(
        "user_id", F.col("kind").cast("bigint").alias("kind"), "batch_id"
    )


@query(
    "frontier_timelines_whole",
    """, near AS (SELECT p.user_id FROM posted p JOIN linked l ON l.post_id = p.post_id),
        kinds AS (
            SELECT user_id, 1 AS kind FROM near
            UNION ALL SELECT w.user_id, 1 FROM retweeted w JOIN linked l ON l.post_id = w.post_id
            UNION ALL SELECT r.user_id, 2 FROM replies r JOIN linked l ON l.post_id = r.post_id
            UNION ALL SELECT f.src, 3 FROM follows f JOIN near n ON n.user_id = f.tgt
            UNION ALL SELECT f.tgt, 3 FROM follows f JOIN near n ON n.user_id = f.src),
        todo AS (SELECT user_id, min(kind) AS kind FROM kinds WHERE user_id NOT IN (SELECT user_id FROM posted) GROUP BY user_id)
        SELECT user_id, CAST(kind AS BIGINT) AS kind,
               CAST((row_number() OVER (PARTITION BY kind ORDER BY user_id) - 1) // 10 AS BIGINT) AS batch_id
        FROM todo""",
    ("linked", "posted", "retweeted", "replies", "follows"),
)
def _(v: Views):
    posted = v.posted.select("user_id", "post_id")
    return frontier.timelines(v.linked.select("post_id"), posted, v.retweeted, v.replies, v.follows, 10).select(
        "user_id", F.col("kind").cast("bigint").alias("kind"), "batch_id"
    )


def _frontier_oracles():
    from claimweave.plans.registry import ORACLES
    from claimweave.plans.views import with_views

    ORACLES["frontier_follows"] = _strong_sql(
        """SELECT DISTINCT p.user_id FROM strong s JOIN posted p ON p.post_id = s.post_id
           WHERE NOT EXISTS (SELECT 1 FROM posted a JOIN follows f ON f.src = a.user_id OR f.tgt = a.user_id WHERE a.post_id = s.post_id)""",
        "posted", "follows",
    )
    ORACLES["frontier_replies"] = _strong_sql(
        """SELECT post_id, quote_count + reply_count AS num_replies FROM posts
           WHERE post_id IN (SELECT post_id FROM strong) AND (quote_count > 0 OR reply_count > 0)
             AND post_id NOT IN (SELECT post_id FROM replies)""",
        "posts", "replies",
    )
    ORACLES["frontier_retweets"] = _strong_sql(
        """SELECT post_id, retweet_count FROM posts
           WHERE post_id IN (SELECT post_id FROM strong) AND retweet_count > 0
             AND post_id NOT IN (SELECT post_id FROM retweeted)""",
        "posts", "retweeted",
    )
    ORACLES["frontier_timelines"] = with_views(
        """, near AS (SELECT a.user_id FROM posted a JOIN linked l ON l.post_id = a.post_id),
        known AS (SELECT src, tgt FROM follows UNION ALL SELECT event_id + 1000000000, user_id FROM events WHERE event_type = 'click'),
        kinds AS (
            SELECT user_id, 1 AS kind FROM near
            UNION ALL SELECT w.user_id, 1 FROM retweeted w JOIN linked l ON l.post_id = w.post_id
            UNION ALL SELECT r.user_id, 2 FROM replies r JOIN linked l ON l.post_id = r.post_id
            UNION ALL SELECT f.src, 3 FROM known f JOIN near n ON n.user_id = f.tgt
            UNION ALL SELECT f.tgt, 3 FROM known f JOIN near n ON n.user_id = f.src),
        todo AS (SELECT user_id, min(kind) AS kind FROM kinds WHERE user_id NOT IN (SELECT user_id FROM posted) GROUP BY user_id)
        SELECT user_id, CAST(kind AS BIGINT) AS kind,
               CAST((row_number() OVER (PARTITION BY kind ORDER BY user_id) - 1) // 10 AS BIGINT) AS batch_id
        FROM todo""",
        "linked", "posted", "retweeted", "replies", "follows",
    )


_frontier_oracles()

# Upserts, counts, batches, plain SQL.


@query(
    "key_audit",
    """, stacked AS (
        SELECT 'post' AS key, CAST(post_id AS VARCHAR) AS value FROM posts UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR) FROM users
        UNION ALL SELECT 'user_name', user_name FROM users UNION ALL SELECT 'claim', CAST(claim_id AS VARCHAR) FROM claims
        UNION ALL SELECT 'url', url FROM pages UNION ALL SELECT 'tagged post', CAST(post_id AS VARCHAR) FROM has_hashtag
        UNION ALL SELECT 'author', CAST(user_id AS VARCHAR) FROM posted UNION ALL SELECT 'event', CAST(user_id AS VARCHAR) FROM events),
    n AS (SELECT key, value, count(*) AS n FROM stacked WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
    SELECT key, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows, min(value) AS example FROM n GROUP BY key""",
    ("posts", "users", "claims", "has_hashtag", "posted"),
)
def _(v: Views):
    named = {
        "post": (v.posts, "post_id"), "user_id": (v.users, "user_id"), "user_name": (v.users, "user_name"), "claim": (v.claims, "claim_id"),
        "url": (v.table("pages"), "url"), "tagged post": (v.has_hashtag, "post_id"), "author": (v.posted, "user_id"), "event": (v.table("events"), "user_id"),
    }
    return keyed.broken_keys(v.spark, {k: df.select(c) for k, (df, c) in named.items()})


@query(
    "upsert_graph_edges",
    """SELECT src, tgt, 'old' AS state FROM follows
       UNION ALL
       SELECT DISTINCT user_id, post_id, 'new' FROM retweeted
       WHERE post_id IN (SELECT user_id FROM users) AND (user_id, post_id) NOT IN (SELECT (src, tgt) FROM follows)""",
    ("follows", "retweeted", "users"),
)
def _(v: Views):
    pages = v.retweeted.select(F.col("user_id").alias("src"), F.col("post_id").alias("tgt"), F.col("post_id").alias("anchor"))
    _, fresh = frontier.insert_follows(v.users.select("user_id"), v.follows, pages)
    return v.follows.select("src", "tgt", F.lit("old").alias("state")).unionByName(
        fresh.select("src", "tgt", F.lit("new").alias("state"))
    )


@query(
    "upsert_graph_nodes",
    """SELECT DISTINCT event_id + 1000000000 AS user_id FROM events WHERE user_id IN (SELECT post_id FROM posts) AND event_type = 'click'
       UNION SELECT user_id FROM replies WHERE user_id NOT IN (SELECT user_id FROM users)""",
    ("replies", "users", "posts"),
)
def _(v: Views):
    """Whole tables; clicks stand for replies of accounts that nobody knows yet."""
    clicks = v.table("events").filter("event_type = 'click'").join(v.posts.select(F.col("post_id").alias("user_id")), "user_id", "left_semi")
    unknown = clicks.select("event_id", (F.col("event_id") + 1_000_000_000).alias("user_id"), F.col("user_id").alias("post_id"))
    pages = v.replies.select("reply_id", "user_id", "post_id").union(unknown)
    users, _ = frontier.insert_replies(v.posts, v.users, v.replies, pages)
    return users.select("user_id")


@query(
    "upsert_graph_replies",
    """, pages AS (SELECT reply_id, user_id, post_id FROM replies UNION SELECT post_id, user_id, post_id FROM retweeted)
       SELECT DISTINCT 'user' AS kind, CAST(NULL AS BIGINT) AS reply_id, user_id, CAST(NULL AS BIGINT) AS post_id
       FROM pages WHERE user_id NOT IN (SELECT user_id FROM users)
       UNION ALL
       SELECT 'reply', reply_id, user_id, post_id FROM pages WHERE post_id IN (SELECT post_id FROM posts) AND NOT EXISTS (
           SELECT 1 FROM replies r WHERE r.reply_id = pages.reply_id AND r.user_id = pages.user_id AND r.post_id = pages.post_id)""",
    ("replies", "retweeted", "users", "posts"),
)
def _(v: Views):
    pages = v.replies.select("reply_id", "user_id", "post_id").union(v.retweeted.select("post_id", "user_id", "post_id"))
    users, edges = frontier.insert_replies(v.posts, v.users, v.replies, pages)
    nothing = F.lit(None).cast("bigint")
    return users.select(F.lit("user").alias("kind"), nothing.alias("reply_id"), "user_id", nothing.alias("post_id")).unionByName(
        edges.select(F.lit("reply").alias("kind"), "reply_id", "user_id", "post_id")
    )


@query(
    "remaining_work",
    """SELECT count(*) AS total, count(*) FILTER (post_id IN (SELECT post_id FROM linked)) AS done,
              count(*) FILTER (post_id NOT IN (SELECT post_id FROM linked)) AS remaining FROM posts_vec""",
    ("posts_vec", "linked"),
)
def _(v: Views):
    flagged = v.posts_vec.select("post_id").join(v.linked.select("post_id", "relevance"), "post_id", "left")
    return keyed.progress(flagged, F.col("relevance").isNotNull())


@query(
    "batch_ids",
    "SELECT o_orderkey AS post_id, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 15 AS BIGINT) AS batch_id FROM orders",
)
def _(v: Views):
    return keyed.batch_ids(v.posts.select("post_id"), "post_id", 15)


@query(
    "undirected_follows",
    "SELECT src, tgt FROM follows UNION SELECT tgt, src FROM follows",
    ("follows",),
)
def _(v: Views):
    return keyed.undirected(v.follows)


@query("next_page_cursor", "SELECT strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS next_to_date FROM posts", ("posts",))
def _(v: Views):
    return keyed.page_cursor(v.posts).select(stamp("next_to_date"))


@query(
    "distinct_reviewers",
    "SELECT DISTINCT reviewer FROM has_reviewed",
    ("has_reviewed",),
)
def _(v: Views):
    return v.has_reviewed.select("reviewer").distinct()


@query(
    "sql_over_graph",
    """SELECT u.user_id, u.user_name, count(*) AS n_posts FROM users u JOIN posted p ON p.user_id = u.user_id
       WHERE u.followers_count >= 2000 GROUP BY ALL""",
    ("users", "posted"),
)
def _(v: Views):
    return graph_sql.query(
        v.spark,
        """SELECT u.user_id, u.user_name, count(*) AS n_posts FROM {users} u JOIN {posted} p ON p.user_id = u.user_id
           WHERE u.followers_count >= :least GROUP BY u.user_id, u.user_name""",
        {"users": v.users, "posted": v.posted},
        least=2000,
    )
