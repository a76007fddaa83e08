"""Clusters with most related users, and the mention graph around their spreaders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.claims import LINK_THRESHOLD
from claimweave.operators.linking import Scored, Via, expand_via
from claimweave.session import cut_lineage

_WIDE = "decimal(38,0)"


def _degree(edges: DataFrame, key: str, name: str) -> DataFrame:
    return edges.groupBy(F.col(key).alias("user_id")).agg(F.count(F.lit(1)).alias(name))


def cluster_scores(
    claims: DataFrame,
    reviews: DataFrame,
    links: DataFrame | Scored,
    posted: DataFrame,
    post_mentions: DataFrame,
    user_mentions: DataFrame,
    threshold: float = LINK_THRESHOLD,
    via: Via | None = None,
) -> DataFrame:
    """``(cluster, num_users, distinct_users)``.

    ``num_users`` adds five counts over a chain of optional matches: the poster, the users
    the post mentions, the users the poster mentions, the users who mention the poster, and
    the (user, post) paths that mention the poster. Every step multiplies the rows of the
    steps before it, so the number is a count of combinations. It follows from the degrees
    alone: each count is the product of all degrees, with an empty step counted as one row
    except where the step itself is being counted. ``distinct_users`` counts the posters.

    Products of five counts outgrow 64 bits, so ``num_users`` is DECIMAL(38, 0).

    ``links`` may list a post and claim twice (direct and through an article). A claim that a post has through
    articles of ``via`` counts once beside that, through however many of them.
    ``post_mentions(post_id, user_id)``, ``user_mentions(src, tgt)``.
    """
    base = (
        reviews.filter(F.col("predicted_verdict") == "misinformation")
        .groupBy("claim_id")
        .agg(F.count(F.lit(1)).alias("n_reviews"))
        .join(claims.filter("cluster >= 0").select("claim_id", "cluster"), "claim_id")
    )
    def counted(found: DataFrame) -> DataFrame:
        return found.join(base, "claim_id").groupBy("cluster", "post_id").agg(F.sum("n_reviews").alias("n_rows"))

    if isinstance(links, Scored):  # counted where they are scored, so that links are not moved
        per_post = links.above(threshold).sums(base, "cluster", "n_reviews").select("cluster", "post_id", F.col("n_reviews").alias("n_rows"))
    else:
        per_post = counted(links.filter(F.col("score") > threshold).select("post_id", "claim_id"))
    if via is not None:
        wanted = via.article_links.filter(F.col("score") > threshold).join(base.select("claim_id"), "claim_id", "left_semi")
        strong = Via(via.post_article, cut_lineage(wanted.select("article_id", "claim_id", "score")))
        per_post = per_post.unionByName(counted(expand_via(strong).select("post_id", "claim_id").distinct()))
        per_post = per_post.groupBy("cluster", "post_id").agg(F.sum("n_rows").alias("n_rows"))
    mentioned = post_mentions.groupBy("post_id").agg(F.count(F.lit(1)).alias("m2"))
    paths = (
        post_mentions.withColumnRenamed("user_id", "target")
        .join(posted.groupBy("post_id").agg(F.count(F.lit(1)).alias("n_posters")), "post_id")
        .groupBy(F.col("target").alias("user_id"))
        .agg(F.sum("n_posters").alias("d5"))
    )
    wide = (
        per_post.join(mentioned, "post_id", "left")
        .join(posted, "post_id", "left")
        .join(_degree(user_mentions, "src", "d3"), "user_id", "left")
        .join(_degree(user_mentions, "tgt", "d4"), "user_id", "left")
        .join(paths, "user_id", "left")
        .fillna(0, ["m2", "d3", "d4", "d5"])
    )
    def times(x, y):
        return (x * y).cast(_WIDE)

    degrees = [F.col(x).cast(_WIDE) for x in ("m2", "d3", "d4", "d5")]
    at_least_one = [F.greatest(x, F.lit(1).cast(_WIDE)) for x in degrees]
    combined = reduce(times, at_least_one)
    for i, x in enumerate(degrees):
        combined = combined + reduce(times, [*at_least_one[:i], x, *at_least_one[i + 1 :]])
    rows = F.when(F.col("user_id").isNotNull(), combined).otherwise(degrees[0])
    return wide.groupBy("cluster").agg(
        F.sum(times(F.col("n_rows").cast(_WIDE), rows.cast(_WIDE))).cast(_WIDE).alias("num_users"), F.countDistinct("user_id").alias("distinct_users")
    )


def top_clusters(scores: DataFrame, n: int = 10) -> DataFrame:
    return scores.orderBy(F.desc("num_users"), "cluster").limit(n)


def spreaders(
    clusters: DataFrame,
    claims: DataFrame,
    labels: DataFrame,
    has_label: DataFrame,
    links: DataFrame | Scored,
    posted: DataFrame,
    threshold: float = LINK_THRESHOLD,
    via: Via | None = None,
) -> DataFrame:
    """``(cluster, user_id)``: users who posted a linked post of a claim of the cluster
    that has a misinformation label; ``via`` are links through articles."""
    false_claims = has_label.join(
        labels.filter(F.col("verdict") == "misinformation"), ["label_id", "size"], "left_semi"
    ).select("claim_id")
    wanted = (
        claims.join(clusters.select("cluster"), "cluster", "left_semi")
        .join(false_claims, "claim_id", "left_semi")
        .select("claim_id", "cluster")
    )
    def strong(rows: DataFrame, of: str) -> DataFrame:
        return rows.filter(F.col("score") > threshold).join(wanted, "claim_id").select("cluster", of).distinct()

    if isinstance(links, Scored):
        once = wanted.distinct().withColumn("_n", F.lit(1))
        posts = links.above(threshold).sums(once, "cluster", "_n").select("cluster", "post_id")
    else:
        posts = strong(links, "post_id")
    if via is not None:
        reached = strong(via.article_links, "article_id").join(via.post_article, "article_id")
        posts = posts.unionByName(reached.select("cluster", "post_id")).distinct()
    return posts.join(posted, "post_id").select("cluster", "user_id").distinct()


def _mentions_out(users: DataFrame, posted: DataFrame, post_mentions: DataFrame, user_mentions: DataFrame) -> DataFrame:
    """Mentions by ``users(cluster, user_id)`` who posted, directly or in their posts."""
    posters = users.join(posted.select("user_id"), "user_id", "left_semi")
    direct = posters.join(user_mentions.withColumnRenamed("src", "user_id"), "user_id").select(
        "cluster", F.col("user_id").alias("user1_id"), F.col("tgt").alias("user2_id")
    )
    by_post = (
        posters.join(posted, "user_id")
        .join(post_mentions.withColumnRenamed("user_id", "user2_id"), "post_id")
        .select("cluster", F.col("user_id").alias("user1_id"), "user2_id")
    )
    return direct.union(by_post)


def _mentions_in(users: DataFrame, posted: DataFrame, post_mentions: DataFrame, user_mentions: DataFrame) -> DataFrame:
    direct = users.join(user_mentions.withColumnRenamed("tgt", "user_id"), "user_id").select(
        "cluster", F.col("src").alias("user1_id"), F.col("user_id").alias("user2_id")
    )
    by_post = (
        users.join(post_mentions, "user_id")
        .select("cluster", F.col("user_id").alias("user2_id"), "post_id")
        .join(posted.withColumnRenamed("user_id", "user1_id"), "post_id")
        .select("cluster", "user1_id", "user2_id")
    )
    return direct.union(by_post)


def ego_edges(users: DataFrame, posted: DataFrame, post_mentions: DataFrame, user_mentions: DataFrame) -> DataFrame:
    """Distinct ``(cluster, user1_id, user2_id)`` mention edges out of and into the users."""
    parts = (users, posted, post_mentions, user_mentions)
    return _mentions_out(*parts).union(_mentions_in(*parts)).distinct()


def touched_users(edges: DataFrame) -> DataFrame:
    keep = [c for c in edges.columns if c not in ("user1_id", "user2_id")]
    ends = [edges.select(*keep, F.col(c).alias("user_id")) for c in ("user1_id", "user2_id")]
    return ends[0].union(ends[1]).distinct()


def ego_features(edges: DataFrame, users: DataFrame) -> DataFrame:
    """Three counts for every known user on an edge."""
    return touched_users(edges).join(
        users.select("user_id", "following_count", "followers_count", "tweet_count"), "user_id"
    )


def unrelated_edges(
    text_posts: DataFrame, posted: DataFrame, post_mentions: DataFrame, user_mentions: DataFrame, related: DataFrame
) -> DataFrame:
    """Mention edges of users with a text-bearing post, neither end in ``related(user_id)``.

    The users of all top clusters count as related (quirk Q13). Both ends are checked
    before the edges are joined, so related users never enter the wide join.
    """
    known = related.select("user_id").distinct()
    posted = posted.join(text_posts.select("post_id"), "post_id", "left_semi").join(known, "user_id", "left_anti")
    post_mentions = post_mentions.join(known, "user_id", "left_anti")
    user_mentions = user_mentions.join(known.withColumnRenamed("user_id", "tgt"), "tgt", "left_anti")
    posters = posted.select("user_id").distinct().withColumn("cluster", F.lit(None).cast("bigint"))
    return _mentions_out(posters, posted, post_mentions, user_mentions).drop("cluster").distinct()
