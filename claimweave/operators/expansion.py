"""Neighbourhoods of the linked posts, each with the best relevance it can inherit.

All edge tables are distinct and named by their ends: ``posted(user_id, post_id)``,
``retweeted(user_id, post_id)``, ``follows(src, tgt)``, ``has_hashtag(post_id, name)``,
``replies(reply_id, user_id, post_id)`` for replies and quotes alike.
``linked(post_id, relevance)`` comes from :func:`linking.linked_posts`.

A two-hop pattern goes through a hub (a hashtag or a user). Forming the pairs of a hub is
quadratic in its size, and only the best relevance per result is wanted, so each hub is
first reduced to its two best linked posts and then joined once with its other side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.operators.keyed import undirected
from claimweave.operators.linking import Scored


def spread(out: DataFrame, free: DataFrame | None = None, bound: DataFrame | None = None) -> DataFrame:
    """``(post_id, relevance)`` reached over hubs.

    ``out(hub, post_id)`` are the edges from hubs to result posts. ``free(hub, relevance)``
    passes to every result of the hub. ``bound(hub, post_id, relevance)`` came in over an
    edge of the same kind, and a pattern may not use one edge twice, so it passes to every
    other post of the hub but not back to itself.
    """
    hubs = None
    if bound is not None:
        # Spark keeps two rows per hub and task before the shuffle (window group limit).
        w = Window.partitionBy("hub").orderBy(F.desc("relevance"), "post_id")
        top = bound.withColumn("_n", F.row_number().over(w)).filter("_n <= 2")
        hubs = top.groupBy("hub").agg(
            F.max(F.when(F.col("_n") == 1, F.col("relevance"))).alias("best"),
            F.max(F.when(F.col("_n") == 1, F.col("post_id"))).alias("best_post"),
            F.max(F.when(F.col("_n") == 2, F.col("relevance"))).alias("second"),
        )
    if free is not None:
        reached = free.groupBy("hub").agg(F.max("relevance").alias("any"))
        hubs = reached if hubs is None else hubs.join(reached, "hub", "full")
    inherited = []
    if bound is not None:
        inherited.append(F.when(F.col("post_id") != F.col("best_post"), F.col("best")).otherwise(F.col("second")))
    if free is not None:
        inherited.append(F.col("any"))
    relevance = inherited[0] if len(inherited) == 1 else F.greatest(*inherited)
    return (
        out.join(hubs, "hub")
        .select("post_id", relevance.alias("relevance"))
        .filter("relevance IS NOT NULL")
        .groupBy("post_id")
        .agg(F.max("relevance").alias("relevance"))
    )


def _out(posted: DataFrame) -> DataFrame:
    return posted.select(F.col("user_id").alias("hub"), "post_id")


def author_relevance(linked: DataFrame, posted: DataFrame) -> DataFrame:
    """``(user_id, relevance)``: the best linked post of each author."""
    return linked.join(posted, "post_id").groupBy("user_id").agg(F.max("relevance").alias("relevance"))


def posts_by_hashtag(linked: DataFrame, has_hashtag: DataFrame) -> DataFrame:
    """Posts that share a hashtag with a linked post."""
    tags = has_hashtag.select(F.col("name").alias("hub"), "post_id")
    return spread(tags, bound=tags.join(linked, "post_id"))


def posts_by_coposter(linked: DataFrame, posted: DataFrame, retweeted: DataFrame) -> DataFrame:
    """Posts of users who posted or retweeted a linked post. A linked post comes back only
    when its own author also retweeted it."""
    out = _out(posted)
    free = _out(retweeted).join(linked, "post_id").select("hub", "relevance")
    return spread(out, free=free, bound=out.join(linked, "post_id"))


def _by_follow(linked: DataFrame, posted: DataFrame, steps: DataFrame) -> DataFrame:
    """``steps(user_id, hub)`` leads from an author to the users whose posts are wanted."""
    free = (
        author_relevance(linked, posted)
        .join(steps.filter("user_id <> hub"), "user_id")
        .select("hub", "relevance")
    )
    own = steps.filter("user_id = hub").select("hub")
    out = _out(posted)
    bound = out.join(own, "hub", "left_semi").join(linked, "post_id")
    return spread(out, free=free, bound=bound)


def posts_by_followee(linked: DataFrame, posted: DataFrame, follows: DataFrame) -> DataFrame:
    """Posts of users whom the author of a linked post follows."""
    return _by_follow(linked, posted, follows.select(F.col("src").alias("user_id"), F.col("tgt").alias("hub")))


def posts_by_follower(linked: DataFrame, posted: DataFrame, follows: DataFrame) -> DataFrame:
    """Posts of users who follow the author of a linked post."""
    return _by_follow(linked, posted, follows.select(F.col("tgt").alias("user_id"), F.col("src").alias("hub")))


def posts_by_replier(linked: DataFrame, posted: DataFrame, replies: DataFrame) -> DataFrame:
    """Posts of users who replied to or quoted a linked post."""
    free = replies.join(linked, "post_id").select(F.col("user_id").alias("hub"), "relevance")
    return spread(_out(posted), free=free)


def kept_replies(linked: DataFrame, replies: DataFrame, retweeted: DataFrame) -> DataFrame:
    """Replies (or quotes) of linked posts, without those of users who also retweeted the
    post: ``(reply_id, post_id, relevance)``, distinct."""
    near = replies.join(linked, "post_id").dropDuplicates(["reply_id", "user_id", "post_id"])
    # A reply is out when any of its authors retweeted the post.
    out = near.join(retweeted, ["user_id", "post_id"], "left_semi").select("reply_id", "post_id")
    return (
        near.join(out, ["reply_id", "post_id"], "left_anti").select("reply_id", "post_id", "relevance").distinct()
    )


def reply_nodes(linked: DataFrame, replies: DataFrame, retweeted: DataFrame) -> DataFrame:
    kept = kept_replies(linked, replies, retweeted)
    return kept.groupBy(F.col("reply_id").alias("post_id")).agg(F.max("relevance").alias("relevance"))


def retweeters(linked: DataFrame, retweeted: DataFrame) -> DataFrame:
    return retweeted.join(linked, "post_id").select("user_id", "relevance")


def follow_neighbours(linked: DataFrame, posted: DataFrame, follows: DataFrame) -> DataFrame:
    """Users next to the author of a linked post, whoever follows whom."""
    return (
        undirected(follows)
        .join(author_relevance(linked, posted).withColumnRenamed("user_id", "tgt"), "tgt")
        .select(F.col("src").alias("user_id"), "relevance")
    )


def best_per(key: list[str], *tables: DataFrame) -> DataFrame:
    """Union of several patterns, reduced to the best relevance per key."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(*key).agg(F.max("relevance").alias("relevance"))


def release_posts(linked, posted, retweeted, follows, replies, has_hashtag) -> DataFrame:
    return best_per(
        ["post_id"],
        posts_by_hashtag(linked, has_hashtag),
        posts_by_coposter(linked, posted, retweeted),
        posts_by_followee(linked, posted, follows),
        posts_by_follower(linked, posted, follows),
        posts_by_replier(linked, posted, replies),
    )


def release_users(linked, posted, retweeted, follows) -> DataFrame:
    return best_per(["user_id"], retweeters(linked, retweeted), follow_neighbours(linked, posted, follows))


def article_claims(article_links: DataFrame | Scored, has_label: DataFrame, threshold: float) -> DataFrame:
    """``(src, tgt, relevance)``: articles that discuss a labelled claim."""
    return _discusses(article_links, "article_id", has_label, threshold)


def post_claims(links, has_label: DataFrame, threshold: float) -> DataFrame:
    """``(src, tgt, relevance)``: posts that discuss a labelled claim."""
    return _discusses(links, "post_id", has_label, threshold)


def _discusses(links, end: str, has_label: DataFrame, threshold: float) -> DataFrame:
    """``links`` is a table or something that is scored when asked, of which only labelled claims are."""
    if not isinstance(links, DataFrame):
        found = links.above(threshold).among(claims=has_label.select("claim_id").distinct()).pairs()
        return found.select(F.col(end).alias("src"), F.col("claim_id").alias("tgt"), F.col("score").alias("relevance"))
    links = links.withColumnRenamed(end, "src")
    return (
        links.filter(F.col("score") > threshold)
        .join(has_label.select("claim_id"), "claim_id", "left_semi")
        .groupBy("src", F.col("claim_id").alias("tgt"))
        .agg(F.max("score").alias("relevance"))
    )


def release_articles(articles: DataFrame, article_links: DataFrame | Scored, has_label: DataFrame, threshold: float) -> DataFrame:
    """``(id, url, relevance)`` of the articles that discuss a labelled claim."""
    if isinstance(article_links, Scored):
        best = article_links.above(threshold).among(claims=has_label.select("claim_id").distinct()).best("article_id").toDF("src", "relevance")
    else:
        best = article_claims(article_links, has_label, threshold).groupBy("src").agg(F.max("relevance").alias("relevance"))
    return best.join(articles.select(F.col("article_id").alias("src"), "url"), "src").select(
        F.col("src").alias("id"), "url", "relevance"
    )


def rel_follows(linked: DataFrame, posted: DataFrame, follows: DataFrame) -> DataFrame:
    """FOLLOWS edges that touch the author of a linked post on either end."""
    authors = author_relevance(linked, posted)
    sides = [
        follows.join(authors.withColumnRenamed("user_id", end), end).select("src", "tgt", "relevance")
        for end in ("tgt", "src")
    ]
    return best_per(["src", "tgt"], *sides)


def rel_retweeted(linked: DataFrame, retweeted: DataFrame) -> DataFrame:
    hits = retweeted.join(linked, "post_id")
    return best_per(["src", "tgt"], hits.select(F.col("user_id").alias("src"), F.col("post_id").alias("tgt"), "relevance"))


def rel_replies(linked: DataFrame, replies: DataFrame, retweeted: DataFrame) -> DataFrame:
    """``(src, tgt, relevance)``; give the reply table or the quote table alone."""
    kept = kept_replies(linked, replies, retweeted)
    return best_per(["src", "tgt"], kept.select(F.col("reply_id").alias("src"), F.col("post_id").alias("tgt"), "relevance"))


def claim_release(claims: DataFrame, reviews: DataFrame, labels: DataFrame, has_label: DataFrame, sizes=("small", "medium", "large")) -> DataFrame:
    """One row per claim that has a label and a misinformation / factual review: its own
    columns, one label, its reviewers and nine masks (null masks become false)."""
    from claimweave.functions.claims import is_ruled

    reviewers = (
        reviews.filter(is_ruled(F.col("predicted_verdict")))
        .groupBy("claim_id")
        .agg(F.array_sort(F.collect_set("reviewer")).alias("reviewers"))
    )
    masks = [
        F.coalesce(F.bool_or(F.when(F.col("size") == s, F.col(f"{p}_mask"))), F.lit(False)).alias(f"{s}_{p}_mask")
        for s in sizes
        for p in ("train", "val", "test")
    ]
    labelled = (
        has_label.join(labels, ["label_id", "size"])
        .groupBy("claim_id")
        .agg(F.min_by("verdict", F.struct("label_id", "size")).alias("label"), *masks)
    )
    return claims.join(labelled, "claim_id").join(reviewers, "claim_id")
