"""What is still to be fetched around the linked posts, and how fetched pages go in.

Here ``linked`` needs no label, except in :func:`timelines`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.claims import LINK_THRESHOLD
from claimweave.operators.keyed import batch_ids, insert_absent, undirected
from claimweave.operators.linking import Via, posts_of
from claimweave.session import cut_lineage


def posts_above(links: DataFrame, threshold: float = LINK_THRESHOLD, via: Via | None = None) -> DataFrame:
    """``(post_id)`` with a link above the threshold, in ``links`` or through an article of ``via``."""
    strong = None if via is None else Via(via.post_article, via.article_links.filter(F.col("score") > threshold))
    return posts_of(links.filter(F.col("score") > threshold), strong).select("post_id")


def follow_frontier(linked: DataFrame, posted: DataFrame, follows: DataFrame) -> DataFrame:
    """Authors to fetch: of linked posts none of whose authors has a FOLLOWS edge."""
    touched = follows.select(F.col("src").alias("user_id")).union(follows.select("tgt"))
    near = posted.join(linked, "post_id", "left_semi")
    known = near.join(touched, "user_id", "left_semi").select("post_id")
    return near.join(known, "post_id", "left_anti").select("user_id").distinct()


def reply_frontier(linked: DataFrame, posts: DataFrame, replies: DataFrame) -> DataFrame:
    """Linked posts that report replies or quotes but have none yet, busiest first. A post
    with one of the two counts missing has no sum and comes last."""
    todo = (
        posts.join(linked, "post_id", "left_semi")
        .filter("quote_count > 0 OR reply_count > 0")
        .join(replies.select("post_id"), "post_id", "left_anti")
    )
    busy = F.col("quote_count") + F.col("reply_count")
    return todo.select("post_id", busy.alias("num_replies")).orderBy(F.desc_nulls_last("num_replies"), "post_id")


def retweet_frontier(linked: DataFrame, posts: DataFrame, retweeted: DataFrame) -> DataFrame:
    """Linked posts that report retweets but have none yet, busiest first."""
    todo = (
        posts.join(linked, "post_id", "left_semi")
        .filter("retweet_count > 0")
        .join(retweeted.select("post_id"), "post_id", "left_anti")
    )
    return todo.select("post_id", "retweet_count").orderBy(F.desc("retweet_count"), "post_id")


def timelines(
    linked: DataFrame, posted: DataFrame, retweeted: DataFrame, replies: DataFrame, follows: DataFrame, size: int = 100
) -> DataFrame:
    """``(user_id, kind, batch_id)``: users near a linked post without a post of their own.

    Kind 1 retweeted it (its posters have a post), kind 2 replied to or quoted it, kind 3
    follows or is followed by its author. Kinds are visited in turn, ``size`` users at a
    time: order by ``(batch_id, kind)``. A user of several kinds is visited once, in the
    lowest kind.
    """
    near = posted.join(linked, "post_id", "left_semi").select("user_id")
    kinds = [
        near.union(retweeted.join(linked, "post_id", "left_semi").select("user_id")),
        replies.join(linked, "post_id", "left_semi").select("user_id"),
        undirected(follows)
        .join(near.withColumnRenamed("user_id", "tgt"), "tgt", "left_semi")
        .select(F.col("src").alias("user_id")),
    ]
    users = None
    for number, df in enumerate(kinds, 1):
        df = df.select("user_id", F.lit(number).alias("kind"))
        users = df if users is None else users.union(df)
    todo = (
        users.groupBy("user_id").agg(F.min("kind").alias("kind")).join(posted.select("user_id"), "user_id", "left_anti")
    )
    return batch_ids(cut_lineage(todo), "user_id", size, ["kind"])


def insert_follows(users: DataFrame, follows: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New ``(users, follows)`` rows from landed follower or followee pages
    ``pages(src, tgt, anchor)``: the anchor user must be known, the other end is created
    when it is missing."""
    known = users.select("user_id")
    rows = pages.join(known.withColumnRenamed("user_id", "anchor"), "anchor", "left_semi").dropna(subset=["src", "tgt"])
    ends = rows.select(F.col("src").alias("user_id")).union(rows.select("tgt")).distinct()
    return insert_absent(users, ends, ["user_id"]), insert_absent(follows, rows.select("src", "tgt").distinct(), ["src", "tgt"])


def insert_retweets(posts: DataFrame, users: DataFrame, retweeted: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New ``(users, retweeted)`` rows from ``pages(user_id, post_id)`` of known posts."""
    rows = pages.dropna().join(posts.select("post_id"), "post_id", "left_semi").select("user_id", "post_id").distinct()
    return (
        insert_absent(users, rows.select("user_id").distinct(), ["user_id"]),
        insert_absent(retweeted, rows, ["user_id", "post_id"]),
    )


def insert_replies(posts: DataFrame, users: DataFrame, replies: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New ``(users, replies)`` rows from ``pages(reply_id, user_id, post_id)``; serves
    quotes too. Users and replies of unknown posts are still created, edges are not."""
    rows = pages.dropna().select("reply_id", "user_id", "post_id").distinct()
    edges = rows.join(posts.select("post_id"), "post_id", "left_semi").select("reply_id", "user_id", "post_id")
    return (
        insert_absent(users, rows.select("user_id").distinct(), ["user_id"]),
        insert_absent(replies, edges, ["reply_id", "user_id", "post_id"]),
    )


def insert_timelines(posts: DataFrame, users: DataFrame, posted: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New ``(posts, posted)`` rows from ``pages(post_id, user_id)``: every post is created,
    the edge needs a known user."""
    rows = pages.dropna().select("post_id", "user_id").distinct()
    edges = rows.join(users.select("user_id"), "user_id", "left_semi").select("user_id", "post_id")
    return (
        insert_absent(posts, rows.select("post_id").distinct(), ["post_id"]),
        insert_absent(posted, edges, ["user_id", "post_id"]),
    )
