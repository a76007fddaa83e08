"""Row filters over landed posts, URLs, claims and reviews."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import lists
from claimweave.functions.numbers import to_integer, whole

# URLs that are not articles, as full-string patterns.
NOT_ARTICLE = [
    ".*youtu[.]*be.*", ".*vimeo.*", ".*spotify.*", ".*twitter.*", ".*instagram.*", ".*facebook.*", ".*tiktok.*",
    ".*gab[.]com.*", "https://t[.]me.*", ".*imgur.*", ".*/photo/.*",
    ".*mp4", ".*mov", ".*jpg", ".*jpeg", ".*bmp", ".*png", ".*gif", ".*pdf",
]
# Fixed value: no post is older than this.
FIRST_DAY = dt.datetime(2006, 3, 21)

RETWEETS = "`public_metrics.retweet_count`"


def popular_posts(tweets: DataFrame, min_retweets: int = 5) -> DataFrame:
    """Posts whose retweet count is a whole number of at least ``min_retweets``."""
    return tweets.filter(whole(F.col(RETWEETS)) >= min_retweets)


def referenced(dfs: dict[str, DataFrame], min_retweets: int = 5) -> dict[str, DataFrame]:
    """Keep popular posts, and only what they refer to: their authors and mentioned users,
    places, media, polls, and the replies in their conversations.

    Every reference set is reduced to distinct keys before its semi join.
    """
    out = dict(dfs)
    posts = popular_posts(dfs["tweets"], min_retweets)
    out["tweets"] = posts

    def keep(table: str, key: str, refs: DataFrame, number: bool = False) -> None:
        as_key = to_integer if number else (lambda c: c)
        refs = refs.toDF("_ref").select(as_key(F.col("_ref")).alias("_ref")).dropna().distinct()
        out[table] = dfs[table].join(refs, as_key(F.col(f"`{key}`")) == F.col("_ref"), "left_semi")

    mentioned = posts.select(F.explode(lists.field(F.col("`entities.mentions`"), "id")))
    keep("authors", "id", posts.select("author_id").union(mentioned), number=True)
    keep("places", "id", posts.select("`geo.place_id`"))
    keep("media", "media_key", posts.select(F.explode(lists.strings(F.col("`attachments.media_keys`")))))
    keep("polls", "id", posts.select(F.explode(lists.strings(F.col("`attachments.poll_ids`")))))
    keep("replies", "conversation_id", posts.select("conversation_id"), number=True)
    return out


def maybe_article(url: Column) -> Column:
    return ~url.rlike("^(?:" + "|".join(NOT_ARTICLE) + ")$")


def with_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.dropna(subset=list(keys))


def worklist(df: DataFrame, needs: list[str], lacks: str, flag: str | None = None) -> DataFrame:
    """Rows that have their inputs, lack the output and are not flagged as hopeless."""
    out = df.dropna(subset=needs).filter(F.col(lacks).isNull())
    return out if flag is None else out.filter(~F.coalesce(F.col(flag), F.lit(False)))


def clamp_window(from_date: dt.datetime | None, to_date: dt.datetime | None, now: dt.datetime):
    """Both bounds moved into ``[first day, now]``; ``None`` when nothing is left. A
    missing start becomes the first day, a missing end stays open."""
    start = min(max(from_date or FIRST_DAY, FIRST_DAY), now)
    if to_date is None:
        return start, None
    end = min(max(to_date, FIRST_DAY), now)
    return None if start >= end else (start, end)


def search_posts(
    posts: DataFrame,
    keyword: str | None = None,
    max_results: int | None = None,
    from_date: dt.datetime | None = None,
    to_date: dt.datetime | None = None,
    from_id: int | None = None,
    to_id: int | None = None,
    is_reply: bool | None = None,
    shares_content: bool | None = None,
    language: str | None = None,
    conversation_id: int | None = None,
    now: dt.datetime | None = None,
) -> DataFrame:
    """Search an archive ``posts(post_id, created_at, text, lang, conversation_id,
    is_reply, shares_content, is_ad)``; ``None`` leaves a condition out.

    The start is inclusive and the end exclusive, ads never match, and an id bound
    (both exclusive) replaces the dates. ``max_results`` takes the newest.
    """
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    window = clamp_window(from_date, to_date, now)
    if window is None:
        return posts.filter(F.lit(False))
    out = posts.filter(~F.coalesce(F.col("is_ad"), F.lit(False)))
    if keyword is not None:
        for word in keyword.lower().split():
            out = out.filter(F.contains(F.lower("text"), F.lit(word)))
    if language is not None:
        out = out.filter(F.col("lang") == language)
    if conversation_id is not None:
        out = out.filter(F.col("conversation_id") == int(conversation_id))
    for name, wanted in (("is_reply", is_reply), ("shares_content", shares_content)):
        if wanted is not None:
            out = out.filter(F.coalesce(F.col(name), F.lit(False)) == F.lit(wanted))
    if from_id is not None or to_id is not None:
        if from_id is not None:
            out = out.filter(F.col("post_id") > int(from_id))
        if to_id is not None:
            out = out.filter(F.col("post_id") < int(to_id))
    else:
        start, end = window
        out = out.filter(F.col("created_at") >= F.lit(start))
        if end is not None:
            out = out.filter(F.col("created_at") < F.lit(end))
    if max_results is not None:
        out = out.orderBy(F.desc("created_at"), F.desc("post_id")).limit(max_results)
    return out


def null_date_shares(claims: DataFrame) -> DataFrame:
    """``(reviewer, n_claims, n_null, null_share)``."""
    return claims.groupBy("reviewer").agg(
        F.count(F.lit(1)).alias("n_claims"),
        F.count_if(F.col("date").isNull()).alias("n_null"),
        F.avg(F.when(F.col("date").isNull(), 1.0).otherwise(0.0)).alias("null_share"),
    )


def dated_claims(claims: DataFrame, max_null_share: float = 0.1) -> DataFrame:
    """Claims with a date. Raises first when a reviewer lacks too many dates."""
    bad = null_date_shares(claims).filter(F.col("null_share") > max_null_share).orderBy("reviewer").take(5)
    if bad:
        raise ValueError(f"too many claims without a date: {[(r.reviewer, r.n_null, r.n_claims) for r in bad]}")
    return claims.filter(F.col("date").isNotNull())
