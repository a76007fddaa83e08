"""Node and edge tables out of the landed archive tables.

Archive tables hold text cells and the columns of :mod:`claimweave.schemas`, plus ``query``
(the folder) and ``row_no`` (place in its file). The same id may come in several folders:
the first one in ``(precedence, query, row_no)`` wins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import html, lists, text
from claimweave.functions.claims import box_center, day_text
from claimweave.functions.numbers import to_integer
from claimweave.operators.filters import maybe_article
from claimweave.operators.keyed import build_edge, upsert_first, upsert_last, violations

ORDER = ["query", "row_no"]


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _int(name: str) -> Column:
    return to_integer(_c(name))


def _bool(name: str) -> Column:
    return _c(name).try_cast("boolean")


def _posts(df: DataFrame, precedence: int) -> DataFrame:
    return df.select(
        _int("id").alias("post_id"),
        _c("text"),
        _c("source"),
        _c("lang"),
        _c("created_at"),
        _int("public_metrics.like_count").alias("like_count"),
        _int("public_metrics.retweet_count").alias("retweet_count"),
        _int("public_metrics.reply_count").alias("reply_count"),
        _int("public_metrics.quote_count").alias("quote_count"),
        F.lit(precedence).alias("precedence"),
        *ORDER,
    )


def _first(df: DataFrame, key: str, order: Sequence[str] = tuple(ORDER)) -> DataFrame:
    return upsert_first(df, [key], order).drop(*order)


def post_nodes(tweets: DataFrame, replies: DataFrame) -> DataFrame:
    """Posts, then referenced posts whose id is not there yet."""
    rows = _posts(tweets, 0).unionByName(_posts(replies, 1))
    return _first(rows, "post_id", ["precedence", *ORDER])


def user_nodes(authors: DataFrame) -> DataFrame:
    """Users with an id and a user name; names in lower case."""
    rows = authors.dropna(subset=["username", "id"]).select(
        _int("id").alias("user_id"),
        F.lower("username").alias("user_name"),
        _bool("verified").alias("verified"),
        _c("description"),
        _c("name"),
        _c("created_at"),
        _int("public_metrics.followers_count").alias("followers_count"),
        _int("public_metrics.following_count").alias("following_count"),
        _int("public_metrics.tweet_count").alias("tweet_count"),
        *ORDER,
    )
    return _first(rows, "user_id")


def user_name_violations(users: DataFrame) -> DataFrame:
    """User names held by several ids. All the ids are kept (quirk Q4)."""
    return violations(users, ["user_name"])


def _tags(df: DataFrame, key: str, column: str) -> DataFrame:
    tag = F.explode(lists.field(_c(column), "tag"))
    return df.select(_int(key).alias("src"), tag.alias("tag")).select("src", F.lower("tag").alias("tgt"))


def hashtag_nodes(tweets: DataFrame, authors: DataFrame) -> DataFrame:
    tags = _tags(tweets, "id", "entities.hashtags").union(_tags(authors, "id", "entities.description.hashtags"))
    return tags.select(F.col("tgt").alias("name")).distinct()


def post_urls(tweets: DataFrame) -> DataFrame:
    return tweets.select(_int("id").alias("src"), F.explode(lists.record_urls(_c("entities.urls"))).alias("tgt"))


def user_urls(authors: DataFrame) -> DataFrame:
    """URLs of the profile field and text; the profile picture counts as one (Q25)."""
    parts = [
        authors.select(_int("id").alias("src"), F.explode(lists.record_urls(_c(column))).alias("tgt"))
        for column in ("entities.url.urls", "entities.description.urls")
    ]
    return parts[0].union(parts[1]).union(profile_pictures(authors))


def profile_pictures(authors: DataFrame) -> DataFrame:
    return authors.select(_int("id").alias("src"), _c("profile_image_url").alias("tgt")).dropna()


def media_urls(media: DataFrame) -> DataFrame:
    """``(src = url, tgt = media id)``; one row per URL and preview, so that the either-or
    match is an equi-join."""
    urls = F.explode(F.array(_c("url"), _c("preview_image_url")))
    return media.select(urls.alias("src"), _c("media_key").alias("tgt")).dropna()


def url_nodes(tweets: DataFrame, authors: DataFrame, media: DataFrame) -> DataFrame:
    names = (
        post_urls(tweets).select("tgt").union(user_urls(authors).select("tgt")).union(media_urls(media).select("src"))
    )
    return names.toDF("name").dropna().distinct()


def media_nodes(media: DataFrame) -> DataFrame:
    rows = media.select(
        _c("media_key").alias("media_id"),
        _c("type"),
        _int("height").alias("height"),
        _int("width").alias("width"),
        _int("duration_ms").alias("duration_ms"),
        _int("public_metrics.view_count").alias("view_count"),
        *ORDER,
    )
    return _first(rows, "media_id")


def place_nodes(places: DataFrame, axis_order: str = "given") -> DataFrame:
    box = lists.doubles(_c("geo.bbox"))
    lat, lng = box_center(box, axis_order)
    rows = places.select(
        _c("id").alias("place_id"),
        _c("name"),
        _c("country_code"),
        _c("country"),
        _c("full_name"),
        _c("place_type"),
        box.alias("bounding_box"),
        lat.alias("lat"),
        lng.alias("lng"),
        *ORDER,
    )
    return _first(rows, "place_id")


def poll_nodes(polls: DataFrame) -> DataFrame:
    rows = polls.select(
        _c("id").alias("poll_id"),
        _int("duration_minutes").alias("duration_minutes"),
        _c("end_datetime"),
        _c("voting_status"),
        _c("options"),
        *ORDER,
    )
    return _first(rows, "poll_id")


def conversation_nodes(tweets: DataFrame) -> DataFrame:
    return tweets.select(_int("conversation_id").alias("conversation_id")).dropna().distinct()


#: Node tables of the archive, and how each comes out of the landed tables.
ARCHIVE_NODES = {
    "post": lambda dfs: post_nodes(dfs["tweets"], dfs["replies"]),
    "user": lambda dfs: user_nodes(dfs["authors"]),
    "hashtag": lambda dfs: hashtag_nodes(dfs["tweets"], dfs["authors"]),
    "url": lambda dfs: url_nodes(dfs["tweets"], dfs["authors"], dfs["media"]),
    "media": lambda dfs: media_nodes(dfs["media"]),
    "place": lambda dfs: place_nodes(dfs["places"]),
    "poll": lambda dfs: poll_nodes(dfs["polls"]),
    "conversation": lambda dfs: conversation_nodes(dfs["tweets"]),
}

#: The columns of the node tables that edges look at.
END_COLUMNS = {
    "post": ["post_id"],
    "user": ["user_id", "user_name"],
    "hashtag": ["name"],
    "url": ["name"],
    "media": ["media_id"],
    "place": ["place_id"],
    "poll": ["poll_id"],
    "conversation": ["conversation_id"],
}


def archive_nodes(dfs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All node tables of the archive."""
    return {name: make(dfs) for name, make in ARCHIVE_NODES.items()}


def archive_ends(dfs: dict[str, DataFrame], name: str) -> DataFrame:
    """The columns of one node table that edges look at. Where these are keys alone, no row is chosen per key."""
    return ARCHIVE_NODES[name](dfs).select(*END_COLUMNS[name])


def _mentions(df: DataFrame, column: str) -> DataFrame:
    name = F.explode(lists.field(_c(column), "username"))
    return df.select(_int("id").alias("src"), name.alias("n")).select("src", F.lower("n").alias("user_name"))


def mention_edges(rows: DataFrame, src_nodes: DataFrame, users: DataFrame) -> DataFrame:
    """Mentions by user name; a name held by several ids gives an edge to each."""
    named = rows.dropna().distinct().join(users.select("user_name", F.col("user_id").alias("tgt")), "user_name")
    return build_edge(named, src_nodes, None)


def _cells(tweets: DataFrame, column: str, fn) -> DataFrame:
    return tweets.select(_int("id").alias("src"), F.explode(fn(_c(column))).alias("tgt"))


def _key(nodes: Mapping[str, DataFrame], name: str) -> DataFrame:
    return nodes[name].select(END_COLUMNS[name][0])


#: Edge tables of the archive: landed rows, node tables of both ends.
_ARCHIVE_EDGES = {
    "user_posted_post": (lambda d: d["tweets"].select(_int("author_id").alias("src"), _int("id").alias("tgt")), "user", "post"),
    "post_has_hashtag": (lambda d: _tags(d["tweets"], "id", "entities.hashtags"), "post", "hashtag"),
    "user_has_hashtag": (lambda d: _tags(d["authors"], "id", "entities.description.hashtags"), "user", "hashtag"),
    "post_mentions_user": (lambda d: _mentions(d["tweets"], "entities.mentions"), "post", None),
    "user_mentions_user": (lambda d: _mentions(d["authors"], "entities.description.mentions"), "user", None),
    "post_links_to_url": (lambda d: post_urls(d["tweets"]), "post", "url"),
    "user_links_to_url": (lambda d: user_urls(d["authors"]), "user", "url"),
    "user_has_profile_picture_url": (lambda d: profile_pictures(d["authors"]), "user", "url"),
    "post_has_media": (lambda d: _cells(d["tweets"], "attachments.media_keys", lists.strings), "post", "media"),
    "url_is_media": (lambda d: media_urls(d["media"]), "url", "media"),
    "post_has_poll": (lambda d: _cells(d["tweets"], "attachments.poll_ids", lists.strings), "post", "poll"),
    "post_is_part_of_conversation": (
        lambda d: d["tweets"].select(_int("id").alias("src"), _int("conversation_id").alias("tgt")), "post", "conversation"
    ),
    "post_located_in_place": (lambda d: d["tweets"].select(_int("id").alias("src"), _c("geo.place_id").alias("tgt")), "post", "place"),
    "post_references_post": (lambda d: _cells(d["tweets"], "referenced_tweets", lists.reference_ids), "post", "post"),
}


def archive_edge(dfs: dict[str, DataFrame], nodes: Mapping[str, DataFrame], name: str) -> DataFrame:
    """One edge table ``(src, tgt)`` of the archive; ends that do not exist are dropped. Only the node tables of
    its two ends are asked for, so ``nodes`` may make them when they are."""
    landed, src, tgt = _ARCHIVE_EDGES[name]
    if tgt is None:
        return mention_edges(landed(dfs), _key(nodes, src), nodes["user"])
    return build_edge(landed(dfs), _key(nodes, src), _key(nodes, tgt))


def archive_edges(dfs: dict[str, DataFrame], nodes: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All edge tables ``(src, tgt)`` of the archive."""
    return {name: archive_edge(dfs, nodes, name) for name in _ARCHIVE_EDGES}


def claim_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """Claims, reviewers and reviews out of claim rows with ``file_reviewer`` (file stem)
    and ``row_no``.

    The last row of a claim sets its columns, the last row of a (reviewer, claim) pair sets
    the review. A review needs a reviewer that is the stem of some file.
    """
    order = ["file_reviewer", "row_no"]
    reviewers = rows.select(F.col("file_reviewer").alias("url")).distinct()
    claims = upsert_last(rows.select("claim", "source", "date", "language", *order), ["claim"], order)
    reviews = upsert_last(
        rows.select("reviewer", "claim", "raw_verdict", "raw_verdict_en", "predicted_verdict", *order),
        ["reviewer", "claim"],
        order,
    ).join(reviewers.withColumnRenamed("url", "reviewer"), "reviewer", "left_semi")
    return {"claim": claims.drop(*order), "reviewer": reviewers, "has_reviewed": reviews.drop(*order)}


def attach_clusters(claims: DataFrame, clusters: DataFrame) -> DataFrame:
    """Add ``keywords, cluster_keywords, cluster`` by the English claim text. Several claims
    may share a text; of several cluster rows for a text the last in order of
    ``row_no`` counts. Cluster -1 has no keywords of its own."""
    last = upsert_last(clusters, ["claim"], ["row_no"]).select(
        F.col("claim").alias("claim_en"),
        F.col("label_single").alias("keywords"),
        F.when(F.col("cluster") == -1, "").otherwise(F.col("label")).alias("cluster_keywords"),
        F.col("cluster"),
    )
    return claims.join(last, "claim_en", "left")


def article_tables(pages: DataFrame, urls: DataFrame | None = None, skip_preparse: bool = False) -> dict[str, DataFrame]:
    """Articles out of landed ``pages(url, html)``, keyed by the stripped URL.

    Pages without a title or content are dropped. Of several pages of one article the
    smallest URL sets its columns; every URL that strips to the article is linked to it.
    ``urls(name)`` limits the pages to known URLs.
    """
    rows = pages.filter(F.col("url").isNotNull() & F.col("html").isNotNull())
    if urls is not None:
        rows = rows.join(urls.select(F.col("name").alias("url")), "url", "left_semi")
    if not skip_preparse:
        rows = rows.filter(maybe_article(F.col("url")))
    h = F.col("html")
    parsed = rows.select(
        text.strip_url(F.col("url")).alias("article_url"),
        "url",
        html.page_title(h).alias("title"),
        html.authors(h).alias("authors"),
        day_text(html.publish_time(h)).alias("publish_date"),
        html.page_content(h).alias("content"),
        html.top_image(h).alias("top_image"),
    ).filter("title <> '' AND content <> ''")
    first = upsert_first(parsed, ["article_url"], ["url"])
    images = first.select(F.col("article_url").alias("src"), F.col("top_image").alias("tgt")).dropna()
    return {
        "article": first.select(F.col("article_url").alias("url"), "title", "authors", "publish_date", "content"),
        "url_is_article": parsed.select(F.col("url").alias("src"), F.col("article_url").alias("tgt")).distinct(),
        "article_has_top_image": images,
        "url": images.select(F.col("tgt").alias("name")).distinct(),
    }
