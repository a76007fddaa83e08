"""Column types of the landed tables. Everything is text at first: cells are cast where
they are used, so that a bad cell becomes null instead of dropping its row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POST_COLUMNS = [
    "id", "author_id", "conversation_id", "created_at", "text", "lang", "source",
    "public_metrics.retweet_count", "public_metrics.reply_count",
    "public_metrics.like_count", "public_metrics.quote_count",
    "entities.urls", "entities.hashtags", "entities.mentions",
    "attachments.media_keys", "attachments.poll_ids", "geo.place_id", "referenced_tweets",
]

# Columns of an archive, per table.
ARCHIVE = {
    "tweets": POST_COLUMNS,
    "replies": POST_COLUMNS,
    "authors": [
        "id", "username", "name", "description", "created_at", "profile_image_url", "verified",
        "public_metrics.followers_count", "public_metrics.following_count", "public_metrics.tweet_count",
        "entities.url.urls", "entities.description.urls",
        "entities.description.hashtags", "entities.description.mentions",
    ],
    "media": [
        "media_key", "type", "url", "preview_image_url", "height", "width", "duration_ms",
        "public_metrics.view_count",
    ],
    "places": ["id", "name", "full_name", "country", "country_code", "place_type", "geo.bbox"],
    "polls": ["id", "end_datetime", "voting_status", "options", "duration_minutes"],
    "metadata": ["date", "newest_id", "oldest_id", "result_count", "next_token"],
}

ARCHIVE_KEYS = {
    "tweets": "id", "replies": "id", "authors": "id", "media": "media_key",
    "places": "id", "polls": "id", "metadata": "date",
}

CLAIMS = (
    "claim string, date string, source string, reviewer string, language string, "
    "raw_verdict string, raw_verdict_en string, predicted_verdict string, "
    "predicted_verdict_confidence double"
)
CLAIM_COLUMNS = ["claim", "date", "source", "reviewer", "language", "raw_verdict", "raw_verdict_en"]

CLUSTERS = "claim string, label string, label_single string, cluster int"


def conform(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The given text columns in order; a column the input lacks becomes a typed null."""
    have = set(df.columns)
    out = [
        (F.col(f"`{c}`").cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in columns
    ]
    return df.select(*out, *[F.col(f"`{k}`") for k in keep])
