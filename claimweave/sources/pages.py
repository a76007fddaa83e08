"""Landed API pages (JSON text) flattened into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.claims import claim_date
from claimweave.schemas import ARCHIVE

# Pages whose error says one of these simply give no rows; other errors are raised.
SKIPPED_ERRORS = ("User has been suspended", "Could not find", "not authorized to see")

_LISTS = {
    "tweets": "$.data",
    "authors": "$.includes.users",
    "media": "$.includes.media",
    "replies": "$.includes.tweets",
    "polls": "$.includes.polls",
    "places": "$.includes.places",
}


def _records(pages: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """One row per element of a JSON list; the element stays JSON text."""
    items = F.from_json(F.get_json_object("page", path), "array<string>")
    return pages.select(*keep, F.posexplode(items).alias("pos", "item"))


def _flat(items: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Dotted columns out of nested records, in one parse per record. Lists stay JSON text."""
    tops: dict[str, list[str]] = {}
    for c in columns:
        tops.setdefault(c.split(".")[0], []).append(c)

    def schema(names: list[str], depth: int) -> str:
        groups: dict[str, list[str]] = {}
        for n in names:
            groups.setdefault(n.split(".")[depth], []).append(n)
        parts = []
        for field, members in groups.items():
            deeper = [m for m in members if len(m.split(".")) > depth + 1]
            parts.append(f"`{field}`: struct<{schema(deeper, depth + 1)}>" if deeper else f"`{field}`: string")
        return ", ".join(parts)

    parsed = items.withColumn("r", F.from_json("item", f"struct<{schema(columns, 0)}>"))
    cells = [F.col("r." + ".".join(f"`{p}`" for p in c.split("."))).alias(c) for c in columns]
    return parsed.select(*keep, *cells)


def flatten_api_pages(pages: DataFrame) -> dict[str, DataFrame]:
    """``pages(query, page_no, page)`` -> the archive tables plus ``metadata``.

    Each table keeps ``query`` and a ``row_no`` that follows page and place. A page with
    errors and no data gives no rows.
    """
    out = {}
    keep = ["query", "page_no"]
    for name, path in _LISTS.items():
        rows = _flat(_records(pages, path, keep), ARCHIVE[name], [*keep, "pos"])
        row_no = F.col("page_no").cast("bigint") * 1_000_000 + F.col("pos")
        out[name] = rows.withColumn("row_no", row_no).drop("page_no", "pos")
    meta = F.from_json(
        F.get_json_object("page", "$.meta"),
        "struct<newest_id: string, oldest_id: string, result_count: bigint, next_token: string>",
    )
    out["metadata"] = pages.select(*keep, meta.alias("m")).select(*keep, "m.*").filter("result_count > 0")
    return out


def flatten_id_pages(pages: DataFrame, columns: list[str], stamp: str) -> DataFrame:
    """``pages(requested_id, page)`` of followers, followees, retweeters or a timeline ->
    rows of ``columns`` with the requested id in the column ``stamp``.

    Pages of suspended, unknown or private accounts give no rows; see
    :func:`page_errors` for the others.
    """
    rows = _flat(_records(pages, "$.data", ["requested_id"]), columns, ["requested_id"])
    return rows.withColumnRenamed("requested_id", stamp)


def page_errors(pages: DataFrame) -> DataFrame:
    """Pages without data whose error is not one of the expected kinds."""
    detail = F.get_json_object("page", "$.errors[0].detail")
    expected = F.lit(False)
    for words in SKIPPED_ERRORS:
        expected = expected | F.contains(detail, F.lit(words))
    return pages.select("*", detail.alias("detail")).filter(
        F.get_json_object("page", "$.data").isNull() & detail.isNotNull() & ~expected
    )


def flatten_claim_search(responses: DataFrame) -> DataFrame:
    """``responses(response)`` of a claim search -> claim rows. Only the first review of a
    claim counts; the date falls back to the review and then to its URL."""
    claim = (
        "array<struct<text: string, claimDate: string, claimant: string, claimReview: array<struct<"
        "publisher: struct<site: string>, languageCode: string, textualRating: string, reviewDate: string, url: string>>>>"
    )
    claims = F.from_json(F.get_json_object("response", "$.claims"), claim)
    rows = responses.select(F.explode(claims).alias("c")).select("c", F.get("c.claimReview", F.lit(0)).alias("r"))
    return rows.select(
        F.col("c.text").alias("claim"),
        claim_date(F.col("c.claimDate"), F.col("r.reviewDate"), F.col("r.url")).alias("date"),
        F.col("c.claimant").alias("source"),
        F.col("r.publisher.site").alias("reviewer"),
        F.col("r.languageCode").alias("language"),
        F.col("r.textualRating").alias("raw_verdict"),
    )
