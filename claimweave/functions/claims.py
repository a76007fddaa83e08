"""Expressions over claim reviews, verdicts and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimweave.functions.text import ISO_DAY

# The verdict classes and their numbers, and the seed thresholds per size.
VERDICT_IDS = {"factual": 0, "misinformation": 1, "other": 2}
RULED = ("misinformation", "factual")
SIZES = {"small": 0.80, "medium": 0.75, "large": 0.70}
LINK_THRESHOLD = 0.7


def claim_date(claim: Column, review: Column, review_url: Column) -> Column:
    """Date of a claim, else of its review, else a day found in the review URL."""
    day = F.nullif(F.regexp_extract(review_url, ISO_DAY, 0), F.lit(""))
    return F.coalesce(claim, review, F.concat(day, F.lit("T00:00:00Z")))


def verdict_id(verdict: Column) -> Column:
    pairs = [F.lit(x) for kv in VERDICT_IDS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), verdict)


def is_ruled(verdict: Column) -> Column:
    """Verdicts that say something about the truth of a claim."""
    return verdict.isin(*RULED)


def english_verdict(raw: Column, language: Column, translated: Column) -> Column:
    return F.when(language == "en", raw).otherwise(translated)


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def parse_date(c: Column) -> Column:
    """Text -> timestamp, junk -> null."""
    return F.try_to_timestamp(c)


def window_start(date: Column, days: int = 3) -> Column:
    return date - F.make_dt_interval(F.lit(days))


def search_window(date: Column) -> tuple[Column, Column]:
    """Half-open window ``[date - 3 days, date + 1 day)`` in which posts on a claim are
    searched; linking uses the shorter closed window that ends at the date."""
    return window_start(date), date + F.make_dt_interval(F.lit(1))


def box_center(box: Column, axis_order: str = "given") -> tuple[Column, Column]:
    """Means of corners 0/2 and 1/3 as (lat, lng). Boxes in west-south-east-north order
    need ``axis_order='lonlat'``; the default keeps the plain formula (quirk Q7)."""

    def mid(i: int) -> Column:
        return (F.get(box, F.lit(i)) + F.get(box, F.lit(i + 2))) / 2

    return (mid(1), mid(0)) if axis_order == "lonlat" else (mid(0), mid(1))
