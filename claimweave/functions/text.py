"""Text and URL expressions; each takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that decide what a cleaned text looks like.
MENTION = r"@[a-zA-Z0-9]*"
LINK = r"(http[a-zA-Z0-9.\/?&:]*|www[a-zA-Z0-9.\/?&:]]*)"
LINK_STRICT = r"(https?://[^\s]*|www\.[^\s]*)"
CLAIM_NOISE = r"[,.“\"0-9]"
ISO_DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"

# Spark's trim drops spaces only; this drops every kind of white space at both ends.
EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_SPACE, "")


def strip_url(c: Column) -> Column:
    """Drop the query string, then one trailing slash; a fragment stays."""
    return F.regexp_replace(F.regexp_replace(c, r"\?.*", ""), r"/$", "")


def squeeze(c: Column) -> Column:
    """Runs of newlines and of spaces become one each, then strip."""
    return strip(F.regexp_replace(F.regexp_replace(c, "\n+", "\n"), " +", " "))


def clean_post(c: Column, strict: bool = False) -> Column:
    """Text of a post before embedding: no mentions, links or hash signs, lower case.

    The default link pattern has a stray bracket (quirk Q8) and is kept for equal
    results; ``strict=True`` removes whole links instead.
    """
    c = F.regexp_replace(c, MENTION, " ")
    c = F.regexp_replace(c, LINK_STRICT if strict else LINK, " ")
    c = F.regexp_replace(c, "#", " ")
    c = F.regexp_replace(c, "-+", "-")
    c = F.regexp_replace(c, " +", " ")
    return strip(F.lower(c))


def clean_plain(c: Column) -> Column:
    """Text of a claim or an article summary before embedding."""
    return strip(F.lower(c))


def clean_search_text(c: Column) -> Column:
    """Claim text without the punctuation and digits that spoil search terms."""
    return F.regexp_replace(c, CLAIM_NOISE, "")


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


def title_case(c: Column) -> Column:
    """Upper case after every character that is not a cased letter (``initcap`` only
    looks at white space)."""
    runs = F.regexp_extract_all(c, F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0))
    return F.array_join(F.transform(runs, capitalize), "")


def folder_name(query: Column, prefix: str = "") -> Column:
    """Archive folder of a search: ``prefix-hashtag_some_words``."""
    name = F.replace(F.replace(query, F.lit("#"), F.lit("hashtag_")), F.lit(" "), F.lit("_"))
    return F.concat(F.lit(prefix + "-"), name)


def join_title(title: Column, content: Column) -> Column:
    return F.concat_ws("\n", title, content)


def tokens(c: Column) -> Column:
    """Lower-cased words (letters and digits of any script) of a whole text."""
    words = F.split(F.lower(c), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: w != "")


def sentences(c: Column) -> Column:
    """Sentences of a whole text: runs up to . ! ? or a newline, stripped."""
    parts = F.transform(F.regexp_extract_all(c, F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0)), strip)
    return F.filter(parts, lambda s: s != "")


def ngrams(words: Column) -> Column:
    """The words and the pairs of neighbours, joined by a space."""
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(words, pairs)
