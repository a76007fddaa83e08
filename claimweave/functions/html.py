"""Article parts out of raw HTML, as Column expressions over the whole page."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimweave.functions.text import squeeze, strip

_DROP = r"(?is)<!--.*?-->|<(script|style|nav|footer|aside)\b.*?</\1\s*>"

# A reference by number or name, or what stands between two of them.
_PIECE = r"(?s)&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*;?|&|[^&]+"
_PAIR, _CELL = "\x1e", "\x1f"
#: Longest name that may stand without its semicolon.
_LONGEST = max(len(name) for name in html5 if not name.endswith(";"))
_REPLACEMENT = "�"


def _names() -> Column:
    """Character of each name of the HTML standard, those that may lack the semicolon also without. One
    text that is parsed when the plan is optimised."""
    cells = (f"{name}{_CELL}{value}" for name, value in html5.items())
    return F.str_to_map(F.lit(_PAIR.join(cells)), F.lit(_PAIR), F.lit(_CELL))


def _character(code: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _by_number(piece: Column) -> Column:
    """A numeric reference. As the standard asks, 128 to 159 mean the characters of Windows-1252, zero, surrogates and
    numbers beyond Unicode the replacement character, and other control characters and
    non-characters nothing."""
    digits = F.regexp_extract(piece, "([0-9a-fA-F]+);?$", 1)
    short = F.ltrim(digits, F.lit("0"))
    hexed = F.substring(piece, 3, 1).isin("x", "X")
    number = F.when(hexed, F.conv(short, 16, 10).cast("long")).otherwise(short.try_cast("long"))
    code = F.when(F.length(short) > 8, F.lit(1 << 30)).otherwise(F.coalesce(number, F.lit(0)))
    windows = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160))
    low = F.substr(F.lit(windows), (code - 127).cast("int"), F.lit(1))
    nothing = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | ((code % 65536) >= 65534)
    return (
        F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), _REPLACEMENT)
        .when(code.between(128, 159), low)
        .when(nothing, "")
        .otherwise(_character(code))
    )


def _by_name(piece: Column, names: Column) -> Column:
    """A named reference; of one without semicolon, or with an unknown name, the longest beginning that is a
    name that may stand so. A name that is none stays as it is."""
    name = F.substr(piece, F.lit(2))

    def beginning(k: Column) -> Column:
        value = F.try_element_at(names, F.substr(name, F.lit(1), k))
        return F.when(value.isNotNull(), F.concat(value, F.substr(name, k + 1)))

    lengths = F.sequence(F.least(F.length(name), F.lit(_LONGEST)), F.lit(2), F.lit(-1))
    begun = F.filter(F.transform(F.when(F.length(name) >= 2, lengths), beginning), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(names, name), F.get(begun, F.lit(0)), piece)


def unescape(c: Column) -> Column:
    """Text with its character references resolved, named and numeric ones, each once: what a reference
    stands for is not read again. A no-break space becomes a blank."""
    names = _names()

    def resolved(piece: Column) -> Column:
        made = F.when(F.startswith(piece, F.lit("&#")), _by_number(piece)).when(F.length(piece) > 1, _by_name(piece, names)).otherwise(piece)
        return F.when(F.startswith(piece, F.lit("&")), F.translate(made, " ", " ")).otherwise(piece)

    pieces = F.transform(F.regexp_extract_all(c, F.lit(_PIECE), F.lit(0)), resolved)
    return F.when(F.contains(c, F.lit("&")), F.array_join(pieces, "")).otherwise(c)


def _text(c: Column) -> Column:
    return unescape(F.regexp_replace(c, r"(?s)<[^>]*>", ""))


def page_title(html: Column) -> Column:
    return squeeze(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def page_content(html: Column) -> Column:
    """Text of the paragraphs, one per line. A paragraph ends at its closing tag, at the
    next paragraph or where the article or body ends."""
    body = F.regexp_replace(html, _DROP, "")
    parts = F.regexp_extract_all(body, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)(?=</p>|<p[\s>]|</article>|</body>|\z)"), F.lit(1))
    lines = F.filter(F.transform(parts, lambda x: strip(_text(x))), lambda x: x != "")
    return squeeze(F.array_join(lines, "\n"))


def meta(html: Column, name: str) -> Column:
    """Content of a named meta tag, null when it is absent or empty."""
    tag = F.regexp_extract(html, rf"(?is)<meta\s[^>]*(?:name|property)=[\"']{name}[\"'][^>]*>", 0)
    return F.nullif(unescape(F.regexp_extract(tag, r"(?is)content=[\"'](.*?)[\"']", 1)), F.lit(""))


def authors(html: Column) -> Column:
    """Distinct author names of a page; an empty list without an author tag."""
    names = F.split(F.coalesce(meta(html, "author"), F.lit("")), r"\s*[,;]\s*")
    return F.array_distinct(F.filter(F.transform(names, strip), lambda x: x != ""))


def publish_time(html: Column) -> Column:
    return F.try_to_timestamp(F.coalesce(meta(html, "article:published_time"), meta(html, "date")))


def top_image(html: Column) -> Column:
    return F.nullif(strip(meta(html, "og:image")), F.lit(""))
