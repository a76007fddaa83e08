"""List cells that hold a printed Python list instead of JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OBJECTS = "array<map<string,string>>"
STRINGS = "array<string>"
_JSON_NAMES = {"None": "null", "True": "true", "False": "false"}


def as_json(c: Column) -> Column:
    """Printed list -> JSON text: backslashes doubled, single quotes made double, and
    None / True / False outside of words turned into their JSON names."""
    quoted = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit('"'))

    def named(*names: str) -> Column:
        out = quoted
        for name in names:
            out = F.regexp_replace(out, rf"([:,\[] ?){name}(?=\s*[,\]}}])", f"$1{_JSON_NAMES[name]}")
        return out

    # Most cells hold none of the three, others None alone, and skip the patterns of the rest.
    none, truth = F.contains(c, F.lit("None")), F.contains(c, F.lit("True")) | F.contains(c, F.lit("False"))
    return F.when(truth, named(*_JSON_NAMES)).when(none, named("None")).otherwise(quoted)


def _parse(c: Column, schema: str) -> Column:
    parsed = F.when(F.startswith(F.ltrim(c), F.lit("[")), F.from_json(as_json(c), schema))
    empty = F.array().cast(schema)
    return F.when(c.isNotNull(), F.coalesce(parsed, empty))


def objects(c: Column) -> Column:
    """Printed list of records -> array of maps; null stays null, junk becomes empty."""
    return _parse(c, OBJECTS)


def strings(c: Column) -> Column:
    """Printed list of scalars (or records, kept as JSON text) -> array of strings."""
    return _parse(c, STRINGS)


def doubles(c: Column) -> Column:
    return F.transform(strings(c), lambda x: x.try_cast("double"))


def field(c: Column, key: str) -> Column:
    """The non-null values of one key over a printed list of records."""
    return F.filter(F.transform(objects(c), lambda m: F.try_element_at(m, F.lit(key))), lambda v: v.isNotNull())


def record_urls(c: Column) -> Column:
    """URLs of a printed list of link records: the expanded form if the key is there
    (a null there gives nothing), otherwise the short form."""

    def pick(m: Column) -> Column:
        return F.when(F.map_contains_key(m, "expanded_url"), F.try_element_at(m, F.lit("expanded_url"))).otherwise(
            F.try_element_at(m, F.lit("url"))
        )

    return F.filter(F.transform(objects(c), pick), lambda v: v.isNotNull())


def reference_ids(c: Column) -> Column:
    """Ids of referenced posts, listed either as ids or as ``{type, id}`` records."""
    return F.transform(strings(c), lambda x: F.coalesce(F.get_json_object(x, "$.id"), x).try_cast("bigint"))
