"""Verdict annotation: work lists, merging, language and case variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions import text
from claimweave.functions.claims import verdict_id
from claimweave.operators.keyed import shuffled, upsert_first
from claimweave.schemas import CLAIM_COLUMNS

# Language codes that search terms and verdicts are translated into.
LANGUAGES = (
    "am ar hy eu bn bs bg my hr ca cs da nl en et fi fr ka de el gu ht iw hi hu is in it ja kn km ko lo lv lt ml mr "
    "ne no or pa ps fa pl pt ro ru sr zh-CN sd si sk sl es sv tl ta te th zh-TW tr uk ur ug vi cy"
).split()


def annotation_worklist(
    claims: DataFrame, *labelled: DataFrame, include_duplicates: bool = False, seed: int = 42
) -> DataFrame:
    """Claims that no ``labelled`` table holds, with old predictions renamed.

    Without duplicates: one claim per English verdict text, the least confident first.
    Rows with a null text match nothing and stay; as duplicates of each other one of them
    is kept. With duplicates: compared by claim text, in a repeatable random order.
    """
    out = claims.withColumnsRenamed(
        {
            "predicted_verdict": "old_predicted_verdict",
            "predicted_verdict_confidence": "old_predicted_verdict_confidence",
        }
    )
    key = "claim" if include_duplicates else "raw_verdict_en"
    for table in labelled:
        out = out.join(table.select(key).distinct(), key, "left_anti")
    if include_duplicates:
        return shuffled(out, "claim", seed)
    confidence = "old_predicted_verdict_confidence"
    order = [c for c in (confidence, "claim", "reviewer", "date") if c in out.columns]
    ranked = out.withColumn("_unsure", F.col(confidence).isNull()) if confidence in out.columns else out
    first = order if confidence not in out.columns else ["_unsure", *order]
    keyed = ranked.withColumn("_key", F.struct(F.col("raw_verdict_en")))
    kept = upsert_first(keyed, ["_key"], first).drop("_key")
    return kept.orderBy(*first).drop("_unsure")


def head(df: DataFrame, n: int = 100) -> DataFrame:
    """The first rows of an ordered work list."""
    return df.limit(n)


def changed_annotations(annotations: DataFrame) -> DataFrame:
    """Changed rows only, the positional record ``claim_data`` unpacked into columns."""
    fields = [F.col("claim_data")[i].alias(c) for i, c in enumerate(CLAIM_COLUMNS)] if str(
        annotations.schema["claim_data"].dataType.typeName()
    ) == "array" else [F.col(f"claim_data.{c}") for c in CLAIM_COLUMNS]
    return annotations.filter("changed").select(*fields, "verdict")


def merge_annotations(old: DataFrame | None, new: DataFrame, order: list[str], include_duplicates: bool = False) -> DataFrame:
    """Old and new annotations together; one per English verdict text, the old one first,
    then by ``order``. Without an old table nothing is removed."""
    if old is None:
        return new
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    if include_duplicates:
        return both.drop("_age")
    keyed = both.withColumn("_key", F.struct("raw_verdict_en"))
    return upsert_first(keyed, ["_key"], ["_age", *order]).drop("_key", "_age")


def case_variants(annotations: DataFrame, column: str = "raw_verdict") -> DataFrame:
    """Four copies of every row, one per letter case; ``case`` names it. One pass: the
    copies are exploded from the row, the table is not read four times."""
    c = F.col(column)
    forms = {"lower": F.lower(c), "upper": F.upper(c), "capitalize": text.capitalize(c), "title": text.title_case(c)}
    variants = F.array(*[F.struct(F.lit(k).alias("case"), v.alias("form")) for k, v in forms.items()])
    rest = [x for x in annotations.columns if x != column]
    return annotations.select(*rest, F.explode(variants).alias("v")).select(
        *rest, "v.case", F.col("v.form").alias(column)
    )


def numbered_labels(annotations: DataFrame, verdict: str = "verdict") -> DataFrame:
    return annotations.withColumn("label", verdict_id(F.col(verdict)))


def to_languages(df: DataFrame, language: str, languages: list[str] = LANGUAGES) -> DataFrame:
    """One copy of every row per language other than its own, in ``target``. A row without
    a language gets them all."""
    all_of_them = F.array(*[F.lit(x) for x in languages])
    other = F.filter(all_of_them, lambda x: ~F.coalesce(x == F.col(language), F.lit(False)))
    return df.withColumn("target", F.explode(other))


def expand_annotations(annotations: DataFrame, memory: DataFrame, languages: list[str] = LANGUAGES, backend=None) -> DataFrame:
    """The annotations and a translated copy of each per other language."""
    from claimweave.operators.translate import translate

    copies = translate(to_languages(annotations, "language", languages), "raw_verdict", "target", memory, "_t", backend)
    copies = copies.withColumn("raw_verdict", F.col("_t")).withColumn("language", F.col("target"))
    return annotations.unionByName(copies.select(*annotations.columns))


def query_terms(keywords: DataFrame, hashtags: DataFrame | None = None) -> DataFrame:
    """Distinct lower-case search terms ``(term)``; hashtags get their sign."""
    terms = keywords.toDF("term")
    if hashtags is not None:
        terms = terms.union(hashtags.select(F.concat(F.lit("#"), F.col(hashtags.columns[0]))))
    return terms.dropna().select(F.lower("term").alias("term")).distinct()


def expand_keywords(keywords: DataFrame, memory: DataFrame, languages: list[str] = LANGUAGES, backend=None) -> DataFrame:
    """Search terms and their translations into every language, distinct."""
    from claimweave.operators.translate import translate

    terms = query_terms(keywords)
    wide = terms.withColumn("target", F.explode(F.array(*[F.lit(x) for x in languages])))
    done = translate(wide, "term", "target", memory, "translated", backend)
    return query_terms(terms.union(done.select("translated")))
