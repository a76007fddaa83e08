"""Translation of a text column through a translation memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# (texts, target language) -> translated texts; called with at most BATCH texts.
Backend = Callable[[list[str], str], list[str]]
BATCH = 50


def _call(backend: Backend):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for target, part in frame.groupby("target", sort=True):
                texts = part["text"].tolist()
                for i in range(0, len(texts), BATCH):
                    chunk = texts[i : i + BATCH]
                    try:
                        out, error = backend(chunk, target), None
                    except Exception as e:
                        # One bad text must not lose its batch: try them one by one.
                        out, error = [], str(e) or type(e).__name__
                        for t in chunk:
                            try:
                                out.append(backend([t], target)[0])
                            except Exception as e:
                                out.append(None)
                                error = str(e) or type(e).__name__
                    yield pd.DataFrame(
                        {
                            "text": chunk,
                            "target": target,
                            "translated": pd.Series(out, dtype=object),
                            "error": [(error or "no translation") if o is None else None for o in out],
                        }
                    )

    return run


def look_up(texts: DataFrame, memory: DataFrame, backend: Backend | None = None) -> DataFrame:
    """``texts(text, target)`` distinct -> ``(text, target, translated, error)``.

    ``memory(text, target, translated)`` holds one row per text and language. What it lacks
    goes to ``backend`` in batches; without a backend it stays null.
    """
    known = texts.join(memory.select("text", "target", "translated"), ["text", "target"], "left")
    if backend is None:
        return known.withColumn("error", F.lit(None).cast("string"))
    misses = known.filter("translated IS NULL").select("text", "target")
    fresh = misses.mapInPandas(_call(backend), "text string, target string, translated string, error string")
    hits = known.filter("translated IS NOT NULL").withColumn("error", F.lit(None).cast("string"))
    return hits.unionByName(fresh)


def translate(
    df: DataFrame, column: str, target: str, memory: DataFrame, out: str, backend: Backend | None = None, error: str | None = None
) -> DataFrame:
    """Add ``out``: ``column`` in the language named by the column ``target``; and, under the name ``error``, what
    the backend said of a text that it could not translate.

    Only distinct texts are looked up, so a text that fills a third of the table is
    translated once; the join back may be skewed on it and AQE splits that join.
    """
    wanted = df.select(F.col(column).alias("text"), F.col(target).alias("target")).dropna().distinct()
    said = [F.col("error").alias(error)] if error else []
    done = look_up(wanted, memory, backend).select(
        F.col("text").alias(column), F.col("target").alias(target), F.col("translated").alias(out), *said
    )
    return df.join(done, [column, target], "left")


def translate_to(
    df: DataFrame, column: str, memory: DataFrame, out: str, language: str = "en", backend: Backend | None = None, error: str | None = None
) -> DataFrame:
    return translate(df.withColumn("_target", F.lit(language)), column, "_target", memory, out, backend, error).drop("_target")


def translate_lines(
    df: DataFrame,
    key: str,
    column: str,
    memory: DataFrame,
    out: str,
    language: str = "en",
    backend: Backend | None = None,
    error: str | None = None,
) -> DataFrame:
    """``(key, out, not_translatable)``, and ``error`` under the name given: a text is split at newlines, each distinct line is
    translated, and the lines are joined again in order. A text with a line that stays
    untranslated is flagged and gets null."""
    lines = df.select(key, F.posexplode(F.split(column, "\n")).alias("_pos", "_line"))
    done = translate_to(lines, "_line", memory, "_new", language, backend, "_said")
    # Empty lines need no translation.
    new = F.when(F.col("_line") == "", F.lit("")).otherwise(F.col("_new"))
    said = F.when(F.col("_line") != "", F.col("_said"))
    rows = done.select(key, "_pos", new.alias("_new"), said.alias("_said"))
    joined = rows.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.col("_new")))), lambda x: x["_new"]), "\n").alias("_text"),
        F.bool_or(F.col("_new").isNull()).alias("not_translatable"), F.max("_said").alias("_said"),
    )
    more = [F.col("_said").alias(error)] if error else []
    return joined.select(key, F.when(~F.col("not_translatable"), F.col("_text")).alias(out), "not_translatable", *more)


def review_verdicts(claims: DataFrame, memory: DataFrame, backend: Backend | None = None) -> DataFrame:
    """Add ``raw_verdict_en``: English verdicts as they are, others translated."""
    from claimweave.functions.claims import english_verdict

    done = translate_to(claims, "raw_verdict", memory, "_t", "en", backend)
    return done.withColumn(
        "raw_verdict_en", english_verdict(F.col("raw_verdict"), F.col("language"), F.col("_t"))
    ).drop("_t")
