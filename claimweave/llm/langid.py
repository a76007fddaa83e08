"""Language identification by rank-order profiles: a document's most frequent character
n-grams against each language's, by out-of-place distance."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.common import release_memory, small, unit_hash
from claimweave.session import cut_lineage

#: N-grams of a profile, and the longest n-gram.
PROFILE = 400
LONGEST = 3
#: About so many documents at most are read for the profiles (all, if there are fewer), of each
#: language an equal part of them at most.
TRAIN_DOCS = 60_000
#: A task counts n-grams whenever it holds so many, 8 bytes each, or one text's.
HELD_GRAMS = 4_000_000
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def gram_codes(text: str) -> np.ndarray:
    """N-grams of the lower-cased letters with one blank between and around words, as numbers:
    21 bits a character. Nothing for a text without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    codes[~letter] = 32
    codes = np.r_[32, codes[letter | np.r_[True, letter[:-1]]], 32]
    if codes[-2] == 32:
        codes = codes[:-1]
    if codes[1] == 32:
        codes = codes[1:]
    grams, out = codes, [codes[codes != 32]]
    for n in range(2, LONGEST + 1):
        grams = (grams[:-1] << 21) | codes[n - 1 :]
        out.append(grams)
    return np.concatenate(out)


def ranked_grams(text: str, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code."""
    grams = np.sort(gram_codes(text))
    if not len(grams):
        return grams
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    counts = np.diff(np.r_[first, len(grams)])
    if len(first) > size:  # all that may be among the first
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        first, counts = first[counts >= least], counts[counts >= least]
    return grams[first[np.argsort(-counts, kind="stable")]][:size]


def language_profiles(docs: DataFrame, size: int = PROFILE, train_docs: int = TRAIN_DOCS) -> dict[str, np.ndarray]:
    """The most frequent n-grams of each language in ``text, lang``, by rank.

    If there are more rows than ``train_docs``, each language may have an equal part of that number:
    of a language with more rows a hash of id and language picks about so many, a rarer one is
    read whole. Rows without a language or letters teach nothing.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = cut_lineage(known.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))
    n, n_lang = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
    if n > train_docs:
        share = F.least(F.lit(1.0), F.lit(train_docs / n_lang) / F.col("rows"))
        shares = cut_lineage(counts.select("lang", share.alias("share")))
        known = known.join(small(shares), "lang").where(unit_hash("langid", F.col("doc_id"), F.col("lang")) < F.col("share"))

    def count(batches):
        import pyarrow as pa

        held: dict[str, list[np.ndarray]] = {}
        many = 0

        def counted():
            for lang, parts in held.items():
                grams, counts = np.unique(np.concatenate(parts), return_counts=True)
                columns = [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                codes = gram_codes(text.as_py())
                held.setdefault(lang, []).append(codes)
                many += len(codes)
                if many >= HELD_GRAMS:
                    yield from counted()
                    held, many = {}, 0
        yield from counted()
        release_memory()

    grams = known.select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    totals = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = totals.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "gram", "rank")
    found: dict[str, list] = {}
    for lang, gram, place in top.collect():  # at most `size` rows a language
        found.setdefault(lang, []).append((place, gram))
    return {lang: np.array([g for _, g in sorted(found[lang])], np.int64) for lang in sorted(found)}


def out_of_place(ranked: np.ndarray, profile: np.ndarray, order: np.ndarray, size: int = PROFILE) -> float:
    """Mean distance of ranks over the document's n-grams, from 0 to 1; an n-gram that the
    profile lacks counts as ``size``. ``order`` sorts the profile."""
    at = np.minimum(np.searchsorted(profile, ranked, sorter=order), len(profile) - 1)
    places = order[at]
    away = np.where(profile[places] == ranked, np.abs(places - np.arange(len(ranked))), size)
    return float(np.minimum(away, size).mean()) / size


def predict_language(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, from its whole text alone.

    The nearest profile wins, ties by code point order of the languages; the score is one minus
    its distance. Null texts, texts without a letter, and all texts if there is no
    profile give ``und`` with score 0. Repeated rows give repeated results.
    """

    def predict(batches):
        import pyarrow as pa

        known = [(lang, p, np.argsort(p)) for lang, p in profiles.items()]
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1):
                text = text.as_py()
                ranked = ranked_grams(text, size) if text else ()
                if len(ranked) and known:
                    away, lang = min((out_of_place(ranked, p, o, size), lang) for lang, p, o in known)
                    langs.append(lang)
                    scores.append(1 - away)
                else:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
            columns = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double")


def identify_languages(docs: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """Profiles from ``train`` (the documents themselves if not given), then predictions."""
    return predict_language(docs, language_profiles(docs if train is None else train))
