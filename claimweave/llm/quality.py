"""Quality scores by Bradley-Terry pairwise ranking over simple text features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import fit_logistic, one_label, unit_hash
from claimweave.session import cut_lineage

FEATURES = (
    "log_words word_length long_words distinct_words top_word letters upper digits blanks marks edge_marks "
    "capital_words distinct_lines line_words repeated_neighbours entropy"
).split()
#: About so many labelled documents at most are used, and so many preference pairs.
TRAIN_DOCS = 20_000
PAIRS = 200_000
#: The score that a document at the threshold quantile gets.
CUT = 0.3


def text_features(text: str | None) -> list[float]:
    """Numbers that describe a whole text; all 0 for null and texts without words."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size, n = raw.sum(), len(words)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, n)
    upper, lower, other = raw[65:91].sum(), raw[97:123].sum(), raw[128:].sum()
    digits, blanks = raw[48:58].sum(), raw[9:14].sum() + raw[32]
    share = raw[raw > 0] / size
    lines = [x for x in text.split("\n") if x.strip()]
    repeats = sum(map(str.__eq__, words[:-1], words[1:]))
    edge = sum(1 for w in counts if not (w[-1].isalnum() or w[-1] in ".,")) / len(counts)
    capital = sum(v for w, v in counts.items() if w[0].isupper()) / n
    return [
        float(x)
        for x in (
            np.log1p(n), min(lengths.mean(), 30), (lengths > 20).mean(), np.log1p(len(counts)) / np.log1p(n),
            max(counts.values()) / n, (upper + lower + other) / size, upper / max(1, upper + lower), digits / size,
            blanks / size, (size - upper - lower - other - digits - blanks) / size, edge, capital,
            len(set(lines)) / len(lines), np.log1p(n / len(lines)), repeats / n, -(share * np.log2(share)).sum(),
        )
    ]


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` of every row, ``x`` the features of the whole text."""

    def describe(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [text_features(t.as_py()) for t in batch.column(1)]
            columns = [batch.column(0), pa.array(rows, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(describe, "doc_id long, x array<double>")


@dataclass
class Ranking:
    """Weights of the standardised features; ``threshold`` is the score quantile below which lie
    as many training documents as have label 0, ``scale`` spreads the scores around it."""

    mean: list[float]
    deviation: list[float]
    weights: list[float]
    threshold: float
    scale: float


def fit_ranking(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Ranking:
    """Bradley-Terry: a document of label 1 beats one of label 0 with probability
    sigmoid(w (x1 - x0)); ``w`` minimises the logistic loss on the pairs' differences.

    Every document is in some pair while ``pairs`` allows; with one label only, all weights are 0
    and every score is above (label 1) or below (label 0) the cut.
    """
    if not len(x):
        return Ranking([0.0] * len(FEATURES), [1.0] * len(FEATURES), [0.0] * len(FEATURES), -1.0, 1.0)
    mean, dev = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / dev, -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(mean.tolist(), dev.tolist(), [0.0] * x.shape[1], -1.0 if len(good) else 1.0, 1.0)
    draw = np.random.default_rng(seed)
    n = min(pairs, len(good) * len(bad))
    a = np.concatenate([draw.permutation(good) for _ in range(-(-n // len(good)))])[:n]
    b = np.concatenate([draw.permutation(bad) for _ in range(-(-n // len(bad)))])[:n]
    difference = z[a] - z[b]
    sign = np.where(np.arange(n) % 2 == 0, 1.0, -1.0)  # half of the pairs the other way round
    w = fit_logistic(difference * sign[:, None], (sign > 0).astype(float), ridge=1.0, intercept=False)
    scores = z @ w
    low, high = np.quantile(scores, [max(0.0, len(bad) / len(y) - 0.005), min(1.0, len(bad) / len(y) + 0.005)])
    return Ranking(mean.tolist(), dev.tolist(), w.tolist(), float(low + high) / 2, float(np.std(scores)) / 4 + 1e-6)


def score_features(x: np.ndarray, model: Ranking) -> np.ndarray:
    z = np.clip((x - np.array(model.mean)) / np.array(model.deviation), -8, 8)
    odds = (z @ np.array(model.weights) - model.threshold) / model.scale + np.log(CUT / (1 - CUT))
    return 1 / (1 + np.exp(-np.clip(odds, -35, 35)))


def rank_quality(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``doc_id, score, predicted`` of every row of ``docs``; learned from ``labels`` (``doc_id,
    quality``), applied to the text alone. ``predicted`` is 1 from the score 0.3 on, which is
    the quantile of label 0 in the training documents.

    Null and empty texts have all features 0 and a score like the others. Several labels of one
    document count as their majority. If more than ``train_docs`` documents have a label, a hash
    of the id picks about that many. Repeated rows give repeated results; without any label
    every document is predicted 1. The texts are read once.
    """
    table = cut_lineage(features(docs))
    once = table.groupBy("doc_id").agg(F.min("x").alias("x"))
    known = once.join(one_label(labels, "quality"), "doc_id")
    n = one_label(labels, "quality").count()
    if n > train_docs:
        known = known.where(unit_hash("quality", F.col("doc_id")) < train_docs / n)
    rows = sorted((r for r in known.collect()), key=lambda r: r.doc_id)
    model = fit_ranking(np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.label for r in rows]))

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, len(FEATURES))
            s = score_features(x, model) if len(x) else np.zeros(0)
            columns = [batch.column(0), pa.array(s), pa.array((s >= CUT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted"])

    return table.mapInArrow(score, "doc_id long, score double, predicted int")
