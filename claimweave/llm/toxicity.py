"""Toxicity by compression distance: windows of a text are compressed with a dictionary trained
on ordinary text and with one that holds toxic text too; what the second saves tells."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import fit_logistic, one_label, release_memory, text_batches, unit_hash
from claimweave.session import cut_lineage

#: About so many labelled documents of each class at most are read for training, and at most so
#: many words of one of them: windows all over the document, picked by a hash.
TRAIN_DOCS = 4_000
TRAIN_WORDS = 2_000
#: Windows of ordinary text that the ordinary dictionary is trained on at most: all of the sample,
#: or if it has more, about so many, picked by a hash over all of its documents alike.
TRAIN_WINDOWS = 40_000
#: Words of a window.
WINDOW = 10
#: Bytes of the two dictionaries. The toxic one is small, so that it holds little else.
ORDINARY_BYTES = 16_384
TOXIC_BYTES = 1_024
#: The toxic dictionary is trained on beginnings of words, of so many letters, that so many toxic
#: documents have, after so many words, and so many times as often as ordinary ones.
SHORTEST, LONGEST = 4, 10
LEAST_DOCS = 5
ODDS = 40
#: Savings in bytes that count as a hit.
HITS = (3, 5)


@dataclass
class Detector:
    """The two dictionaries and the calibration of a document's window savings."""

    ordinary: bytes
    toxic: bytes
    mean: list[float]
    deviation: list[float]
    weights: list[float]


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """Consecutive windows of lower-cased words that cover the whole text."""
    words = (text or "").lower().split()
    return [f" {' '.join(words[i : i + size])} ".encode("utf-8", "replace") for i in range(0, len(words), size)]


def compressors(model: Detector):
    """Compressors with the ordinary dictionary, and with the toxic one after it."""
    import zstandard as zstd

    params = zstd.ZstdCompressionParameters(
        write_content_size=False, write_checksum=False, write_dict_id=False, strategy=zstd.STRATEGY_GREEDY,
        min_match=5, window_log=17, hash_log=17, chain_log=17, search_log=4,
    )

    def with_dictionary(content: bytes):
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        return zstd.ZstdCompressor(dict_data=d, compression_params=params)

    return with_dictionary(model.ordinary), with_dictionary(model.ordinary + model.toxic)


def savings_features(parts: list[bytes], ordinary, toxic) -> list[float]:
    """Summary of how many bytes the toxic dictionary saves over a document's windows."""
    saved = np.array([len(ordinary.compress(p)) - len(toxic.compress(p)) for p in parts] or [0], float)
    saved[::-1].sort()
    shares = [float((saved >= h).mean()) for h in HITS]
    counts = [float(np.log1p((saved >= h).sum())) for h in HITS]
    second = saved[1] if len(saved) > 1 else saved[0]
    return [min(saved[0], 8.0), min(second, 8.0), float(saved.mean()), *shares, *counts, float(np.log(len(saved)))]


def stem_of(word: str, stems: set[str]) -> str | None:
    return next((word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1) if word[:n] in stems), None)


def telling_stems(toxic: list[str], plain: list[str]) -> set[str]:
    """Beginnings of words that tell toxic from ordinary text, each as long as nearly all words of
    toxic text that begin like it agree."""
    least = min(LEAST_DOCS, max(2, len(toxic) // 50))  # fewer where there are few toxic documents
    odds = min(ODDS, len(plain)) * len(toxic) / len(plain)

    def documents_with(texts: list[str], n: int, of: set[str] | None = None) -> Counter:
        found: Counter = Counter()
        for t in texts:
            beginnings = {w[:n] for w in t.lower().split() if len(w) >= n}
            found.update(beginnings if of is None else beginnings & of)
        return found

    counts = {n: documents_with(toxic, n) for n in range(SHORTEST, LONGEST + 1)}
    stems: set[str] = set()
    for n in range(SHORTEST, LONGEST + 1):
        often = {p for p, c in counts[n].items() if c >= least and not stem_of(p, stems)}
        in_plain = documents_with(plain, n, often)
        stems |= {p for p in often if counts[n][p] + 0.1 > odds * (in_plain[p] + 0.5)}
    # Copies of one document repeat all their words, but always after the same word.
    before: dict[str, set[str]] = {p: set() for p in stems}
    for t in toxic:
        split = t.lower().split()
        for previous, w in zip(["", *split], split):
            if p := stem_of(w, stems):
                before[p].add(previous)
    longer = {}
    for n in range(SHORTEST + 1, LONGEST + 1):
        for p, c in counts[n].items():
            if c > longer.get(p[:-1], ("", 0))[1]:
                longer[p[:-1]] = (p, c)
    out = set()
    for p in (p for p, words in before.items() if len(words) >= least):
        while p in longer and longer[p][1] >= 0.8 * counts[len(p)][p]:
            p = longer[p][0]
        out.add(p)
    return out


def ordinary_windows(texts: list[str], most: int = TRAIN_WINDOWS) -> list[bytes]:
    """All windows of the texts, or about ``most`` of them, the same share of every text."""
    total = sum(-(-len(t.split()) // WINDOW) for t in texts)
    share = 2**32 * most / max(1, total)
    if total <= most:
        return [w for t in texts for w in windows(t)]
    return [w for t in texts for i, w in enumerate(windows(t)) if zlib.crc32(w, i) < share]


def train_detector(texts: list[tuple[str, int]], train_windows: int = TRAIN_WINDOWS) -> Detector:
    """From a bounded list of (text, label). Without both classes nothing is toxic or all is."""
    import zstandard as zstd

    toxic, plain = [t for t, y in texts if y], [t for t, y in texts if not y]
    n = 8  # features
    if not toxic or not plain:
        return Detector(b"", b"", [0.0] * n, [1.0] * n, [0.0] * n + [5.0 if toxic else -5.0])
    stems = telling_stems(toxic, plain)
    words = [x for t in toxic for w in t.lower().split() if (x := stem_of(w, stems))]
    passages = [f" {' '.join(words[i : i + 6])} ".encode() for i in range(0, len(words), 6)]
    distinct = f" {' '.join(sorted(stems))} ".encode() if stems else b""
    ordinary = ordinary_windows(plain, train_windows)

    def trained(samples: list[bytes], size: int, **how) -> bytes:
        try:
            return zstd.train_dictionary(size, samples, **how).as_bytes()
        except zstd.ZstdError:  # too few samples to train on: they are the dictionary
            return b"".join(dict.fromkeys(samples))[:size]

    # The trainer picks what pays most and cuts the rest: it is asked where not all stems fit.
    toxic_part = distinct if len(distinct) <= TOXIC_BYTES else trained(passages, TOXIC_BYTES, k=24, d=6)
    model = Detector(trained(ordinary, ORDINARY_BYTES), toxic_part, [], [], [])
    plain_c, toxic_c = compressors(model)
    x = np.array([savings_features(windows(t), plain_c, toxic_c) for t, _ in texts])
    mean, dev = x.mean(0), x.std(0) + 1e-6
    w = fit_logistic((x - mean) / dev, np.array([y for _, y in texts], float))
    model.mean, model.deviation, model.weights = mean.tolist(), dev.tolist(), w.tolist()
    return model


def training_texts(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> list[tuple[str, int]]:
    """A bounded sample of labelled texts, the same for the same rows in any order."""
    known = cut_lineage(one_label(labels, "toxic"))
    counts = dict(known.groupBy("label").count().collect())
    share = F.when(F.col("label") == 1, train_docs / max(1, counts.get(1, 0))).otherwise(2 * train_docs / max(1, counts.get(0, 0)))
    picked = known.where(unit_hash("toxicity", F.col("doc_id")) < share)
    # About 3 * train_docs ids by construction, so that they may be broadcast.
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
    found = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    parts = found.mapInArrow(_some_words, "doc_id long, text string, label int").orderBy("doc_id")
    with text_batches(docs.sparkSession):
        return [(r.text, r.label) for r in parts.collect()]


def _some_words(batches):
    """Of a text of more than ``TRAIN_WORDS`` words, runs of 40 words picked by a hash of their
    place in the text, about that many words."""
    import pyarrow as pa

    for batch in batches:
        texts = []
        for text in batch.column(1).to_pylist():
            words = text.split()
            share = 2**32 * TRAIN_WORDS / max(1, len(words))
            runs = (words[i : i + 40] for i in range(0, len(words), 40) if zlib.crc32(str(i).encode()) < share)
            texts.append(text if len(words) <= TRAIN_WORDS else " ".join(w for run in runs for w in run))
        columns = [batch.column(0), pa.array(texts, pa.string()), batch.column(2)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "label"])


def _rating(model: Detector):
    """Scores of a batch of texts; the compressors are made once a task."""
    plain_c, toxic_c = compressors(model) if model.ordinary else (None, None)
    mean, dev, w = (np.array(v) for v in (model.mean, model.deviation, model.weights))

    def rate(texts) -> list[float]:
        scores = []
        for text in texts:
            if plain_c is None:
                z = w[-1]
            else:
                f = np.array(savings_features(windows(text.as_py()), plain_c, toxic_c))
                z = (f - mean) / dev @ w[:-1] + w[-1]
            scores.append(1 / (1 + np.exp(-np.clip(z, -35, 35))))
        return scores

    return rate


def score_toxicity(docs: DataFrame, model: Detector) -> DataFrame:
    """The columns of ``docs`` without the text, ``score`` and ``predicted``."""

    def run(batches):
        import pyarrow as pa

        rate = _rating(model)
        for batch in batches:
            scores = rate(batch.column("text"))
            columns = {n: batch.column(n) for n in batch.schema.names if n != "text"}
            columns["score"] = pa.array(scores, pa.float64())
            columns["predicted"] = pa.array([int(s >= 0.5) for s in scores], pa.int32())
            yield pa.RecordBatch.from_pydict(columns)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{kinds}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_windows: int = TRAIN_WINDOWS) -> DataFrame:
    """``doc_id, score, predicted`` of every row, from its whole text alone.

    ``labels`` (``doc_id, toxic``) teach; several labels of one document count as their majority.
    Null and empty texts are one empty window. Without labels of both classes every document
    gets the score of the one that there is (0.0067 without any). Repeated rows give
    repeated results, other columns are not read.
    """
    model = train_detector(training_texts(docs, labels, train_docs), train_windows)
    return score_toxicity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)


def drop_toxic(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_windows: int = TRAIN_WINDOWS) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    model = train_detector(training_texts(docs, labels, train_docs), train_windows)

    def harmless(batches):
        import pyarrow as pa

        rate = _rating(model)
        for batch in batches:
            yield batch.filter(pa.array([s < 0.5 for s in rate(batch.column("text"))], pa.bool_()))
        release_memory()

    # Written here, so that small batches hold whoever reads the rows; a text goes to the workers once.
    with text_batches(docs.sparkSession):
        return cut_lineage(docs.mapInArrow(harmless, docs.schema))
