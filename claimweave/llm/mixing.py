"""Mixing sources to target weights: repetition rates per source, whole copies plus one
hash-seeded Bernoulli copy per document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import running_starts, small, unit_hash, word_count
from claimweave.session import cut_lineage

#: Weights of the sources in code point order, over and over.
WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
CEILING = 3


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``.

    The sources share the total size by weight; a target stops at ``ceiling`` times its source's
    size, and what is left over is shared by weight among the others until none is above.
    Sources are ordered by code point, null last. Without any words every target is 0.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = running_starts(totals.withColumn("_one", F.lit(1)), ["source"], {"_one": "_rank"})
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = cut_lineage(
        ranked.select("source", "source_size", weight.cast("long").alias("_w"), (F.col("source_size") * ceiling).alias("_cap"))
    )
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # the level only rises; each round caps at least one source more
        above = F.col("_w") * F.lit(level) > F.col("_cap")
        n, cap, left = table.agg(F.count_if(above), F.sum(F.when(above, F.col("_cap"))), F.sum(F.when(~above, F.col("_w")))).first()
        if n == capped or not left:
            break
        capped, level = n, (total - (cap or 0)) / left
    share = F.col("_w") * F.lit(level)
    return table.select(
        "source", "source_size", F.when(share > F.col("_cap"), F.col("_cap").cast("double")).otherwise(share).alias("target")
    )


def with_copies(docs: DataFrame, targets: DataFrame, seed: str = "mix") -> DataFrame:
    """Adds ``source_size, target, copies`` to rows that have ``doc_id`` and ``source``.

    ``copies`` is the whole part of target / source_size, plus one with a probability equal to
    the fraction; the draw depends on the seed and ``doc_id`` alone, so reruns agree and rows
    with the same id get the same number.
    """
    t = targets.withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (unit_hash(seed, F.col("doc_id")) < rate - F.floor(rate)).cast("long")
    return (
        docs.join(small(t), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").withColumn("copies", F.floor(rate) + extra)
    )


def emitted(docs: DataFrame, targets: DataFrame, seed: str = "mix") -> DataFrame:
    """The rows of :func:`with_copies`, each as often as its ``copies`` say."""
    copies = with_copies(docs, targets, seed).where("copies > 0")
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy", "copies")


def sizes_of(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size``: words per document, 0 for a null text."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, ceiling: int = CEILING, seed: str = "mix") -> DataFrame:
    """The documents, each as often as its source's target asks for, with all their columns.

    Null sources are one source, the last. Null and empty texts have size 0; they are repeated
    like the others of their source, but a source without words is left out. Repeated rows
    are repeated alike. An empty table stays empty. Extra columns are kept, whatever their names.
    """
    targets = cut_lineage(source_targets(sizes_of(docs).drop("doc_id"), weights, ceiling))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "source")
    return emitted(rows, targets, seed).select("_row.*")


def mixed_sizes(docs: DataFrame, weights: Sequence[int] = WEIGHTS, ceiling: int = CEILING, seed: str = "mix") -> DataFrame:
    """``doc_id, size, source_size, target, taken``: the words of each row, and those of all its
    copies that the mix emits, 0 if it emits none. The texts are read once."""
    sized = cut_lineage(sizes_of(docs).withColumn("_row", F.monotonically_increasing_id()))
    targets = cut_lineage(source_targets(sized.select("source", "size"), weights, ceiling))
    same = F.col("source").eqNullSafe(F.col("_source"))
    every = sized.join(small(targets.withColumnRenamed("source", "_source")), same, "left").drop("_source")
    keys = ["_row", "doc_id", "size", "source_size", "target"]
    # Copies of a row come out of one task, so they are added up before the shuffle.
    words = every.select(*keys, F.lit(0).cast("long").alias("words")).union(emitted(sized, targets, seed).select(*keys, F.col("size").alias("words")))
    return words.groupBy(*keys).agg(F.sum("words").alias("taken")).drop("_row")
