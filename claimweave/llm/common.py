"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.session import cut_lineage

#: A word: a longest run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: More rows than this are joined by a shuffle, fewer may be broadcast.
BROADCAST_ROWS = 2_000_000


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_fold(column: str, folds: int) -> Column:
    """crc32 of an id written as text, modulo ``folds``; null ids give null."""
    return F.crc32(F.col(column).cast("string")) % folds


def unit_hash(seed: str, *columns: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the columns only."""
    key = F.concat_ws("\x1f", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(2**52)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted size allows it, else as it is.

    ``df`` is a written table of narrow rows, so that counting reads only its footers; beyond
    the bound the join is an ordinary shuffled one, with the same result.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """``doc_id, label``: one 0/1 label per document, the majority if it has several (a tie is
    1); rows without id or label are left out."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .groupBy("doc_id")
        .agg((F.avg(F.col(column).cast("double")) >= 0.5).cast("int").alias("label"))
    )


def running_starts(df: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """Adds, for each ``value: out``, the sum of ``value`` over all rows before a row in the
    order of ``keys`` (nulls last).

    Rows are dealt into slices by range; each slice sums its own rows, and only one number per
    slice is summed over all slices. Only rows with equal keys, all of them, may tie.
    """
    order = [F.col(k).asc_nulls_last() for k in keys]
    sliced = cut_lineage(df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()))
    totals = sliced.groupBy("_slice").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_slice", *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_b_{v}") for v in values])
    inside = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = sliced.withColumns({f"_i_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    joined = summed.join(before, "_slice")
    joined = joined.withColumns({out: F.col(f"_b_{v}") + F.col(f"_i_{v}") for v, out in values.items()})
    return joined.drop("_slice", *[f"_{x}_{v}" for v in values for x in "bi"])


@contextmanager
def text_batches(spark: SparkSession, rows: int = 2_000) -> Iterator[None]:
    """Jobs run inside hand whole texts to Python in batches of so many rows. At Spark's 10 000, what a
    worker and the buffers on both sides hold is tens of megabytes of text a task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release_memory() -> None:
    """Gives freed memory back to the system. Spark keeps Python workers for later tasks, and for
    a minute without any; what they have freed would count against their executor all the time."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, intercept: bool = True):
    """Weights of a logistic regression by Newton's method on a small matrix."""
    design = np.c_[x, np.ones(len(x))] if intercept else x
    w = np.zeros(design.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -35, 35)))
        grad = design.T @ (p - y) + ridge * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node id reachable over undirected edges.

    Every round each edge points its larger label at its smaller one, then labels jump to the
    label of their label; each round is a written table, so a lost executor costs one round.
    The rounds follow the logarithm of a component's diameter. Nodes without an edge are not
    in the result.
    """
    links = cut_lineage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    nodes = cut_lineage(ends.withColumn("component", F.col("node")))
    while True:
        la = nodes.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        lb = nodes.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        open_ = cut_lineage(links.join(la, "a").join(lb, "b").where("ca <> cb").select("ca", "cb"))
        if open_.isEmpty():
            return nodes
        # Labels are themselves nodes: hook the larger label to the smallest label next to it.
        ordered = open_.select(F.greatest("ca", "cb").alias("component"), F.least("ca", "cb").alias("to"))
        hooks = cut_lineage(ordered.groupBy("component").agg(F.min("to").alias("to")))
        while True:
            far = hooks.select(F.col("component").alias("to"), F.col("to").alias("further"))
            jumped = cut_lineage(hooks.join(far, "to", "left"))
            if jumped.where("further is not null").isEmpty():
                break
            hooks = jumped.select("component", F.coalesce("further", "to").alias("to"))
        nodes = cut_lineage(nodes.join(hooks, "component", "left").select("node", F.coalesce("to", "component").alias("component")))


def batches(rows: Iterable[tuple], names: list[str], types: dict, size: int = 4096):
    """Arrow batches of at most ``size`` rows from an iterator of tuples."""
    import pyarrow as pa

    schema = pa.schema([(n, types[n]) for n in names])
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
