"""Keyed building blocks: upserts, edges, distributed running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.session import cut_lineage


def _quoted(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], chooser) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*_quoted(rest))
    rank = F.struct(*_quoted(order))
    picked = df.groupBy(*_quoted(keys)).agg(chooser(row, rank).alias("_row"))
    return picked.select(*_quoted(keys), *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def upsert_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Insert-if-absent: the first row per key in ``order`` wins.

    An aggregate and no window: each task reduces its own rows before the shuffle, so a
    key with a third of all rows sends one row per task.
    """
    return _pick(df.dropna(subset=list(keys)), keys, order, F.min_by)


def upsert_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Update-or-insert: the last row per key in ``order`` wins."""
    return _pick(df.dropna(subset=list(keys)), keys, order, F.max_by)


def insert_absent(target: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``fresh`` whose key the target does not hold yet."""
    return fresh.join(target.select(*keys), list(keys), "left_anti")


def build_edge(
    rows: DataFrame, src_nodes: DataFrame | None, tgt_nodes: DataFrame | None
) -> DataFrame:
    """Distinct edges of ``rows(src, tgt)`` whose two ends exist.

    ``src_nodes`` and ``tgt_nodes`` have one key column each; ``None`` skips the check.
    Rows are made distinct first, so the joins see every edge once, and the joins are
    semi joins, so they cannot fan out.
    """
    edges = rows.select("src", "tgt").dropna().distinct()
    if src_nodes is not None:
        edges = edges.join(src_nodes.toDF("src"), "src", "left_semi")
    if tgt_nodes is not None:
        edges = edges.join(tgt_nodes.toDF("tgt"), "tgt", "left_semi")
    return edges.select("src", "tgt")


def join_skewed(big: DataFrame, dim: DataFrame, key: str, weight: str, hot: int = 10_000) -> DataFrame:
    """Inner join with a table of unique keys that knows how often each key occurs.

    The ``hot`` heaviest keys, a fixed number, are broadcast and their rows stay where they
    are. Any other key holds at most one in ``hot`` of all rows, so the shuffled rest is
    even. Both sides drop ``weight`` at the end.
    """
    heavy = dim.orderBy(F.desc(weight), key).limit(hot)
    near = big.join(F.broadcast(heavy), key)
    rest = big.join(F.broadcast(heavy.select(key)), key, "left_anti").join(
        dim.join(F.broadcast(heavy.select(key)), key, "left_anti"), key
    )
    return near.unionByName(rest).drop(weight)


def violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    counted = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.filter("n_rows > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Return ``df``; raise when a key occurs twice."""
    bad = violations(df, keys).take(3)
    if bad:
        raise ValueError(f"key {list(keys)} is not unique, for instance {[tuple(r) for r in bad]}")
    return df


def broken_keys(spark: SparkSession, keys: dict[str, DataFrame]) -> DataFrame:
    """``(key, n_keys, n_rows, example)``: of each named one-column frame, how many values occur more than
    once and in how many rows; null is no value. Keys without a repeat have no row.

    All frames are stacked as (name, value) and go through one aggregate, so an audit of many
    tables is one shuffle of their keys, combined before it.
    """
    stacked = spark.createDataFrame([], "key string, value string")
    for name, df in keys.items():
        stacked = stacked.union(df.select(F.lit(name), F.col(df.columns[0]).cast("string")))
    counted = stacked.dropna().groupBy("key", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return counted.groupBy("key").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_rows"), F.min("value").alias("example"))


def running_before(df: DataFrame, group: Sequence[str], lead: Sequence[str], order: str, value: Column) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the earlier rows of the group.

    Rows are ordered by ``(lead, order)``, of any sortable types, nulls first; rows that tie in all of it follow
    each other in some order. A plain window would put a whole group into one task. Here the rows
    are dealt into slices by range over ``(group, lead, order)``, as many as the session has shuffle
    partitions, so that a group with most of the rows is many slices; each is summed on its own, and only one total per slice
    and group goes through a window over the group. ``df`` is read once.
    """
    keys = [*group, *lead, order]
    dealt = df.withColumn("_value", value).repartitionByRange(*_quoted(keys)).withColumn("_slice", F.spark_partition_id())
    rows = cut_lineage(dealt)
    slices = [*group, "_slice"]
    totals = rows.groupBy(*_quoted(slices)).agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*_quoted(group)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    offsets = offsets.select(*[F.col(f"`{c}`").alias(f"_of_{c}") for c in slices], "_offset")
    local = Window.partitionBy(*_quoted(slices)).orderBy(*_quoted([*lead, order])).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_inner", F.coalesce(F.sum("_value").over(local), F.lit(0)))
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"`_of_{c}`")) for c in slices]
    joined = summed.join(offsets, same).withColumn("before", F.col("_inner") + F.col("_offset"))
    return joined.drop("_value", "_slice", "_inner", "_offset", *[f"_of_{c}" for c in slices])


def batch_ids(df: DataFrame, id_col: str, size: int, group: Sequence[str] = ()) -> DataFrame:
    """Number the ids, of any sortable type, in ascending order and cut them into batches of ``size``; the last,
    shorter batch is kept."""
    work = df if group else df.withColumn("_all", F.lit(0))
    numbered = running_before(work, list(group) or ["_all"], [], id_col, F.lit(1).cast("bigint"))
    out = numbered.withColumn("batch_id", F.floor(F.col("before") / size).cast("bigint")).drop("before")
    return out if group else out.drop("_all")


def progress(df: DataFrame, done: Column) -> DataFrame:
    """One row: total, done and remaining."""
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(done).alias("done"), F.count_if(~F.coalesce(done, F.lit(False))).alias("remaining")
    )


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, distinct."""
    return edges.select("src", "tgt").union(edges.select(F.col("tgt"), F.col("src"))).distinct()


def shuffled(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """A repeatable random order."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col)


def page_cursor(posts: DataFrame) -> DataFrame:
    """Earliest creation time seen: the exclusive upper bound of the next page."""
    return posts.agg(F.min("created_at").alias("next_to_date"))
