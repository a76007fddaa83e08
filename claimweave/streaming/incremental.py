"""Work that arrives bit by bit: process the rest, resume, upsert new files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimweave.tables import Tables


def table_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(target) and len(fs.listStatus(target)) > 0


def remaining(inputs: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Inputs without an output yet."""
    return inputs if done is None else inputs.join(done.select(key), key, "left_anti")


def process_rest(
    inputs: DataFrame,
    key: str,
    step: Callable[[DataFrame], DataFrame],
    path: str,
    valid: Callable[[DataFrame], DataFrame] | None = None,
    rejects: str | None = None,
) -> int:
    """One pass over the rest: ``step`` on all inputs that neither the output nor the
    rejects hold, appended to ``path``. Returns the number of rows taken.

    ``valid`` adds a boolean column ``ok``; rows that fail go to ``rejects`` instead of
    stopping the pass, and are not tried again.
    """
    spark = inputs.sparkSession
    rest = inputs
    for old in (path, rejects):
        if old and table_exists(spark, old):
            rest = remaining(rest, spark.read.parquet(old), key)
    n = rest.count()
    if n == 0:
        return 0
    out = step(rest)
    if valid is not None:
        out = valid(out)
        good, bad = out.filter("ok").drop("ok"), out.filter("NOT coalesce(ok, false)").drop("ok")
        if rejects:
            bad.write.mode("append").parquet(rejects)
        out = good
    out.write.mode("append").parquet(path)
    return n


def first_writers(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key of a stream: of the earliest micro-batch that has the key, and in
    it the first in ``order``; rows without a key are left out. For update mode.

    What has been seen is keyed state of the stream, one row a key, which each task looks up by key. So
    a batch costs what it holds, however long the stream has run; a
    state store on disk (RocksDB) keeps it out of memory. Batches are told apart by their times, so the
    driver's clock must not be set back.
    """
    rest = [c for c in stream.columns if c not in keys]
    stamped = stream.dropna(subset=keys).withColumn("_at", F.current_timestamp())
    best = F.min_by(F.struct("_at", *rest), F.struct("_at", *order)).alias("_row")
    seen = stamped.groupBy(*keys).agg(best, F.max("_at").alias("_last"))
    # A key that was there before comes out again with its old row.
    return seen.filter("_row._at = _last").select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def upsert_stream(
    source: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], transform=None
) -> StreamingQuery:
    """Upsert everything a streaming source has now into the table at ``path``, then stop; first writer
    wins. The checkpoint remembers the files and the keys, so a later run takes up only new ones; a
    batch that is run again after a failure adds nothing twice. Read it with :func:`stream_table`."""
    tables, name = _table(source.sparkSession, path)
    rows = first_writers(transform(source) if transform else source, keys, order).select(source.columns if transform is None else "*")
    return (
        rows.writeStream.outputMode("update")
        .foreachBatch(lambda batch, epoch: tables.append(name, batch, epoch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _table(spark: SparkSession, path: str) -> tuple[Tables, str]:
    root, name = path.rstrip("/").rsplit("/", 1)
    return Tables(spark, root), name


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """The table that :func:`upsert_stream` writes."""
    tables, name = _table(spark, path)
    return tables.read(name)


def new_names(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Searches or reviewers that have no output yet."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def poison_rows(df: DataFrame, checks: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)``: rejects carry ``error``, the name of the first SQL condition
    they fail; a null condition counts as failed."""
    error = F.coalesce(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in checks.items()])
    marked = df.withColumn("error", error)
    return marked.filter("error IS NULL").drop("error"), marked.filter("error IS NOT NULL")
