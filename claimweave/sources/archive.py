"""Readers for landed archives, claim files and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave.schemas import ARCHIVE, ARCHIVE_KEYS, CLAIM_COLUMNS, CLUSTERS, conform

_CSV = {"header": True, "multiLine": True, "mode": "PERMISSIVE", "escape": '"', "quote": '"'}
#: Tables of a search that go into the graph.
LOADED = [name for name in ARCHIVE if name != "metadata"]
_EXTRA = "_cell_beyond_header"


def _headers(spark: SparkSession, glob: str, key: str) -> dict[str, list[str]]:
    """Header line -> files that have it. Files written by separate searches list only the
    columns they happened to have, and Spark takes the columns of the first file for all."""
    lines = spark.read.text(glob).select(
        "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"),
        F.col("_metadata.file_block_start").alias("start"),
    )
    first = lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "n").alias("header"))
    per_header = first.filter(F.col("header").contains(key)).groupBy("header").agg(F.collect_list("file").alias("files"))
    return {r.header: sorted(r.files) for r in per_header.collect()}


def _exists(spark: SparkSession, glob: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def _read_csv(spark: SparkSession, files: list[str]) -> DataFrame:
    """All rows of files with one header, as text; absent cells are null and the first cell
    beyond the header is ``_cell_beyond_header``."""
    header = spark.read.options(**_CSV).csv(files[0]).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, _EXTRA]])
    return spark.read.schema(schema).options(**_CSV).csv(files)


def accepted(cells: DataFrame) -> DataFrame:
    """Rows with at most as many cells as their header; an empty cell beyond it is none."""
    return cells.filter(F.col(_EXTRA).isNull()).drop(_EXTRA)


def rejected(cells: DataFrame) -> DataFrame:
    return cells.filter(F.col(_EXTRA).isNotNull())


def _fetched(spark: SparkSession, folder: str, columns: list[str], by: str) -> DataFrame | None:
    """A table written as Parquet with one folder per ``by``, or None. The declared schema keeps
    the folder names strings."""
    if not _exists(spark, f"{folder}/{by}=*"):
        return None
    schema = ", ".join(f"`{c}` {'bigint' if c == 'row_no' else 'string'}" for c in dict.fromkeys([*columns, by]))
    return spark.read.schema(schema).parquet(folder)


def read_cells(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One table of all search folders ``root/<search>/<table>.csv``, and of fetched ones
    ``root/<table>/query=<search>`` (Parquet), as text columns, plus
    ``query`` (the folder), ``row_no`` and ``_cell_beyond_header``. One scan per distinct
    header, not per folder. Empty files give no rows; absent columns and the missing cells of
    short rows are null."""
    columns, key = ARCHIVE[table], ARCHIVE_KEYS[table]
    glob = f"{root.rstrip('/')}/*/{table}.csv"
    out = _fetched(spark, f"{root.rstrip('/')}/{table}", [*columns, "row_no"], "query")
    if out is not None:
        out = out.withColumn(_EXTRA, F.lit(None).cast("string"))
        out = conform(out, columns, ("query", "row_no", _EXTRA))
    groups = _headers(spark, glob, key) if _exists(spark, glob) else {}
    for files in groups.values():
        df = _read_csv(spark, files)
        df = df.withColumn("query", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+\.csv$", 1))
        df = conform(df.withColumn("row_no", F.monotonically_increasing_id()), columns, ("query", "row_no", _EXTRA))
        out = df if out is None else out.unionByName(df)
    if out is None:
        schema = ", ".join(f"`{c}` string" for c in columns) + f", query string, row_no bigint, {_EXTRA} string"
        return spark.createDataFrame([], schema)
    return out


def read_archive_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One table of an archive without the rows that have more cells than their header."""
    return accepted(read_cells(spark, root, table))


def read_archive(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: read_archive_table(spark, root, name) for name in LOADED}


def read_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Claim files, one per reviewer, CSV or fetched Parquet (``reviewer=<name>``): their columns, ``file_reviewer`` (file stem) and
    ``row_no``. No row is dropped; cells beyond the header are."""
    glob = f"{folder.rstrip('/')}/*.csv"
    columns = [*CLAIM_COLUMNS, "predicted_verdict", "predicted_verdict_confidence"]
    out = _fetched(spark, folder, columns, "reviewer")
    if out is not None:
        out = out.withColumn("file_reviewer", F.col("reviewer")).withColumn("row_no", F.monotonically_increasing_id())
        out = conform(out, columns, ("file_reviewer", "row_no"))
    groups = _headers(spark, glob, "claim") if _exists(spark, glob) else {}
    for files in groups.values():
        df = _read_csv(spark, files).drop(_EXTRA)
        stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1)
        df = df.withColumn("file_reviewer", stem).withColumn("row_no", F.monotonically_increasing_id())
        df = conform(df, columns, ("file_reviewer", "row_no"))
        out = df if out is None else out.unionByName(df)
    if out is None:
        schema = ", ".join(f"`{c}` string" for c in columns) + ", file_reviewer string, row_no bigint"
        out = spark.createDataFrame([], schema)
    return out.withColumn("predicted_verdict_confidence", F.col("predicted_verdict_confidence").try_cast("double"))


def read_claim_clusters(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.options(**_CSV).csv(path)
    names = [f.strip().split()[0] for f in CLUSTERS.split(",")]
    out = conform(df.withColumn("row_no", F.monotonically_increasing_id()), names, ("row_no",))
    return out.withColumn("cluster", F.col("cluster").try_cast("int"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """``(value)``: a flat YAML list of strings. Read as plain lines, so that ``no``
    (Norwegian) stays a string."""
    value = F.regexp_extract("value", r"^\s*-\s+[\"']?([^\"'#]*?)[\"']?\s*(?:\s#.*)?$", 1)
    return spark.read.text(path).select(value.alias("value")).filter("value <> ''")


def concat_tables(*tables: DataFrame) -> DataFrame:
    """Rows of several tables; a column one lacks becomes null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
