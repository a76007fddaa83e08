"""A ledger of what failed: how often each piece of work of a job was tried, and its last error.

Work that fails is tried again in later passes, a given number of times, and then left; what
succeeds leaves the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a ledger.
LEDGER = "job string, key string, tries bigint, error string"
#: Times that a piece of work is tried.
MOST = 3


def fold(ledger: DataFrame, results: DataFrame) -> DataFrame:
    """The ledger after a pass with ``results(job, key, error)``: a null error is a success and clears the
    key, an error adds a try; of several errors of a key in one pass the largest text is kept. Rows without a key are left out."""
    passed = results.dropna(subset=["job", "key"]).groupBy("job", F.col("key").cast("string").alias("key")).agg(
        F.count("error").alias("_tries"), F.max("error").alias("_error"), F.bool_or(F.col("error").isNull()).alias("_ok")
    )
    joined = ledger.join(passed, ["job", "key"], "full").filter("NOT coalesce(_ok, false)")
    tries = F.coalesce("tries", F.lit(0)) + F.coalesce("_tries", F.lit(0))
    return joined.select("job", "key", tries.cast("long").alias("tries"), F.coalesce("_error", "error").alias("error"))


def given_up(ledger: DataFrame, most: int = MOST) -> DataFrame:
    """The rejects: work that was tried ``most`` times."""
    return ledger.filter(F.col("tries") >= most)


def open_work(inputs: DataFrame, key: str, ledger: DataFrame, job: str, most: int = MOST) -> DataFrame:
    """``inputs`` without the rows whose key was given up on in the job."""
    gone = given_up(ledger, most).filter(F.col("job") == job).select(F.col("key").alias("_key"))
    return inputs.join(gone, F.col(f"`{key}`").cast("string") == F.col("_key"), "left_anti")
