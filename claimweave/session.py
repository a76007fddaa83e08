"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "claimweave", **conf) -> SparkSession:
    """A session with the settings the operators rely on.

    UTC keeps time windows stable, AQE splits skewed join partitions and picks the
    final partition counts. Everything else is left to the cluster's own defaults.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        b = b.master(master)
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder; elsewhere a folder of one machine would lose data.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="claimweave-"))
    return sc.getCheckpointDir()


def _own_tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from the written copy. A lost
    executor then costs no recomputation, and the planner knows the true size."""
    path = f"{_own_tables(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_intermediate_tables(spark: SparkSession) -> None:
    """Delete what :func:`cut_lineage` wrote in this application, once its results are
    written elsewhere."""
    target = spark._jvm.org.apache.hadoop.fs.Path(_own_tables(spark))
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def widen(scan: DataFrame) -> DataFrame:
    """Spread a plain file scan over all cores before heavy work on its rows.

    Only a table of a few files is affected; with more splits than cores, as on a cluster,
    the scan stays as it is and nothing is shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
