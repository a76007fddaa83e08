import pytest
from pyspark.sql import functions as F

from claimweave import tables
from claimweave.streaming import incremental as inc
from claimweave.tables import Tables


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_stream_upsert_in_steps(spark, tmp_path):
    src, table, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "id bigint, v string, n bigint"

    def land(*data):
        spark.createDataFrame(list(data), schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        inc.upsert_stream(stream, table, check, ["id"], ["n"]).awaitTermination()
        return rows(inc.stream_table(spark, table), "id", "v")

    land((1, "a", 2), (1, "b", 1), (2, "c", 1), (None, "x", 0))
    assert run() == [(1, "b"), (2, "c")]
    # Rows of files already taken do not come again, and a known key keeps its first row.
    land((1, "late", 0), (3, "d", 1))
    land((3, "e", 0), (4, "f", 0))
    assert run() == [(1, "b"), (2, "c"), (3, "d"), (4, "f")]
    assert run() == [(1, "b"), (2, "c"), (3, "d"), (4, "f")]


def test_a_batch_run_twice_adds_nothing(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    batch = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id bigint")
    t.append("t", batch(1, 2), 0)
    t.append("t", batch(3), 1)
    t.append("t", batch(3), 1)
    t.append("t", batch(1, 2), 0)
    assert rows(t.read("t"), "id") == [(1,), (2,), (3,)]


def test_batches_cost_what_they_hold(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "MANY", 4)
    src, table, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema, want = "id bigint, n bigint", {}
    written, write = [], Tables._write
    monkeypatch.setattr(Tables, "_write", lambda self, name, df, level=0: written.append(level) or write(self, name, df, level))
    for k in range(25):
        data = [(k, k), (k // 2, 1000 + k), (100 + k, 0)]
        for i, n in sorted(data, key=lambda r: r[1]):
            want.setdefault(i, n)
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(src)
        if k in (9, 10, 24):
            # Stopped and started again; one file a batch.
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
            inc.upsert_stream(stream, table, check, ["id"], ["n"]).awaitTermination()
    assert dict(rows(inc.stream_table(spark, table), "id", "n")) == want
    # Twenty-five batches: one write each, and merges of four folders.
    assert written.count(0) == 25 and written.count(1) == 6 and written.count(2) == 1
    assert len(inc._table(spark, table)[0]._newest("out")[1]["folders"]) <= 3 * 4


def test_process_the_rest(spark, tmp_path):
    out, bad = str(tmp_path / "out"), str(tmp_path / "bad")
    step = lambda df: df.withColumn("len", F.length("t"))
    valid = lambda df: df.withColumn("ok", F.col("len") < 3)
    first = spark.createDataFrame([(1, "a"), (2, "long")], "id bigint, t string")
    assert inc.process_rest(first, "id", step, out, valid, bad) == 2
    assert inc.process_rest(first, "id", step, out, valid, bad) == 0
    more = first.union(spark.createDataFrame([(3, "bb")], "id bigint, t string"))
    assert inc.process_rest(more, "id", step, out, valid, bad) == 1
    assert rows(spark.read.parquet(out), "id", "len") == [(1, 1), (3, 2)]
    assert rows(spark.read.parquet(bad), "id") == [(2,)]


def test_poison_rows(spark):
    df = spark.createDataFrame([(1, "1"), (2, "x"), (None, "3")], "id bigint, n string")
    good, bad = inc.poison_rows(df, {"no id": "id IS NOT NULL", "no number": "try_cast(n AS int) > 0"})
    assert rows(good, "id") == [(1,)]
    assert sorted(((r.id, r.error) for r in bad.collect()), key=repr) == [(2, "no number"), (None, "no id")]


def test_new_names(spark):
    wanted = spark.createDataFrame([("a",), ("b",)], "q string")
    done = spark.createDataFrame([("a",), ("a",)], "q string")
    assert rows(inc.new_names(wanted, done, "q"), "q") == [("b",)]


def test_shared_folder_is_needed_off_local(spark, monkeypatch):
    from claimweave import session

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="share"):
        session.shared_dir(Session())


def test_written_tables_and_their_removal(spark, tmp_path):
    from claimweave.session import cut_lineage, drop_intermediate_tables, shared_dir

    cut = cut_lineage(spark.createDataFrame([(1, "a")], "id bigint, v string").filter("id < 0"))
    assert cut.columns == ["id", "v"] and cut.count() == 0
    assert shared_dir(spark) in cut.inputFiles()[0]
    assert callable(drop_intermediate_tables)
