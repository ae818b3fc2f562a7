import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landloom.plans.queue import queue_log, tax_changes
from landloom.streaming import imports
from landloom.streaming.queue import claims, item_states, queue_state, running_cells

FOLDER = "/root/testdata/sf0.001"


def stamped(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def streamed(spark, tmp_path, name, of, mode):
    schema = spark.read.parquet(f"{FOLDER}/events.parquet").schema
    stream = of(stamped(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(FOLDER)))
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    return spark.table(name)


def test_queue_states_of_a_stream_equal_the_table_s(spark, tmp_path):
    batch = item_states(queue_log(stamped(spark.read.parquet(f"{FOLDER}/events.parquet"))))
    stream = streamed(spark, tmp_path, "states", lambda df: item_states(queue_log(df)), "complete")
    assert sorted(map(str, stream.collect())) == sorted(map(str, batch.collect()))


def test_running_cells_of_a_stream_equal_the_table_s(spark, tmp_path):
    batch = running_cells(tax_changes(stamped(spark.read.parquet(f"{FOLDER}/events.parquet"))))
    twice = lambda df: running_cells(tax_changes(df).unionByName(tax_changes(df)))
    assert sorted(map(str, streamed(spark, tmp_path, "cells", twice, "complete").collect())) == sorted(map(str, batch.collect()))


def test_life_of_an_item(spark):
    rows = [(1, 1, 0, "populate", 0), (1, 2, 5, "claim", 0), (1, 3, 5, "claim", 0), (1, 3, 5, "heartbeat", 15), (1, 4, 6, "claim", 1), (1, 4, 6, "release", 2), (1, 5, 6, "claim", 1), (1, 5, 6, "complete", 2), (1, 6, 9, "heartbeat", 3)]
    log = spark.createDataFrame([(c, i, w, a, n) for n, (c, i, w, a, m) in enumerate(rows)], "county_id int, item int, worker int, action string, seq int")
    minutes = spark.createDataFrame([(n, m) for n, (*_, m) in enumerate(rows)], "seq int, m int")
    log = log.join(minutes, "seq").withColumn("ts", F.timestamp_seconds(F.col("m") * 60)).drop("m")
    state = queue_state(item_states(log), F.timestamp_seconds(F.lit(20 * 60)))
    assert {r["item"]: (r["status"], r["worker"]) for r in state.collect()} == {1: ("pending", None), 2: ("stale", 5), 3: ("claimed", 5), 4: ("pending", None), 5: ("done", None), 6: ("pending", None)}
    assert [tuple(r) for r in claims(state, 2, 2).orderBy("item").collect()] == [(1, 1, 0, 1), (1, 2, 0, 2), (1, 4, 1, 3), (1, 6, 1, 4)]


def test_load_resumes_and_stops_at_rejects(spark, tmp_path):
    source = T.StructType.fromDDL("id long, seq int, v string")
    result = T.StructType.fromDDL("id long, seq int, v string, processed boolean")
    rows_of = lambda df: df.withColumn("processed", F.when(F.col("v") == "", False))
    folder, target = f"{tmp_path}/in", f"{tmp_path}/out"

    def put(rows):
        spark.createDataFrame(rows, source).coalesce(1).write.mode("append").parquet(folder)

    def load(**kw):
        imports.load_files(spark, folder, source, target, f"{tmp_path}/state", rows_of, result, ["id"], "seq", **kw)
        return sorted((r["id"], r["v"]) for r in imports.current(spark, target).collect())

    put([(1, 1, "a"), (2, 1, "b")])
    put([(2, 2, "B")])
    assert load(max_files=1) == [(1, "a"), (2, "B")]
    assert load() == [(1, "a"), (2, "B")]
    put([(3, 1, ""), (4, 1, "d")])
    with pytest.raises(Exception, match="1 of 2 rows"):
        load(most_rejects=0.4)
    assert load() == [(1, "a"), (2, "B"), (3, ""), (4, "d")]


def test_files_rewrite_touched_buckets_only(spark, tmp_path):
    import os

    result = T.StructType.fromDDL("id long, seq int, v string")
    target = f"{tmp_path}/out"
    imports.create_target(spark, target, result)
    for number, (first, n) in enumerate(((0, 500), (0, 1), (0, 1), (0, 1))):
        imports.merge_batch(spark.range(first, first + n).select("id", F.lit(number).alias("seq"), F.lit(f"b{number}").alias("v")), target, number, ["id"], "seq")
    assert {(r.v, r["count"]) for r in imports.current(spark, target).groupBy("v").count().collect()} == {("b0", 499), ("b3", 1)}
    versions = [(d, b) for d in os.listdir(f"{target}/rows") if d.startswith("bucket") for b in os.listdir(f"{target}/rows/{d}") if b.startswith("batch") and b != "batch=-1"]
    assert len(versions) == imports.BUCKETS + 1  # the last version and one before it, of the touched bucket only


def test_pages_halve_stop_and_resume(spark, tmp_path):
    result = T.StructType.fromDDL("id long, v string, processed boolean")
    target, checkpoints, asked = f"{tmp_path}/out", f"{tmp_path}/state", []
    feed = {"n": 1500, "fails": lambda last, size: False, "refuses": lambda last, size: False}

    def fetch(last, size):
        asked.append((last, size))
        start = -1 if last is None else last
        rows = spark.range(start + 1, min(start + 1 + size, feed["n"])).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"), F.when(F.col("id") % 100 == 7, False).alias("processed"))
        if feed["refuses"](last, size):
            return rows.withColumn("v", F.udf(lambda v: (_ for _ in ()).throw(imports.Refused("403")))("v"))
        return rows.withColumn("v", F.raise_error(F.lit("too much")).cast("string")) if feed["fails"](last, size) else rows

    def run(**kw):
        return imports.import_pages(spark, "parcels", fetch, target, checkpoints, result, ["id"], "id", "id", **kw)

    feed["fails"] = lambda last, size: size > 300  # 1000, 500, 250
    feed["refuses"] = lambda last, size: last == 749
    with pytest.raises(imports.Stopped, match="refused 3 times"):
        run()
    assert asked == [(None, 1000), (None, 500), (None, 250), (249, 250), (499, 250), *[(749, 250)] * 3]
    p = imports.progress_of(spark, checkpoints, "parcels")
    assert (p.status, p.last_id, p.processed, p.failed, p.size) == ("STOPPED", 749, 750, 8, 250) and imports.current(spark, target).count() == 750
    feed["refuses"] = lambda last, size: False
    assert run().status == "COMPLETE" and imports.current(spark, target).count() == 1500
    with pytest.raises(imports.AlreadyComplete):
        run()
    feed["n"] = 1510
    assert (run(resume=True).processed, imports.current(spark, target).count()) == (1510, 1510)
    feed["n"], feed["fails"], asked[:] = 2000, lambda last, size: True, []
    with pytest.raises(imports.Stopped, match="failed at 100 records after 1509"):
        run(resume=True)
    assert [size for _, size in asked] == [250, 125, 100] and imports.progress_of(spark, checkpoints, "parcels").status == "FAILED"
