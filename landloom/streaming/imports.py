"""Resumable loads: files as a stream, and pages of a feed; each batch merged into a table by its key."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landloom.operators.staging import staged
from landloom.operators.tile_store import remove_folder
from landloom.operators.upserts import last_write_wins

#: Buckets of keys that a target is kept in.
BUCKETS = 32


class TooManyRejects(RuntimeError):
    """A batch held more rejected rows than allowed."""


class AlreadyComplete(RuntimeError):
    """A run of this name has ended; it goes on only if it is asked to resume."""


class Refused(RuntimeError):
    """The feed refuses to answer (as a site does with status 403). Raised in a task, it is known by its name in the job's error."""


class Stopped(RuntimeError):
    """A run that ended before its feed did."""


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _newest(spark: SparkSession, target: str, upto: int, among: Column | None = None) -> DataFrame:
    """Rows of each bucket as its newest batch, `upto` at most, left them."""
    versions = spark.read.parquet(f"{target}/rows").where(F.col("batch") <= upto)
    versions = versions.where(among) if among is not None else versions
    newest = versions.select("bucket", "batch").distinct().withColumn("last", F.max("batch").over(Window.partitionBy("bucket"))).where("batch = last").select("bucket", "batch")
    return versions.join(F.broadcast(newest), ["bucket", "batch"], "left_semi").drop("bucket", "batch")  # a row for each bucket


def _done(spark: SparkSession, target: str) -> int:
    return spark.read.parquet(f"{target}/done").agg(F.max("batch")).first()[0]


def current(spark: SparkSession, target: str) -> DataFrame:
    """The table after the last whole batch."""
    return _newest(spark, target, _done(spark, target))


def create_target(spark: SparkSession, target: str, result: T.StructType) -> None:
    """An empty table, if there is none."""
    if not _exists(spark, f"{target}/done"):
        spark.createDataFrame([], result).write.mode("overwrite").parquet(f"{target}/rows/bucket=0/batch=-1")
        spark.createDataFrame([(-1,)], "batch long").write.parquet(f"{target}/done")


def merge_batch(rows: DataFrame, target: str, number: int, keys: list[str], order: str) -> None:
    """Merges rows into the table as batch `number`: the last write of a key stands.

    Buckets that rows fall into are written as new versions beside the old ones, the others not at all; the batch counts
    when its number is put down at last. So a batch that breaks off changes nothing and can be done anew. Versions before the last but one are removed.
    """
    spark = rows.sparkSession
    new = staged(rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")))
    touched = [r[0] for r in new.select("bucket").distinct().collect()]  # BUCKETS numbers at most
    old = _newest(spark, target, min(number - 1, _done(spark, target)), F.col("bucket").isin(touched))
    merged = last_write_wins(old.unionByName(new.drop("bucket")), keys, order)
    dealt = merged.withColumns({"bucket": F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"), "batch": F.lit(number).cast("long")})
    dealt.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{target}/rows")
    spark.createDataFrame([(number,)], "batch long").write.mode("append").parquet(f"{target}/done")
    versions = spark.read.parquet(f"{target}/rows").where(F.col("bucket").isin(touched)).select("bucket", "batch").distinct()
    older = versions.withColumn("age", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("batch")))).where("age > 2 AND batch >= 0")
    for r in older.collect():
        remove_folder(spark, f"{target}/rows/bucket={r['bucket']}/batch={r['batch']}")


def load_files(spark: SparkSession, folder: str, source: T.StructType, target: str, checkpoint: str, rows_of: Callable[[DataFrame], DataFrame], result: T.StructType, keys: list[str], order: str, max_files: int | None = None, most_rejects: float = 1.0) -> None:
    """Merges Parquet files that are new in folder into target (result's columns; the last write of a key stands) and ends.

    rows_of makes result's columns of a batch. Files that a finished batch has read are
    never read again; a batch that failed is done anew and gives the same rows. max_files bounds a batch. A
    batch with more than a share of most_rejects rows with processed = false stops the load.
    """
    create_target(spark, target, result)
    reader = spark.readStream.schema(source)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def merge(batch: DataFrame, number: int) -> None:
        rows = rows_of(batch).select(*result.names)
        if most_rejects < 1 and "processed" in result.names:
            told = rows.agg(F.count("*").alias("n"), F.count_if(~F.col("processed")).alias("rejected")).first()
            if told["rejected"] > most_rejects * told["n"]:
                raise TooManyRejects(f"{told['rejected']} of {told['n']} rows")
        merge_batch(rows, target, number, keys, order)

    query = reader.parquet(folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


_CHECKPOINT = "name string, seq long, status string, last_id long, processed long, failed long, size int, at timestamp"


@dataclass
class Progress:
    """Where a run stands; size is the number of records asked for next."""

    seq: int = -1
    status: str = "NEW"
    last_id: int | None = None
    processed: int = 0
    failed: int = 0
    size: int = 1_000


def progress_of(spark: SparkSession, checkpoints: str, name: str) -> Progress:
    """The last checkpoint of a run."""
    if not _exists(spark, checkpoints):
        return Progress()
    last = spark.read.parquet(checkpoints).where(F.col("name") == name).orderBy(F.desc("seq")).first()
    return Progress(*(last[c] for c in ("seq", "status", "last_id", "processed", "failed", "size"))) if last else Progress()


def import_pages(spark: SparkSession, name: str, fetch: Callable[[int | None, int], DataFrame], target: str, checkpoints: str, result: T.StructType, keys: list[str], id_col: str, order: str, resume: bool = False, first_size: int = 1_000, least: int = 100, strikes: int = 3) -> Progress:
    """Imports a feed page by page: fetch(last_id, size) gives a DataFrame of up to so many records after an id, by id; one without rows ends the run.

    Each page is read by Spark, merged into target and put down as a checkpoint, from which a run that broke off goes on. A page that
    fails is asked for again at half the size, `least` at last, where a further failure stops the run. `strikes` refusals in a row stop it, too. A run that is COMPLETE is
    refused unless it is to resume, which looks for records after its last id. Rows with processed = false count as failed.
    """
    p = progress_of(spark, checkpoints, name)
    if p.status == "COMPLETE" and not resume:
        raise AlreadyComplete(name)
    create_target(spark, target, result)
    if p.status == "NEW":
        p.size = first_size

    def put_down(status: str) -> None:
        p.seq, p.status = p.seq + 1, status
        row = (name, p.seq, status, p.last_id, p.processed, p.failed, p.size)
        spark.createDataFrame([row], _CHECKPOINT.rpartition(",")[0]).withColumn("at", F.current_timestamp()).write.mode("append").parquet(checkpoints)

    refused = 0
    while True:
        try:
            rows = staged(fetch(p.last_id, p.size).select(*result.names))
        except Exception as e:  # what a job raises depends on where the feed fails
            if Refused.__name__ in f"{type(e).__name__}: {e}":
                refused += 1
                if refused >= strikes:
                    put_down("STOPPED")
                    raise Stopped(f"{name}: refused {refused} times") from e
            elif p.size > least:
                p.size = max(least, p.size // 2)
            else:
                put_down("FAILED")
                raise Stopped(f"{name}: failed at {p.size} records after {p.last_id}") from e
            continue
        refused = 0
        bad = F.count_if(~F.col("processed")) if "processed" in result.names else F.lit(0)
        n, failed, last = rows.agg(F.count("*"), bad, F.max(id_col)).first()
        if not n:
            put_down("COMPLETE")
            return p
        merge_batch(rows, target, _done(spark, target) + 1, keys, order)
        p.last_id, p.processed, p.failed = last, p.processed + n, p.failed + failed
        put_down("RUNNING")
