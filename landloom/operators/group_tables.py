"""Owner groups and their members as stored tables, of which one county can be reset without touching the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.operators.staging import staged
from landloom.operators.tile_store import remove_folder

#: Buckets of group keys.
BUCKETS = 64


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("group_key"), F.lit(BUCKETS)).cast("int"))


class GroupTables:
    """members (group_key, parcel_id, county_id), a directory a county; groups (group_key, ...), a directory a bucket of keys. Every write replaces the directories it touches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def members(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/members")

    def groups(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/groups").drop("bucket")

    def _put(self, rows: DataFrame, name: str, by: str) -> None:
        rows.repartition(by, F.pmod(F.xxhash64("group_key", F.lit(1)), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{self.folder}/{name}")

    def write(self, members: DataFrame, groups: DataFrame) -> None:
        """Puts in the members of whole counties, and groups; old groups of the touched buckets whose key is not among the new ones stay."""
        new = staged(_bucketed(groups))
        if (old := self._bucket_rows(new)) is not None:
            new = staged(new.unionByName(old.join(new.select("group_key"), "group_key", "left_anti").select(*new.columns)))
        self._put(members, "members", "county_id")
        self._put(new, "groups", "bucket")

    def _bucket_rows(self, rows: DataFrame) -> DataFrame | None:
        """Stored groups of the buckets that rows are in (BUCKETS numbers at most, named in the scan's filter)."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/groups")
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return None
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]
        return self.spark.read.parquet(f"{self.folder}/groups").where(F.col("bucket").isin(touched))

    def reset(self, county: int | None = None) -> None:
        """Deletes all members and groups, or a county's members and then the groups that have none left.

        Only groups with members in the county can lose their last one: of these, an anti join with what other counties hold finds the orphans, and
        their buckets alone are written anew. A county without members changes nothing.
        """
        if county is None:
            for name in ("members", "groups"):
                remove_folder(self.spark, f"{self.folder}/{name}")
            return
        members = self.members()
        gone = staged(members.where(F.col("county_id") == county).select("group_key").distinct())
        rest = members.where(F.col("county_id") != county).select("group_key")
        orphans = staged(_bucketed(gone.join(rest, "group_key", "left_anti")))
        remove_folder(self.spark, f"{self.folder}/members/county_id={county}")
        stored = self._bucket_rows(orphans)
        kept = staged(stored.join(orphans.select("group_key"), "group_key", "left_anti"))
        for r in stored.select("bucket").distinct().join(kept.select("bucket").distinct(), "bucket", "left_anti").collect():
            remove_folder(self.spark, f"{self.folder}/groups/bucket={r['bucket']}")
        self._put(kept, "groups", "bucket")
