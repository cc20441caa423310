"""What earlier runs and batches kept, as an index that a new batch is checked against without reading it all again.

Two tables bucketed by what they are looked up by: digests, and the segment keys of
perceptual hashes. A batch is the only side of the joins that is shuffled; the index's
buckets stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import segment_keys
from ..storage import Written
from .dedup import NEAR_BITS, greedy

#: Buckets of a new index; at least the shuffle partitions of the sessions that use it, or these deal both sides anew.
BUCKETS = 256


class KnownFiles:
    """An index at a path; it is made where there is none, under the number of buckets and the distance that it keeps for good."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, distance: int = NEAR_BITS) -> None:
        self.spark, self.path, self.distance = spark, path.rstrip("/"), distance
        self.buckets = buckets
        stem = F.xxhash64(F.lit(self.path))
        tag = spark.range(1).select(F.hex(stem)).first()[0].lower()
        self.digests, self.keys = f"known_digests_{tag}", f"known_keys_{tag}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.digests} (sha256 STRING, batch BIGINT) USING parquet CLUSTERED BY (sha256) INTO {buckets} BUCKETS LOCATION '{self.path}/digests'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.keys} (key BIGINT, dhash BIGINT, batch BIGINT) USING parquet CLUSTERED BY (key) INTO {buckets} BUCKETS LOCATION '{self.path}/keys'")

    def _keyed(self, hashes: DataFrame, *columns: str) -> DataFrame:
        """A row for each segment key (the segments chosen and their bits) of each hash."""
        x = F.explode(segment_keys(F.col("dhash"), self.distance)).alias("x")
        key = F.call_function("shiftleft", F.col("x.mask").cast("bigint"), F.lit(32)).bitwiseOR(F.col("x.key"))
        return hashes.where("dhash is not null").select("dhash", *columns, x).select(key.alias("key"), "dhash", *columns)

    def same_digests(self, files: DataFrame, batch: int | None = None) -> DataFrame:
        """sha256 of those files that the index has; what this batch itself put there in an earlier try is left out."""
        mine = files.where("coalesce(sha256, '') <> ''").select("sha256").distinct()
        return mine.join(self._old(self.digests, batch), "sha256", "left_semi")

    def near_hashes(self, files: DataFrame, batch: int | None = None) -> DataFrame:
        """dhash of those files that have a hash of the index within the distance."""
        mine = self._keyed(files.select("dhash").distinct()).alias("m")
        old = self._old(self.keys, batch).alias("o")
        near = F.bit_count(F.col("m.dhash").bitwiseXOR(F.col("o.dhash"))) <= self.distance
        return mine.join(old, (F.col("m.key") == F.col("o.key")) & near, "left_semi").select("dhash").distinct()

    def _old(self, table: str, batch: int | None) -> DataFrame:
        rows = self.spark.table(table)
        return rows if batch is None else rows.where(F.col("batch") != batch)

    def add(self, kept: DataFrame, batch: int) -> None:
        """Put the digests and hashes of kept files into their buckets, a file a bucket."""
        digests = kept.where("coalesce(sha256, '') <> ''").select("sha256").distinct().withColumn("batch", F.lit(batch).cast("bigint"))
        digests.repartition(self.buckets, "sha256").write.mode("append").insertInto(self.digests)
        keys = self._keyed(kept.select("dhash").distinct().withColumn("batch", F.lit(batch).cast("bigint")), "batch")
        keys.repartition(self.buckets, "key").write.mode("append").insertInto(self.keys)

    def verdicts(self, files: DataFrame, order: str = "id", batch: int | None = None) -> DataFrame:
        """order and verdict of each file (order, sha256, dhash, status) by the greedy rule, after everything that the index has.

        What the index knows is dropped at once: it keeps nothing from anybody. The rest is
        judged among itself.
        """
        rows = Written(files.select(F.col(order).alias("_o"), F.nullif("sha256", F.lit("")).alias("sha256"), "dhash", "status"), "batch-files").df
        live = rows.where("status = 'ok'")
        sha = Written(self.same_digests(live, batch).withColumn("_same", F.lit(True)), "known-digests").df
        near = Written(self.near_hashes(live, batch).withColumn("_near", F.lit(True)), "known-hashes").df
        marked = Written(live.join(sha, "sha256", "left").join(near, "dhash", "left"), "marked-files").df
        known = F.when(F.col("_same"), F.lit("duplicate_sha256")).when(F.col("_near"), F.lit("near_duplicate"))
        gone = marked.where(known.isNotNull()).select("_o", known.alias("verdict"))
        open_ = marked.where(known.isNull()).select("_o", "sha256", "dhash", "status")
        fresh = greedy(open_, "_o", distance=self.distance).select("_o", "verdict")
        passed = rows.where("status <> 'ok' or status is null").select("_o", F.col("status").alias("verdict"))
        return gone.union(fresh).union(passed).withColumnRenamed("_o", order)

    def take(self, files: DataFrame, batch: int, order: str = "id") -> DataFrame:
        """The verdicts on a batch, whose kept files are in the index from then on; a batch that runs again gets the same."""
        out = Written(self.verdicts(files, order, batch), "batch-verdicts").df
        self.add(files.join(out.where("verdict = 'ok'").select(order), order, "left_semi").select("sha256", "dhash"), batch)
        return out

    def drop(self) -> None:
        """Forget the tables' names; the files stay."""
        for t in (self.digests, self.keys):
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
