"""A stored table of the newest snapshot of each key, kept up by the batches of a stream.

A batch writes whole new buckets of the keys that it touches and then a small commit that names them; readers take each
bucket from its newest commit, so they see a batch entirely or not at all. A batch whose commit exists is done: Spark may give it
again after a failure and nothing changes. A batch that failed before its commit is written over. Work is bounded by the touched
buckets, and keys are merged by a fold that takes the stored row of a key before the batch's rows in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators import registry


class StoredSnapshots:
    """Rows of `schema` (with valid, capability_version and resource_version) under `path`, one for each of keys."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.order, self.buckets = spark, path.rstrip("/"), schema, keys, order, buckets

    def exists(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def committed(self, batch_id: int) -> bool:
        return self.exists(f"{self.path}/commits/batch={batch_id}/_SUCCESS")

    def newest(self) -> dict[int, int]:
        """The newest batch of each bucket, as far as there is one: at most `buckets` entries."""
        if not self.exists(f"{self.path}/commits"):
            return {}
        commits = self.spark.read.schema("bucket int, batch long").parquet(f"{self.path}/commits")
        return {r.bucket: r.batch for r in commits.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}

    def read(self, only: set[int] | None = None) -> DataFrame:
        """The stored rows; only: those of some buckets. Other buckets' and older files aren't opened."""
        places = [f"{self.path}/data/batch={batch}/bucket={bucket}" for bucket, batch in sorted(self.newest().items()) if only is None or bucket in only]
        places = [p for p in places if self.exists(p)]  # a bucket none of whose rows was ever valid has no files
        return self.spark.read.schema(self.schema).parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Take a batch in; the function for foreachBatch."""
        if self.committed(batch_id):
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = batch.select(*self.schema.names)
        touched = {r[0] for r in rows.select(bucket.alias("b")).distinct().collect()}
        stored = self.read(touched).withColumn("_stored", F.lit(0))
        merged = registry.current_snapshots(stored.unionByName(rows.withColumn("_stored", F.lit(1))), self.keys, ["_stored", *self.order], self.schema)
        merged.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch_id}")
        commit = self.spark.createDataFrame([(b,) for b in sorted(touched)], "bucket int")
        commit.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch_id}")

    def clean(self, keep: int = 1) -> list[str]:
        """Delete batches' files that no bucket's newest `keep` commits name; the folders that went."""
        if not self.exists(f"{self.path}/commits"):
            return []
        commits = self.spark.read.schema("bucket int, batch long").parquet(f"{self.path}/commits")
        listed = commits.groupBy("bucket").agg(F.slice(F.sort_array(F.collect_set("batch"), asc=False), 1, keep).alias("kept")).collect()
        alive = {b for r in listed for b in r.kept}
        jvm, gone = self.spark.sparkContext._jvm, []
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        system = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for status in system.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("batch=") and int(name[6:]) not in alive and self.committed(int(name[6:])):
                system.delete(status.getPath(), True)
                gone.append(name)
        return gone
