"""A store of records by content, so that only new content is scanned again.

The store is Parquet, split by the first two characters of the hash. A record belongs to a hash and a path, so two files of
equal content keep their own paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.runtime import ordered_parts


def write(records: DataFrame, folder: str, now=None) -> None:
    stamped = records.withColumn("last_accessed", F.current_timestamp() if now is None else F.lit(now)).withColumn("shard", F.substring("content_hash", 1, 2))
    stamped.write.mode("append").partitionBy("shard").parquet(folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The newest record of each (content_hash, path)."""
    newest = Window.partitionBy("content_hash", "path").orderBy(F.desc("last_accessed"))
    return spark.read.option("ignoreCorruptFiles", True).parquet(folder).withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn", "shard")


def split(files: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): files whose content and path are in the store, and the others."""
    keys = store.select("content_hash", "path").distinct()
    return files.join(keys, ["content_hash", "path"], "left_semi"), files.join(keys, ["content_hash", "path"], "left_anti")


def rescan(files: DataFrame, store: DataFrame, scan) -> DataFrame:
    """Records of all files: those of hits from the store, those of misses from scan(misses)."""
    hits, misses = split(files, store)
    kept = store.join(hits.select("content_hash", "path").distinct(), ["content_hash", "path"], "left_semi")
    made = scan(misses)
    return kept.select(made.columns).unionByName(made)


def prune(store: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): records whose path still exists, and the others."""
    here = files.select("path").distinct()
    return store.join(here, "path", "left_semi"), store.join(here, "path", "left_anti")


def evict(store: DataFrame, max_bytes: int, size: str = "size") -> DataFrame:
    """Records that stay when the longest unused go until the sizes fit; of equal times those of the greater path go first.

    Records never used go first, and a null size counts as none. Parts of the order, cut by sampled bounds, are summed up; only in
    the part in which the budget ends are records looked at one by one, so equal times of a whole batch never meet in one task.
    """
    order = [F.desc_nulls_last("last_accessed"), F.asc("path")]
    bytes_of = F.coalesce(F.col(size), F.lit(0))
    parted = ordered_parts(store, order)
    sums = parted.groupBy("part").agg(F.sum(bytes_of).alias("_sum"))
    edges = sums.select("part", F.sum("_sum").over(Window.orderBy("part")).alias("_upto"), "_sum")  # one row per partition
    placed = parted.join(F.broadcast(edges), "part")
    whole = placed.where(F.col("_upto") <= max_bytes)
    border = placed.where((F.col("_upto") > max_bytes) & (F.col("_upto") - F.col("_sum") <= max_bytes))
    run = F.sum(bytes_of).over(Window.partitionBy("part").orderBy(*order))
    some = border.withColumn("_run", run).where(F.col("_upto") - F.col("_sum") + F.col("_run") <= max_bytes)
    return whole.select(*store.columns).unionByName(some.select(*store.columns))


def get(store: DataFrame, keys: DataFrame, now=None) -> tuple[DataFrame, DataFrame]:
    """(records, touched): the records of keys (content_hash, path), and the whole store with their last use set to now."""
    wanted = keys.select("content_hash", "path").distinct()
    stamp = F.current_timestamp() if now is None else F.lit(now)
    hit = store.join(wanted, ["content_hash", "path"], "left_semi").withColumn("last_accessed", stamp)
    return hit, hit.unionByName(store.join(wanted, ["content_hash", "path"], "left_anti"))


def remove(store: DataFrame, keys: DataFrame) -> DataFrame:
    """The store without the records of keys (content_hash)."""
    return store.join(keys.select("content_hash").distinct(), "content_hash", "left_anti")


def clear(spark: SparkSession, folder: str) -> int:
    """Delete all records; how many there were."""
    n = spark.read.option("ignoreCorruptFiles", True).parquet(folder).count()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def dry_run(store: DataFrame, action: str, reason: str) -> DataFrame:
    """(action, target, reason) of what a clear or prune would do."""
    return store.select(F.lit(action).alias("action"), F.col("content_hash").alias("target"), F.lit(reason).alias("reason"))


def stats(store: DataFrame, size: str = "size", max_bytes: int = 0) -> DataFrame:
    return store.agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).alias("disk_size_bytes"), F.lit(max_bytes).cast("long").alias("max_size_bytes"))


def hit_rate(hits: int, misses: int) -> float:
    return 100.0 * hits / (hits + misses) if hits + misses else 0.0
