"""Files that arrive in a folder, scanned as they come, into a store of records: an extension of the incremental store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from codeloom.extract import scanner
from codeloom.operators import cache


def ingest(spark: SparkSession, folder: str, schema: str, store: str, checkpoint: str, status: str = "built") -> StreamingQuery:
    """Read Parquet files of files (path, language, content, …) as they arrive, scan them and append their records to the store.

    Each batch is written once per batch id that the checkpoint has not yet seen; a batch that runs again appends equal
    records, of which the store's reader takes one.
    """
    arrived = spark.readStream.schema(schema).parquet(folder)

    def put(batch: DataFrame, _: int) -> None:
        cache.write(scanner.ir_files(batch, status), store)

    return arrived.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(files: DataFrame, time: str = "mtime", window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window, language, n_files) of a stream of files; files later than the watermark no longer count."""
    from pyspark.sql import functions as F

    return files.withWatermark(time, late).groupBy(F.window(time, window), "language").agg(F.count("*").alias("n_files"))
