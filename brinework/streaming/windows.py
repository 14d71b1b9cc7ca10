"""Structured Streaming forms: extensions, as the batch plans have no stream of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..tables import latest_per_key


def parts_stream(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 64) -> DataFrame:
    """Immutable parts as a stream: only files not seen before are read (ST-01)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and totals per key and window; rows later than ``late`` are let go, so state stays bounded."""
    span = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(key, span.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there and stops; a later run goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return query


def upsert_latest(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str, keys: list[str], time: str) -> StreamingQuery:
    """Latest state per key (ST-05): each batch is merged into a new version of the table, then the version is named.

    Versions are numbered by batch, so a batch that is run again writes the
    same version; the one before is kept for that, older ones are deleted.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch
        if number > 0:
            rows = rows.unionByName(batch.sparkSession.read.parquet(f"{out}/v{number - 1}"))
        latest_per_key(rows, keys, time).write.mode("overwrite").parquet(f"{out}/v{number}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/v{number - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
