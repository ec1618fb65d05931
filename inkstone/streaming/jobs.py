"""Job streams: source, idempotent processing, stale redelivery, dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def job_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A file source that takes a bounded number of files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def exactly_once(stream: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """Drop redeliveries of a key within a watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Process what is there and stop; a batch that fails is handled again from the checkpoint."""
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def idempotent_sink(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """Each micro-batch owns a folder that it overwrites, so handling it again changes nothing."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return handle


def dead_letters(path: str, most: int = 400) -> Callable[[DataFrame, int], None]:
    """Append a micro-batch's dead jobs: ``job_id, error_class, message`` (cut) and ``failed_at``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        cut = F.substring("message", 1, most).alias("message")
        batch.select("job_id", "error_class", cut, "failed_at").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return handle


def stale(pending: DataFrame, now_ms: int, idle_ms: int = 30_000, most: int = 50) -> DataFrame:
    """Deliveries idle for too long, the oldest first, with their count raised."""
    old = pending.where(F.lit(now_ms) - F.col("delivered_ms") > idle_ms).orderBy("delivered_ms", "id").limit(most)
    return old.withColumn("deliveries", F.col("deliveries") + 1)


def to_process(messages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Messages of jobs that are neither done nor dead, one for each job."""
    done = jobs.where(F.col("status").isin("SUCCEEDED", "DEAD")).select("id")
    return messages.dropDuplicates(["id"]).join(done, "id", "left_anti")
