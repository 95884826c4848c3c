"""Resume by file source: each exported capture is read once, and recorded once, whatever happens between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sealcheck.sources.packets import numbered, split_unreadable


def new_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming lines of packet exports with one packet per line; a batch holds whole files."""
    lines = spark.readStream.schema("value string").format("text").load(folder)
    return lines.filter(F.col("value").contains("{")).select(
        F.col("_metadata.file_path").alias("capture"),
        F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("json"))


def run_pending(spark: SparkSession, folder: str, checkpoint: str, handle) -> None:
    """Process what arrived since the last run, then stop. ``handle(packets, batch_id)``."""
    def placed(lines: DataFrame, batch_id: int) -> None:
        handle(split_unreadable(numbered(lines))[0], batch_id)

    query = (new_lines(spark, folder).writeStream.foreachBatch(placed)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def record_batch(records: DataFrame, folder: str, batch_id: int) -> None:
    """Write a batch's records (path, ...) below ``folder``. A replay of the batch takes the place of what the broken run left.

    A batch that a killed run wrote, but whose end the checkpoint never noted, is given out again with the same number and the same
    files, so the folder of the batch is the key and no record is there twice.
    """
    records.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all batches that were written to their end, and the ``batch`` of each."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=*/_SUCCESS")
    done = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    whole = [status.getPath().getParent().toString() for status in done]
    return spark.read.option("basePath", folder).parquet(*whole)


def run_recorded(spark: SparkSession, folder: str, checkpoint: str, records: str, analyse) -> None:
    """Analyse what arrived since the last run and record it. ``analyse(packets)`` returns a row per capture."""
    run_pending(spark, folder, checkpoint, lambda packets, batch_id: record_batch(analyse(packets), records, batch_id))
