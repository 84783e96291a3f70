"""Scoring and accuracy over pairs that keep arriving."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lingospan.operators.scoring import score_pairs
from lingospan.schemas import NLI_LABELS
from lingospan.sources import versions


def read_pair_stream(
    spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None
) -> DataFrame:
    """New Parquet files under a folder or glob, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def score_stream(stream: DataFrame, scorer, names: Sequence[str] = NLI_LABELS, **options) -> DataFrame:
    """Validate and score each pair; no state, so any trigger gives what a batch job would."""
    return score_pairs(stream, scorer, names, validate=True, **options)


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet table, process all that is there, then stop. Restarts where it left off."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def running_accuracy(stream: DataFrame, lang: str = "lang") -> DataFrame:
    """Accuracy per language over all labelled arrivals; the state is one row per language."""
    right = F.count_if(F.col("predicted_label") == F.col("gold_label"))
    return (
        stream.groupBy(lang)
        .agg(F.count("*").alias("n"), right.alias("correct"))
        .withColumn("accuracy", F.try_divide(F.col("correct").cast("double"), F.col("n")))
    )


def publish_totals(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Replace the table at ``path`` by the current totals after each batch of arrivals.

    The folder is overwritten in place; ``publish_versions`` leaves readers no moment without a table.
    """
    return (
        totals.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
        .trigger(availableNow=True)
        .start()
    )


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps as long as its checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first().value)["id"]


def publish_versions(totals: DataFrame, path: str, checkpoint: str, keep: int = 2) -> StreamingQuery:
    """Publish the current totals as a new version of the table at ``path`` after each batch of arrivals.

    ``versions.read_current`` reads them at any moment. A version is named by the stream's id and the batch, so a batch
    that is repeated after a restart is published once, and a stream with a new checkpoint goes on after the versions of
    the old one.
    """
    spark = totals.sparkSession

    def publish(batch: DataFrame, number: int) -> None:
        if not versions.publish(batch, path, f"{stream_id(spark, checkpoint)}-{number}", keep):
            # Committed before a stop: the stream's state still needs the batch to be processed.
            batch.write.format("noop").mode("overwrite").save()

    return (
        totals.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(publish)
        .trigger(availableNow=True)
        .start()
    )
