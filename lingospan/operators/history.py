"""Training history: mean loss per epoch, best epoch so far."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lingospan.schemas import TRAIN_LOG_DDL, literal_frame


def epoch_loss(log: DataFrame) -> DataFrame:
    """Mean loss over the steps of each epoch."""
    return log.groupBy("epoch").agg(F.count("*").alias("steps"), F.avg("loss").alias("avg_loss"))


def best_epoch(epochs: DataFrame, run: str | None = None) -> DataFrame:
    """Add the best accuracy of the epochs before and whether this epoch beats it (strictly, from 0).

    The window spans the epochs of one training run.
    """
    window = Window.partitionBy(*([run] if run else [])).orderBy("epoch")
    before = F.max("val_accuracy").over(window.rowsBetween(Window.unboundedPreceding, -1))
    return epochs.withColumn("best_before", F.greatest(F.lit(0.0), F.coalesce(before, F.lit(0.0)))).withColumn(
        "is_best", F.col("val_accuracy") > F.col("best_before")
    )


def training_log(spark: SparkSession, losses: Sequence[float], epoch: int = 1) -> DataFrame:
    """The objective after each iteration of a fit, as a log table."""
    return literal_frame(spark, [(epoch, step, loss) for step, loss in enumerate(losses)], TRAIN_LOG_DDL)
