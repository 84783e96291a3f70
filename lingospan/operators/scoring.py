"""Scoring of text pairs with logits already in the table, a fitted pipeline, or a user's model."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingospan.config import BATCH_SIZE
from lingospan.functions import vectors
from lingospan.functions.labels import decode_label
from lingospan.functions.worker import kept
from lingospan.operators.pairs import validate_pairs
from lingospan.schemas import NLI_LABELS

# A model takes the premises and hypotheses of a batch (hypotheses is None for single texts) and gives
# an array of logits, one row per text and one column per class.
Model = Callable[[pd.Series, "pd.Series | None"], np.ndarray]
ModelLoader = Callable[[], Model]

SCORE_COLUMNS = ["probs", "predicted_label", "predicted_name", "confidence"]


def _predictions(df: DataFrame, probs: Column, values: Sequence[Column], names: Sequence[str]) -> DataFrame:
    """Add the prediction columns; rows whose status is not ``ok`` get NULL, bad numbers give ``error``."""
    status = F.col("status") if "status" in df.columns else F.lit("ok")
    status = F.when((status == "ok") & vectors.has_bad_value(values), "error").otherwise(status)
    df = df.withColumn("status", status)
    ok = F.col("status") == "ok"
    return df.withColumns(
        {"probs": F.when(ok, probs), "predicted_label": F.when(ok, vectors.argmax(values))}
    ).withColumns(
        {
            "predicted_name": decode_label("predicted_label", names),
            "confidence": vectors.confidence("probs"),
        }
    )


def score_logits(df: DataFrame, logits: Sequence[str] | str, names: Sequence[str] = NLI_LABELS) -> DataFrame:
    """Score from logit columns, or from one array column of logits."""
    if isinstance(logits, str):
        values = vectors.class_columns(logits, len(names))
    else:
        values = [F.col(c).cast("double") for c in logits]
    return _predictions(df, vectors.softmax(values), values, names)


def score_pipeline(df: DataFrame, model: PipelineModel, names: Sequence[str] = NLI_LABELS) -> DataFrame:
    """Score with a fitted Spark ML pipeline that gives a ``probability`` vector."""
    scored = model.transform(df).withColumn("_probs", vector_to_array("probability"))
    scored = scored.select(*df.columns, "_probs")
    values = vectors.class_columns("_probs", len(names))
    return _predictions(scored, F.array(*values), values, names).drop("_probs")


def model_key(loader: ModelLoader) -> str:
    """The same for loaders that are pickled alike, whatever call they come with."""
    return hashlib.sha256(cloudpickle.dumps(loader)).hexdigest()


def score_callable(
    df: DataFrame,
    loader: ModelLoader,
    names: Sequence[str] = NLI_LABELS,
    premise: str = "premise",
    hypothesis: str | None = "hypothesis",
    batch_size: int = BATCH_SIZE,
    timed: bool = False,
    weight: float = 1.0,
) -> DataFrame:
    """Score with a user's model: loaded once per Python worker, called on ``batch_size`` texts at a time.

    Rows whose status is not ``ok`` are not sent to the model. A batch on which the model raises gets the
    status ``error`` and the message in ``error``; the job goes on. ``timed`` adds ``latency_ms``, the
    time of the batch divided by its rows.

    Only the texts and the status travel to Python. A worker holds several models at a time, known by their pickled
    loaders, as long as their ``weight`` fits (``worker.CAPACITY``): two models used in turn are loaded once each.
    """
    if "status" not in df.columns:
        df = df.withColumn("status", F.lit("ok"))
    num_classes, pair, key = len(names), hypothesis is not None, model_key(loader)

    @F.pandas_udf("logits ARRAY<DOUBLE>, error STRING, latency_ms DOUBLE")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        model = kept(("model", key), loader, weight)
        for status, first, *second in batches:
            n = len(status)
            values = np.full((n, num_classes), np.nan)
            scored = np.zeros(n, dtype=bool)
            errors, spent = np.full(n, None, dtype=object), np.full(n, np.nan)
            valid = np.flatnonzero((status == "ok").to_numpy())
            for start in range(0, len(valid), batch_size):
                rows = valid[start : start + batch_size]
                began = time.perf_counter()
                try:
                    found = np.asarray(model(first.iloc[rows], second[0].iloc[rows] if pair else None), dtype=float)
                    if found.shape != (len(rows), num_classes):
                        raise ValueError(f"model gave shape {found.shape}")
                except Exception as problem:
                    errors[rows] = str(problem)
                else:
                    values[rows], scored[rows] = found, True
                spent[rows] = (time.perf_counter() - began) * 1000 / len(rows)
            logits = pd.Series(list(values), dtype=object).where(scored, None)
            yield pd.DataFrame({"logits": logits, "error": errors, "latency_ms": spent})

    # Evaluated once, and not again inside a filter on what it gives.
    texts = [F.col(c) for c in (premise, hypothesis) if c is not None]
    scored = df.withColumn("_scored", score.asNondeterministic()(F.col("status"), *texts))
    added = {"error": F.col("_scored.error"), "status": F.when(F.col("_scored.error").isNull(), F.col("status")).otherwise("error")}
    if timed:
        # A row that was not sent to the model has no time.
        spent = F.col("_scored.latency_ms")
        added["latency_ms"] = F.when(~F.isnan(spent), spent)
    scored = scored.withColumn("logits", F.col("_scored.logits")).withColumns(added).drop("_scored")
    values = vectors.class_columns("logits", num_classes)
    return _predictions(scored, vectors.softmax(values), values, names).drop("logits")


def score_pairs(
    df: DataFrame,
    scorer: Sequence[str] | str | PipelineModel | ModelLoader,
    names: Sequence[str] = NLI_LABELS,
    validate: bool = False,
    **options,
) -> DataFrame:
    """Add ``status``, ``probs``, ``predicted_label``, ``predicted_name`` and ``confidence``.

    ``scorer`` is the logit columns (or one array column), a fitted ``PipelineModel``, or a function that
    loads a model. ``validate`` strips the texts first and keeps blank ones away from the model.
    """
    if validate:
        df = validate_pairs(df, options.get("premise", "premise"), options.get("hypothesis", "hypothesis"))
    if isinstance(scorer, PipelineModel):
        return score_pipeline(df, scorer, names)
    if callable(scorer):
        return score_callable(df, scorer, names, **options)
    return score_logits(df, scorer, names)


def latency_summary(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Scored rows and the median and 95th percentile of milliseconds per row."""
    return (
        scored.where(F.col("latency_ms").isNotNull())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.percentile_approx("latency_ms", 0.5).alias("p50_ms"),
            F.percentile_approx("latency_ms", 0.95).alias("p95_ms"),
        )
    )


def confidence_rows(df: DataFrame, names: Sequence[str], probs: str = "probs", key: str = "example_id") -> DataFrame:
    """One row per example and class with the probability in percent."""
    return df.select(key, F.posexplode(probs).alias("class_id", "p")).select(
        key, decode_label("class_id", names).alias("label"), (F.col("p") * 100).alias("confidence")
    )
