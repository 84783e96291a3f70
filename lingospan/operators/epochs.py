"""Training in epochs of mini-batches, with a validation after each and the best epoch kept.

Rows are encoded once and stored. Every epoch deals them anew over tasks in a seeded order; each task descends from
the same weights over its mini-batches, and the weights are averaged, each task's by its rows. What reaches the driver
is the averaged weights (classes x (features + 1) numbers, whatever the rows) and one row per language.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import Normalizer
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingospan.config import BATCH_SIZE, work_folder
from lingospan.operators import history
from lingospan.operators.evaluation import zero_shot_eval
from lingospan.operators.ordering import required_id, shuffle_key
from lingospan.operators.pairs import train_eval_frames
from lingospan.operators.scoring import score_pipeline
from lingospan.operators.transfer import pair_pipeline, save_model
from lingospan.schemas import NLI_LABELS, literal_frame

#: Rows that one task descends over, and numbers of the weights in one row of the shuffle that averages them.
ROWS_PER_PART, BLOCK = 1 << 16, 1 << 13
EPOCH_DDL = "epoch INT, steps BIGINT, avg_loss DOUBLE, val_accuracy DOUBLE"
EPOCH_LANG_DDL = "epoch INT, lang STRING, n BIGINT, correct BIGINT, accuracy DOUBLE, gap DOUBLE"
# How Spark ML stores a vector column: kind 0 is sparse, kind 1 dense.
VECTOR_DDL = "STRUCT<type: TINYINT, size: INT, indices: ARRAY<INT>, values: ARRAY<DOUBLE>>"


@dataclass
class EpochsResult:
    """The model of the best epoch, its number, and what every epoch gave.

    ``history`` has epoch, steps, avg_loss, val_accuracy, best_before and is_best; ``evaluation`` has epoch, lang, n,
    correct, accuracy, gap and is_best. Without an epoch above 0, ``best`` is None and the model is the last one.
    """

    model: PipelineModel
    best: int | None
    history: DataFrame
    evaluation: DataFrame


def linear_model(spark: SparkSession, weights: np.ndarray, features: str) -> LogisticRegressionModel:
    """A Spark ML classifier with the given weights: one row per class, the intercept last."""
    context, (classes, width) = spark.sparkContext, weights.shape
    matrix = DenseMatrix(classes, width - 1, weights[:, :-1].ravel(order="F"))
    java = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        "epochs", _py2java(context, matrix), _py2java(context, DenseVector(weights[:, -1])), classes, True
    )
    return LogisticRegressionModel(java).setFeaturesCol(features)


def descend_batch(
    weights: np.ndarray, labels: np.ndarray, owner: np.ndarray, index: np.ndarray, value: np.ndarray, rate: float, decay: float
) -> float:
    """One step of softmax regression on a mini-batch, in place; the mean loss before the step.

    The batch is sparse: entry j of row ``owner[j]`` has the feature ``index[j]`` and ``value[j]``.
    """
    n, classes = len(labels), len(weights)
    scores = np.stack([np.bincount(owner, value * weights[k, index], n) + weights[k, -1] for k in range(classes)])
    scores -= scores.max(axis=0)
    logs = scores - np.log(np.exp(scores).sum(axis=0))
    slope = np.exp(logs)
    slope[labels, np.arange(n)] -= 1
    weights[:, :-1] *= 1 - rate * decay
    for k in range(classes):
        np.subtract.at(weights[k], index, rate / n * slope[k, owner] * value)
    weights[:, -1] -= rate * slope.mean(axis=1)
    return float(-logs[labels, np.arange(n)].mean())


def _stored(df: DataFrame, name: str) -> str:
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return path


def _one_epoch(
    rows: DataFrame, weights: np.ndarray, parts: int, batch_size: int, rate: float, decay: float, key
) -> tuple[np.ndarray, int, float]:
    """The averaged weights after one pass over ``rows``, the steps made and their mean loss."""
    start = rows.sparkSession.sparkContext.broadcast(weights)
    shape = weights.shape

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, steps, loss, place = start.value.copy(), 0, 0, 0.0, None
        left: pa.Table | None = None

        def walk(table: pa.Table) -> None:
            nonlocal seen, steps, loss
            labels = table.column("label").to_numpy().astype(np.int64)
            lists = [table.column(c).combine_chunks() for c in ("indices", "values")]
            sizes = lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            index, value = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            for at in range(0, len(labels), batch_size):
                to = min(at + batch_size, len(labels))
                cut = slice(ends[at], ends[to])
                owner = np.repeat(np.arange(to - at), sizes[at:to])
                loss += descend_batch(own, labels[at:to], owner, index[cut], value[cut], rate, decay)
                steps += 1
            seen += len(labels)

        for batch in batches:
            if not len(batch):
                continue
            place = batch.column(0)[0].as_py() if place is None else place
            table = pa.Table.from_batches([batch])
            table = table if left is None else pa.concat_tables([left, table])
            whole = len(table) - len(table) % batch_size
            if whole:
                walk(table.slice(0, whole))
            left = table.slice(whole)
        if left is not None and len(left):
            walk(left)
        flat = own.ravel()
        for block in range(0, len(flat) if seen else 0, BLOCK):
            columns = [[block], [place], [seen], [steps], [loss], [flat[block : block + BLOCK]]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["block", "place", "n", "steps", "loss", "weights"],
            )

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come by block, and in it by place, so that sums do not depend on the order of arrival.
        block, total, n, steps, loss = None, None, 0, 0, 0.0

        def done() -> pa.RecordBatch:
            arrays = [pa.array([block], pa.int32()), pa.array([steps], pa.int64()), pa.array([loss], pa.float64())]
            arrays.append(pa.array([total / n], pa.list_(pa.float64())))
            return pa.RecordBatch.from_arrays(arrays, ["block", "steps", "loss", "weights"])

        for batch in batches:
            for row in range(len(batch)):
                own = batch.column(5)[row].values.to_numpy()
                if batch.column(0)[row].as_py() != block:
                    if block is not None:
                        yield done()
                    block, total, n, steps, loss = batch.column(0)[row].as_py(), np.zeros(len(own)), 0, 0, 0.0
                count = batch.column(2)[row].as_py()
                total += count * own
                n, steps, loss = n + count, steps + batch.column(3)[row].as_py(), loss + batch.column(4)[row].as_py()
        if block is not None:
            yield done()

    made = (
        rows.withColumn("key", key).select("key", "example_id", "label", "indices", "values")
        .repartition(parts, "key").sortWithinPartitions("key", "example_id")
        .mapInArrow(descend, "block int, place bigint, n bigint, steps bigint, loss double, weights array<double>")
        .repartition("block").sortWithinPartitions("block", "place")
        .mapInArrow(average, "block int, steps bigint, loss double, weights array<double>")
    )
    # One row per block of weights.
    blocks = sorted(made.collect(), key=lambda r: r.block)
    start.destroy()
    flat = np.concatenate([np.asarray(r["weights"]) for r in blocks])
    return flat.reshape(shape), blocks[0].steps, blocks[0].loss / blocks[0].steps


def train_epochs(
    pairs: DataFrame,
    languages: Sequence[str],
    source_lang: str = "en",
    train_split: str = "train",
    eval_split: str = "validation",
    names: Sequence[str] = NLI_LABELS,
    epochs: int = 3,
    batch_size: int = BATCH_SIZE,
    rate: float = 2.0,
    decay: float = 1e-5,
    seed: int = 0,
    parts: int | None = None,
    num_features: int = 1 << 14,
    save_to: str | None = None,
) -> EpochsResult:
    """Train on the source language, evaluate every language after each epoch, keep the best epoch's model.

    The best is the first with the highest accuracy on the source language's evaluation rows, above 0; with ``save_to``
    it is saved as soon as it is found. The step is ``rate`` / sqrt(epoch). Rows are dealt over ``parts`` tasks, by
    default one for each 65,536 rows; the same rows, seed and parts give the same model on any cluster. A null id, or a
    label that is no class, fails the job; so does an empty training split. Null texts count as empty.
    """
    spark, classes = pairs.sparkSession, len(names)
    train, test = train_eval_frames(pairs, source_lang, languages, train_split, eval_split)
    # Feature stages only: the classifier is trained here.
    stages = pair_pipeline(num_features).getStages()[:-1]
    encoder = PipelineModel([*stages, Normalizer(inputCol="features", outputCol="unit")])
    texts = {c: F.coalesce(c, F.lit("")) for c in ("premise", "hypothesis")}
    known = F.col("label").between(0, classes - 1)
    wrong = F.raise_error(F.concat(F.lit("no class: "), F.coalesce(F.col("label").cast("string"), F.lit("null"))))
    labelled = F.when(known, F.col("label").cast("int")).otherwise(wrong.cast("int"))
    train = train.select(required_id(train, "example_id").cast("long").alias("example_id"), labelled.alias("label"), *texts)
    train = train.withColumns(texts)
    path = _stored(encoder.transform(train).select("example_id", "label", "unit"), "epochs-train")
    vector = spark.read.schema(f"example_id BIGINT, label INT, unit {VECTOR_DDL}").parquet(path)
    dense = F.col("unit.type") == 1
    rows = vector.select(
        "example_id", "label", F.col("unit.values").alias("values"),
        F.when(dense, F.sequence(F.lit(0), F.col("unit.size") - 1)).otherwise(F.col("unit.indices")).alias("indices"),
    )
    size = vector.agg(F.count("*").alias("n"), F.max("unit.size").alias("width")).first()
    if not size.n:
        raise ValueError(f"no rows of {source_lang} in the split {train_split}")
    parts = parts or -(-size.n // ROWS_PER_PART)
    held = encoder.transform(test.select("lang", "label", *texts).withColumns(texts))
    held = spark.read.parquet(_stored(held.select("lang", F.col("label").alias("gold_label"), "unit"), "epochs-test"))

    weights, model, best, most = np.zeros((classes, size.width + 1)), None, None, 0.0
    log, by_language = [], []
    for epoch in range(1, epochs + 1):
        key = shuffle_key("example_id", seed, epoch)
        weights, steps, loss = _one_epoch(rows, weights, parts, batch_size, rate / epoch**0.5, decay, key)
        classifier = linear_model(spark, weights, "unit")
        scored = score_pipeline(held, PipelineModel([classifier]), names)
        table = zero_shot_eval(scored, languages, source_lang).collect()  # one row per language
        by_language += [(epoch, r.lang, r.n, r.correct, r.accuracy, r.gap) for r in table]
        reached = next((r.accuracy for r in table if r.lang == source_lang), None) or 0.0
        log.append((epoch, steps, loss, reached))
        if reached > most:
            best, most = epoch, reached
        if best in (epoch, None):
            model = PipelineModel([*encoder.stages, classifier])
        if best == epoch and save_to:
            save_model(model, save_to)
    epochs_log = history.best_epoch(literal_frame(spark, log, EPOCH_DDL))
    evaluation = literal_frame(spark, by_language, EPOCH_LANG_DDL).join(epochs_log.select("epoch", "is_best"), "epoch")
    return EpochsResult(model, best, epochs_log, evaluation)
