"""Epochs of mini-batches against a dense plain version, and the best epoch kept."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingospan.operators import epochs, history, scoring, transfer
from lingospan.operators.ordering import shuffle_key
from lingospan.schemas import PAIRS_DDL, literal_frame


def pairs_of(spark, n=300, seed=0):
    rng = random.Random(seed)
    cue = {0: "yes indeed", 1: "maybe so", 2: "not never"}
    rows = []
    for i in range(n):
        label = rng.choice([0, 0, 0, 1, 2])
        split, lang = rng.choice(["train", "train", "validation"]), rng.choice(["en", "en", "de"])
        rows.append([i, split, lang, f"text {rng.randint(0, 9)}", f"{cue[label]} {rng.randint(0, 9)}", label])
    return literal_frame(spark, rows, PAIRS_DDL)


def dense_epoch(parts, weights, batch_size, rate, decay):
    """Each part's rows are (features, label); the weights averaged by rows, and the losses of all steps."""
    total, n, losses = 0, 0, []
    for rows in parts:
        own = weights.copy()
        for at in range(0, len(rows), batch_size):
            x = np.array([np.append(f, 1.0) for f, _ in rows[at : at + batch_size]])
            y = np.eye(len(weights))[[label for _, label in rows[at : at + batch_size]]]
            scores = np.exp(x @ own.T)
            p = scores / scores.sum(axis=1, keepdims=True)
            losses.append(-np.log((p * y).sum(axis=1)).mean())
            own[:, :-1] *= 1 - rate * decay
            own -= rate * (p - y).T @ x / len(x)
        total, n = total + len(rows) * own, n + len(rows)
    return total / n, losses


@pytest.mark.parametrize(("parts", "batch_size"), [(1, 16), (3, 7), (9, 64)])
def test_one_epoch_equals_dense_descent(spark, parts, batch_size):
    rng = np.random.default_rng(1)
    width, rows = 40, []
    for i in range(150):
        index = np.sort(rng.choice(width, rng.integers(0, 8), replace=False))
        rows.append((i, int(rng.integers(0, 3)), index.tolist(), rng.normal(size=len(index)).tolist()))
    df = spark.createDataFrame(rows, "example_id BIGINT, label INT, indices ARRAY<INT>, values ARRAY<DOUBLE>")
    key = shuffle_key("example_id", 5, 2)
    dealt = df.withColumn("key", key).repartition(parts, "key").withColumn("part", F.spark_partition_id())
    groups = {}
    for r in sorted(dealt.collect(), key=lambda r: (r.part, r.key, r.example_id)):
        features = np.zeros(width)
        features[r["indices"]] = r["values"]
        groups.setdefault(r.part, []).append((features, r.label))
    start = rng.normal(size=(3, width + 1))
    want, losses = dense_epoch(groups.values(), start, batch_size, 0.7, 0.01)
    got, steps, loss = epochs._one_epoch(df, start, parts, batch_size, 0.7, 0.01, key)
    assert np.allclose(got, want, rtol=1e-12, atol=1e-12)
    assert steps == len(losses) and loss == pytest.approx(np.mean(losses))


def test_weights_in_several_blocks(spark, monkeypatch):
    rows = [(i, i % 3, [i % 20], [1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "example_id BIGINT, label INT, indices ARRAY<INT>, values ARRAY<DOUBLE>")
    key = shuffle_key("example_id")
    whole = epochs._one_epoch(df, np.zeros((3, 21)), 2, 8, 0.5, 0.0, key)
    monkeypatch.setattr(epochs, "BLOCK", 10)
    cut = epochs._one_epoch(df, np.zeros((3, 21)), 2, 8, 0.5, 0.0, key)
    assert np.array_equal(whole[0], cut[0]) and whole[1:] == cut[1:]


def test_best_epoch_is_kept_and_saved(spark, tmp_path):
    pairs, path = pairs_of(spark), str(tmp_path / "best")
    settings = dict(epochs=4, rate=4.0, parts=2, num_features=256)
    result = epochs.train_epochs(pairs, ["en", "de"], save_to=path, **settings)
    log = result.history.orderBy("epoch").collect()
    assert [r.epoch for r in log] == [1, 2, 3, 4] and log[-1].avg_loss < log[0].avg_loss
    accuracies = [r.val_accuracy for r in log]
    assert result.best == 1 + accuracies.index(max(accuracies)) and max(accuracies) > 0.9
    assert [r.epoch for r in log if r.is_best][-1] == result.best
    table = {(r.epoch, r.lang): r for r in result.evaluation.collect()}
    assert len(table) == 8 and all(table[r.epoch, "en"].accuracy == r.val_accuracy for r in log)
    # The kept and the saved model give what was measured in the best epoch.
    test = pairs.where("split = 'validation'")
    for model in (result.model, transfer.load_model(path)):
        scored = scoring.score_pairs(test, model).where("lang = 'en'")
        assert scored.where("predicted_label = label").count() == table[result.best, "en"].correct
    again = epochs.train_epochs(pairs.repartition(5), ["en", "de"], **settings)
    assert again.history.orderBy("epoch").collect() == log
    steps = log[0].steps
    assert history.best_epoch(result.history.select("epoch", "val_accuracy")).count() == 4 and steps > 0


def test_later_worse_epoch_does_not_replace_the_best(spark, tmp_path, monkeypatch):
    right = np.zeros((3, 34))
    right[0, -1] = 1.0  # always the first class, which is the commonest
    wrong = np.roll(right, 1, axis=0)
    made = iter([(right, 1, 0.5), (wrong, 1, 0.9), (right, 1, 0.5)])
    monkeypatch.setattr(epochs, "_one_epoch", lambda *a: next(made))
    result = epochs.train_epochs(pairs_of(spark, 80), ["en", "de"], num_features=15, save_to=str(tmp_path / "m"))
    flags = [r.is_best for r in result.history.orderBy("epoch").collect()]
    assert result.best == 1 and flags == [True, False, False]
    for model in (result.model, transfer.load_model(str(tmp_path / "m"))):
        assert np.array_equal(model.stages[-1].interceptVector.toArray(), right[:, -1])


def test_odd_training_tables(spark):
    base = pairs_of(spark, 60)
    odd = base.withColumn("premise", F.when(F.col("example_id") % 2 == 0, F.col("premise"))).withColumn(
        "hypothesis", F.when(F.col("example_id") % 3 == 0, F.lit("")).otherwise(F.col("hypothesis"))
    )
    long = literal_frame(spark, [[1000, "train", "en", "word " * 50_000, "w" * 100_000, 2]], PAIRS_DDL)
    result = epochs.train_epochs(odd.unionByName(long).unionByName(long), ["en", "xx"], epochs=1, num_features=64)
    table = {r.lang: r for r in result.evaluation.collect()}
    assert table["xx"].n == 0 and table["xx"].accuracy is None and table["en"].n > 0
    with pytest.raises(ValueError, match="no rows of"):
        epochs.train_epochs(base.where("lang = 'de'"), ["en"], num_features=64)
    with pytest.raises(Exception, match="no class"):
        epochs.train_epochs(base.withColumn("label", F.lit(7)), ["en"], num_features=64)
    with pytest.raises(Exception, match="no class"):
        epochs.train_epochs(base.withColumn("label", F.lit(None).cast("int")), ["en"], num_features=64)
    # Nothing to validate on: no epoch is best, the last model is given.
    none = epochs.train_epochs(base.where("split = 'train'"), ["en"], epochs=2, num_features=64)
    assert none.best is None and none.model is not None and none.history.where("is_best").isEmpty()
