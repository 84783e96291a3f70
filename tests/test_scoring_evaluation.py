import math
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lingospan.functions import worker
from lingospan.operators import evaluation, history, scoring, transfer
from lingospan.schemas import language_dim, literal_frame

# Models defined in this file travel to the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAIRS = "example_id BIGINT, premise STRING, hypothesis STRING"


def test_logits_and_bad_values(spark):
    rows = [[1, 0.0, 1.0, 2.0], [2, float("nan"), 1.0, 0.0], [3, None, 1.0, 0.0], [4, 5.0, 5.0, 1.0]]
    df = literal_frame(spark, rows, "example_id BIGINT, a DOUBLE, b DOUBLE, c DOUBLE")
    got = {r.example_id: r for r in scoring.score_pairs(df, ["a", "b", "c"]).collect()}
    assert got[1].predicted_name == "contradiction" and got[1].status == "ok"
    assert got[1].confidence == pytest.approx(math.e**2 / (1 + math.e + math.e**2))
    assert got[4].predicted_label == 0
    for i in (2, 3):
        assert got[i].status == "error" and got[i].probs is None and got[i].predicted_label is None


def test_array_logits_with_two_classes(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0])], "example_id long, z array<double>")
    row = scoring.score_pairs(df, "z", ["no", "yes"]).first()
    assert row.predicted_name == "yes" and len(row.probs) == 2


def loader():
    def model(premises, hypotheses):
        if premises.str.contains("boom").any():
            raise RuntimeError("model broke")
        assert (premises.str.strip() != "").all()
        return np.stack([premises.str.len(), hypotheses.str.len(), np.zeros(len(premises))], axis=1)

    return model


def test_callable_keeps_rows_and_isolates_errors(spark):
    rows = [[1, "aaa", "b"], [2, " ", "b"], [3, "a", ""], [4, "a", "bbbb"], [5, "boom", "x"], [6, None, "x"]]
    df = literal_frame(spark, rows, PAIRS).coalesce(1)
    got = {r.example_id: r for r in scoring.score_pairs(df, loader, validate=True, batch_size=1).collect()}
    assert {i: r.status for i, r in got.items()} == {
        1: "ok", 2: "missing_premise", 3: "missing_hypothesis", 4: "ok", 5: "error", 6: "missing_premise",
    }
    assert (got[1].predicted_name, got[4].predicted_name) == ("entailment", "neutral")
    assert got[5].error == "model broke" and got[5].probs is None
    assert got[2].predicted_name is None


def test_callable_wrong_shape_is_an_error(spark):
    df = literal_frame(spark, [[1, "a", "b"]], PAIRS)
    row = scoring.score_pairs(df, lambda: lambda p, h: np.zeros((len(p), 2))).first()
    assert row.status == "error" and "shape" in row.error


def test_single_text_and_latency(spark):
    df = literal_frame(spark, [[i, "x" * i, ""] for i in range(1, 30)], PAIRS)

    def single():
        return lambda premises, nothing: np.stack([premises.str.len() % 2, np.full(len(premises), 0.5)], axis=1)

    scored = scoring.score_callable(df, single, ["odd", "even"], hypothesis=None, timed=True)
    assert {r.predicted_name for r in scored.where("example_id % 2 = 1").collect()} == {"odd"}
    row = scoring.latency_summary(scored).first()
    assert row.n == 29 and 0 <= row.p50_ms <= row.p95_ms


def predictions(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [
        [i, "en" if rng.random() < 0.7 else rng.choice(["de", "zh", "xx"]), rng.randint(0, 2), rng.randint(0, 2)] for i in range(n)
    ]
    return rows, literal_frame(spark, rows, "example_id BIGINT, lang STRING, gold_label INT, predicted_label INT")


def hits(rows, lang=None):
    picked = [r for r in rows if lang is None or r[1] == lang]
    return sum(r[2] == r[3] for r in picked), len(picked)


def test_accuracy_gap_and_average(spark):
    rows, df = predictions(spark)
    right, n = hits(rows)
    assert tuple(evaluation.accuracy(df).first()) == (n, right, right / n)
    table = {r.lang: r for r in evaluation.zero_shot_eval(df, ["en", "de", "hi", "zh"]).collect()}
    assert {k: v.position for k, v in table.items()} == {"en": 0, "de": 1, "hi": 2, "zh": 3}
    assert table["hi"].n == 0 and table["hi"].accuracy is None and table["hi"].gap is None
    acc = {k: hits(rows, k)[0] / hits(rows, k)[1] for k in ("en", "de", "zh")}
    for lang, value in acc.items():
        assert table[lang].accuracy == pytest.approx(value)
        assert table[lang].gap == pytest.approx(acc["en"] - value)
    by_language = evaluation.accuracy_by_language(df, ["en", "de", "zh"])
    assert evaluation.macro_average(by_language).first().macro_accuracy == pytest.approx(sum(acc.values()) / 3)
    assert evaluation.macro_average(by_language, ["en"]).first().macro_accuracy == pytest.approx((acc["de"] + acc["zh"]) / 2)
    report = evaluation.zero_shot_report(df, ["en", "de", "zh"]).orderBy("position").collect()
    assert [r.language for r in report] == ["en", "de", "zh", "Average"]
    assert report[-1].accuracy == pytest.approx(sum(acc.values()) / 3) and report[-1].gap is None


def test_gap_without_source_counts_from_zero(spark):
    _, df = predictions(spark)
    row = evaluation.zero_shot_eval(df, ["de"]).first()
    assert row.gap == pytest.approx(-row.accuracy)


def test_empty_input_gives_null(spark):
    _, df = predictions(spark, 5)
    assert tuple(evaluation.accuracy(df.where("false")).first()) == (0, 0, None)


def test_confusion_and_prf(spark):
    rows, df = predictions(spark)
    cells = {(r.lang, r.gold_label, r.predicted_label): r.n for r in evaluation.confusion_by_language(df).collect()}
    for lang in ("en", "de", "zh", "xx"):
        for g in range(3):
            for p in range(3):
                assert cells[lang, g, p] == sum(r[1:] == [lang, g, p] for r in rows)
    got = {r.lang: r for r in evaluation.macro_prf(df).collect()}
    for lang in ("en", "de"):
        precision = recall = f1 = 0
        for c in range(3):
            tp, np_, ng = cells[lang, c, c], sum(cells[lang, g, c] for g in range(3)), sum(cells[lang, c, p] for p in range(3))
            precision, recall = precision + (tp / np_ if np_ else 0) / 3, recall + (tp / ng if ng else 0) / 3
            f1 += (2 * tp / (np_ + ng) if np_ + ng else 0) / 3
        assert list(got[lang][1:]) == pytest.approx([precision, recall, f1])


def test_prf_with_an_unused_class(spark):
    df = literal_frame(spark, [[1, "en", 0, 0], [2, "en", 0, 1]], "example_id BIGINT, lang STRING, gold_label INT, predicted_label INT")
    assert list(evaluation.macro_prf(df).first()[1:]) == pytest.approx([1 / 3, 0.5 / 3, 2 / 3 / 3])


def test_compare_models(spark):
    a_rows, a = predictions(spark, 200, 2)
    b = a.withColumn("predicted_label", F.pmod(F.xxhash64("example_id"), F.lit(3)).cast("int"))
    other = {r.example_id: r.predicted_label for r in b.collect()}
    for row in evaluation.compare_models(a, b).collect():
        picked = [(r[3], other[r[0]], r[2]) for r in a_rows if r[1] == row.lang]
        assert row.n == len(picked) and row.agree == sum(x == y for x, y, _ in picked)
        assert row.only_a == sum(x == g != y for x, y, g in picked)
        assert row.only_b == sum(y == g != x for x, y, g in picked)
        assert row.both_right == sum(x == y == g for x, y, g in picked)
        assert row.accuracy_delta == pytest.approx((row.only_b - row.only_a) / row.n)


def test_compare_models_counts_missing_predictions(spark):
    ddl = "example_id BIGINT, lang STRING, gold_label INT, predicted_label INT"
    a = literal_frame(spark, [[1, "en", 0, 0], [2, "en", 1, 1], [3, "en", 2, 0], [5, None, 1, 1]], ddl)
    b = literal_frame(spark, [[1, "en", 0, None], [3, "en", 2, 2], [4, "en", 0, 0]], ddl)
    got = {r.lang: r for r in evaluation.compare_models(a, b).collect()}
    en = got["en"]
    assert (en.n, en.agree, en.both_right, en.only_a, en.only_b, en.missing_a, en.missing_b) == (4, 0, 0, 2, 2, 1, 2)
    assert en.accuracy_delta == 0 and got[None].missing_b == 1 and got[None].only_a == 1


def counting_loader(folder, name):
    """A loader that leaves a file named after itself and its process for every load."""

    def loader():
        import os
        import uuid

        open(os.path.join(folder, f"{name}-{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda a, b: [[0.0, 1.0, 2.0]] * len(a)

    return loader


def loads(folder):
    """Loads of each model in each process."""
    return Counter(tuple(f.name.split("-")[:2]) for f in folder.iterdir())


def test_model_is_loaded_once_per_worker(spark, tmp_path):
    df = spark.range(0, 200, numPartitions=20).selectExpr("id AS example_id", "'a' AS premise", "'b' AS hypothesis")
    for _ in range(3):  # the same model in other calls
        assert scoring.score_callable(df, counting_loader(str(tmp_path), "one")).where("predicted_label = 2").count() == 200
    assert loads(tmp_path) and max(loads(tmp_path).values()) == 1


def test_models_used_in_turn_are_loaded_once_each(spark, tmp_path):
    df = spark.range(0, 200, numPartitions=20).selectExpr("id AS example_id", "'a' AS premise", "'b' AS hypothesis")
    for _ in range(3):
        for name in ("one", "two", "three"):
            scored = scoring.score_callable(df, counting_loader(str(tmp_path), name))
            assert scored.where("predicted_label = 2").count() == 200
    assert {name for name, _ in loads(tmp_path)} == {"one", "two", "three"} and max(loads(tmp_path).values()) == 1


def test_worker_keeps_what_fits():
    made = []

    def value(key, weight=1.0):
        return worker.kept(key, lambda: made.append(key) or key, weight, 3.0)

    before = worker.registry().copy()
    worker.registry().clear()
    try:
        assert [value(k) for k in "abcabca"] == list("abcabca") and made == list("abc")
        value("d")  # b is the least recently used
        assert list(worker.registry()) == ["c", "a", "d"]
        value("large", 9.0)
        assert list(worker.registry()) == ["large"]
        value("a"), value("b", 2.0)
        assert list(worker.registry()) == ["a", "b"]
    finally:
        worker.registry().clear()
        worker.registry().update(before)


def test_only_texts_travel_to_python(spark):
    df = spark.range(10).selectExpr("id", "'a' AS premise", "'b' AS hypothesis", "repeat('x', 1000) AS wide", "array(id) AS more")
    scored = scoring.score_callable(df, counting_loader("/nowhere", "x"), timed=True)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    sent = re.findall(r"ArrowEvalPython \[score\(([^)]*)\)", plan)
    assert sent == ["ok, a, b"] and "MapInPandas" not in plan
    filtered = scored.where("status = 'ok' AND latency_ms > 0")
    assert filtered._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {"wide", "more", "id", "latency_ms", "error"} <= set(scored.columns)


def test_typology(spark):
    rows = [[0, "en", 0.9, 0.0], [1, "de", 0.8, 0.1], [2, "ru", 0.6, 0.3], [3, "hi", None, None]]
    table = literal_frame(spark, rows, "position INT, lang STRING, accuracy DOUBLE, gap DOUBLE")
    got = {(r.feature, r.value): (r.languages, r.avg_gap) for r in evaluation.typology_gap(table, language_dim(spark)).collect()}
    assert got["family", "Germanic"] == (2, pytest.approx(0.05))
    assert got["morphology", "High"] == (1, pytest.approx(0.3)) and ("script", "Devanagari") not in got
    row = evaluation.typology_corr(table, language_dim(spark)).first()
    assert row.languages == 3 and row.morphology_gap_corr == pytest.approx(np.corrcoef([1, 2, 3], [0, 0.1, 0.3])[0, 1])


def test_training_beats_the_majority_class(spark, tmp_path):
    rng = random.Random(0)
    cue = {0: "yes indeed", 1: "maybe so", 2: "not never"}
    rows = []
    for i in range(300):
        label = rng.choice([0, 0, 0, 1, 2])
        split, lang = rng.choice(["train", "train", "validation"]), rng.choice(["en", "en", "de"])
        rows.append([i, split, lang, f"text {rng.randint(0, 9)}", f"{cue[label]} {rng.randint(0, 9)}", label])
    pairs = literal_frame(spark, rows, "example_id BIGINT, split STRING, lang STRING, premise STRING, hypothesis STRING, label INT")
    result = transfer.train_and_evaluate(pairs, ["en", "de"], num_features=256, max_iter=15)
    table = {r.lang: r for r in result.evaluation.collect()}
    assert table["en"].accuracy > 0.9 and table["de"].n > 0
    assert result.loss_history[-1] < result.loss_history[0]
    assert history.epoch_loss(history.training_log(spark, result.loss_history)).first().steps == len(result.loss_history)
    path = str(tmp_path / "model")
    transfer.save_model(result.model, path)
    loaded = transfer.load_first_model(spark, [str(tmp_path / "absent"), path])
    test = pairs.where("split = 'validation'")
    a = {r.example_id: r.predicted_label for r in scoring.score_pairs(test, result.model, validate=True).collect()}
    b = {r.example_id: r.predicted_label for r in scoring.score_pairs(test, loaded, validate=True).collect()}
    assert a == b and len(a) > 50
