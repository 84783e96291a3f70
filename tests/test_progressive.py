"""Scoring in growing ranges: the same errors, fewer rows scored."""

import random

import pytest
from pyspark.sql import functions as F

from lingospan.operators import errors, progressive
from lingospan.schemas import language_dim, literal_frame

DDL = "example_id BIGINT, lang STRING, premise STRING, hypothesis STRING, gold_label INT, guess INT"


def labelled(spark, seed=0, n=3000, wrong=(0.5, 0.02, 0.0)):
    """Ids with gaps and clusters; languages that err often, seldom and never, and some rows without a language."""
    rng = random.Random(seed)
    ids = rng.sample(range(-5000, 5000), n // 2) + rng.sample(range(1 << 40, (1 << 40) + 10_000), n // 2)
    rows = []
    for i in ids:
        which = rng.randrange(4)
        gold = rng.randrange(3)
        guess = (gold + 1) % 3 if which < 3 and rng.random() < wrong[which] else gold
        rows.append([i, ["en", "de", "fr", None][which], rng.choice(["", "p", "p"]), "h", gold, guess])
    return literal_frame(spark, rows, DDL).repartition(7)


def recording(calls):
    """A scorer that takes ``guess`` for its prediction and notes how many rows it is given."""

    def score(rows):
        seen = calls[0]
        return rows.withColumn("predicted_label", F.col("guess")).withColumn("probs", F.array(*[F.lit(1 / 3)] * 3)).withColumn(
            "confidence", F.lit(1 / 3)
        ).where(seen.count_of("example_id"))

    return score


class Counter:
    """Counts rows that pass a filter, with an accumulator."""

    def __init__(self, spark):
        self.total = spark.sparkContext.accumulator(0)

    def count_of(self, column):
        total = self.total

        @F.udf("boolean")
        def seen(_):
            total.add(1)
            return True

        return seen.asNondeterministic()(column)


@pytest.mark.parametrize("limit", [0, 1, 5, 15, 10_000])
def test_same_records_as_scoring_all(spark, limit):
    pairs = labelled(spark)
    counter = Counter(spark)
    score = recording([counter])
    whole = pairs.withColumn("predicted_label", F.col("guess")).withColumn("probs", F.array(*[F.lit(1 / 3)] * 3)).withColumn("confidence", F.lit(1 / 3))
    scan = progressive.score_until(pairs, score, limit)
    languages = language_dim(spark)
    want = errors.collect_errors(whole, languages, limit).collect()
    got = errors.collect_errors(scan.scored, languages, limit).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and want
    codes = ["en", "de", "fr"]
    assert sorted(errors.rows_checked(scan.scored, codes, limit).collect()) == sorted(errors.rows_checked(whole, codes, limit).collect())


def test_fewer_rows_are_scored(spark):
    pairs = labelled(spark, 1, 4000, (0.5, 0.5, 0.5)).where("lang IS NOT NULL")
    counter = Counter(spark)
    scan = progressive.score_until(pairs, recording([counter]), 5)
    assert 0 < counter.total.value < pairs.count() / 4
    assert scan.scored.count() == counter.total.value and all(n >= 5 for n in scan.errors.values())


def test_no_row_is_scored_twice(spark):
    pairs = labelled(spark, 2, wrong=(0.01, 0.02, 0.0))
    counter = Counter(spark)
    scan = progressive.score_until(pairs, recording([counter]), 20)
    nonempty = pairs.where("premise <> ''").count()
    assert counter.total.value == scan.scored.count() == scan.scored.select("example_id").distinct().count() == nonempty
    assert scan.rounds > 1 and all(scan.exhausted.values())


def test_ranges_reach_the_scan(spark, tmp_path):
    labelled(spark).write.parquet(f"{tmp_path}/pairs")
    plans = []

    def score(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows.withColumn("predicted_label", F.col("guess"))

    progressive.score_until(spark.read.parquet(f"{tmp_path}/pairs"), score, 1)
    assert "LessThanOrEqual(example_id" in plans[1]


def test_nothing_to_score_and_null_ids(spark):
    score = lambda rows: rows.withColumn("predicted_label", F.col("guess"))
    empty = progressive.score_until(literal_frame(spark, [], DDL), score)
    assert empty.scored.collect() == [] and empty.rounds == 0 and "predicted_label" in empty.scored.columns
    with pytest.raises(Exception, match="NULL"):
        progressive.score_until(literal_frame(spark, [[None, "en", "p", "h", 0, 1]], DDL), score)
