import random

import pytest
from pyspark.sql import functions as F

from lingospan.operators import ordering, pairs
from lingospan.schemas import literal_frame


def test_unpivot(spark):
    df = spark.sql(
        """SELECT * FROM VALUES (1, map('en', 'a', 'de', 'b'), map('en', 'x'), 0),
                                (2, map('fr', 'c'), map('fr', 'z'), 1) AS t(example_id, premise, hypothesis, label)"""
    )
    got = {tuple(r) for r in pairs.unpivot_languages(df).select("example_id", "lang", "premise", "hypothesis").collect()}
    assert got == {(1, "en", "a", "x"), (1, "de", "b", ""), (2, "fr", "c", "z")}
    got = {tuple(r) for r in pairs.unpivot_languages(df, ["en", "fr"], "first")
           .select("example_id", "lang", "premise", "hypothesis").collect()}
    assert got == {(1, "en", "a", "x"), (1, "fr", "a", "x"), (2, "en", "c", "z"), (2, "fr", "c", "z")}
    with pytest.raises(TypeError):
        pairs.unpivot_languages(literal_frame(spark, [["a", "b"]], "premise STRING, hypothesis STRING"))
    with pytest.raises(ValueError):
        pairs.unpivot_languages(df, None, "empty")


def test_validate_order_and_strip(spark):
    rows = [["", ""], [" a ", " "], [" ", "b"], [None, "b"], [" a", "b\n"]]
    got = pairs.validate_pairs(literal_frame(spark, rows, "premise STRING, hypothesis STRING")).withColumn(
        "message", pairs.status_message()
    )
    got = [tuple(r) for r in got.select("premise", "hypothesis", "status", "message").collect()]
    ask_p, ask_h = "Please enter a premise.", "Please enter a hypothesis."
    assert got == [
        ("", "", "missing_premise", ask_p), ("a", "", "missing_hypothesis", ask_h), ("", "b", "missing_premise", ask_p),
        ("", "b", "missing_premise", ask_p), ("a", "b", "ok", None),
    ]


def test_nonempty(spark):
    rows = [["", "b"], ["a", None], [" ", "b"], ["a", "b"]]
    assert pairs.nonempty_pairs(literal_frame(spark, rows, "premise STRING, hypothesis STRING")).count() == 2


def test_pairs_from_turns(spark):
    turns = [[1, 0, "system", "s"], [1, 1, "user", "q1"], [1, 2, "assistant", "a1"], [1, 3, "user", "q2"],
             [1, 5, "assistant", "late"], [2, 0, "user", "q"], [2, 1, "user", "again"], [2, 2, "assistant", "a"]]
    df = literal_frame(spark, turns, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    got = {tuple(r) for r in pairs.pairs_from_turns(df).collect()}
    assert got == {(1, 1, "q1", "a1"), (2, 1, "again", "a")}


def test_align_languages(spark):
    df = literal_frame(spark, [[1, "en", "a"], [1, "de", "b"], [2, "en", "c"], [2, "xx", "d"]], "id INT, lang STRING, sentence1 STRING")
    got = {tuple(r) for r in pairs.align_languages(df, ["en", "de", "zh"]).collect()}
    assert got == {(1, "a", "b", None), (2, "c", None, None)}


def skewed(spark, n=700, seed=5):
    """Sparse, clustered and negative ids; one group holds most rows."""
    rng = random.Random(seed)
    ids = rng.sample(range(1000), n // 2) + rng.sample(range(10**14, 10**15), n // 4)
    ids += rng.sample(range(-(10**9), 0), n - len(ids))
    rng.shuffle(ids)
    rows = [[i, "hot" if rng.random() < 0.7 else rng.choice("abc")] for i in ids]
    return rows, literal_frame(spark, rows, "example_id BIGINT, lang STRING")


@pytest.mark.parametrize("buckets", [4, 64, None])
def test_number_rows_in_order(spark, buckets):
    rows, df = skewed(spark)
    got = {r.example_id: r.row_index for r in ordering.number_rows(df, buckets=buckets).collect()}
    assert got == {i: k for k, i in enumerate(sorted(i for i, _ in rows))}


def test_number_rows_in_groups(spark):
    rows, df = skewed(spark)
    got = {(r.lang, r.example_id): r.row_index for r in ordering.number_rows(df, "example_id", ["lang"]).collect()}
    want = {}
    for i, lang in sorted(rows):
        want[lang, i] = sum(1 for key in want if key[0] == lang)
    assert got == want


def test_number_rows_of_nothing(spark):
    df = literal_frame(spark, [], "example_id BIGINT")
    assert ordering.number_rows(df).count() == 0
    assert ordering.number_rows(df, shuffle=True).count() == 0


def test_batches(spark):
    rows, df = skewed(spark, 101)
    first = ordering.assign_batches(df, 16, shuffle=True, seed=3, epoch=0)
    sizes = sorted(r["count"] for r in first.groupBy("batch_id").count().collect())
    assert sizes == [5, 16, 16, 16, 16, 16, 16]

    def order(frame):
        return [r.example_id for r in frame.orderBy("row_index").collect()]

    again = ordering.assign_batches(df, 16, shuffle=True, seed=3, epoch=0)
    other = ordering.assign_batches(df, 16, shuffle=True, seed=3, epoch=1)
    assert order(first) == order(again) != order(other)
    assert sorted(order(other)) == sorted(i for i, _ in rows)
    assert order(first) == [r.example_id for r in ordering.random_order(df, seed=3, epoch=0).collect()]


@pytest.mark.parametrize("n", [1, 7, 5000])
def test_first_n_per_group(spark, n):
    rows, df = skewed(spark)
    got = {tuple(r) for r in ordering.first_n_per_group(df, ["lang"], "example_id", n).select("lang", "example_id", "rank").collect()}
    want, seen = set(), {}
    for i, lang in sorted(rows):
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= n:
            want.add((lang, i, seen[lang]))
    assert got == want


def test_first_n_prunes_before_the_shuffle(spark):
    _, df = skewed(spark)
    plan = ordering.first_n_per_group(df, ["lang"], "example_id", 15)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("n", [2, 1000])
def test_first_n_has_one_rule(spark, n):
    df = literal_frame(spark, [[1, None, "x"], [2, None, "y"], [3, "a", "z"]], "example_id BIGINT, lang STRING, text STRING")
    got = {tuple(r) for r in ordering.first_n_per_group(df, ["lang"], "example_id", n).collect()}
    assert got == {(1, None, "x", 1), (2, None, "y", 2), (3, "a", "z", 1)}
    with pytest.raises(TypeError, match="integer id"):
        ordering.first_n_per_group(df, ["lang"], "text", n)
    missing = df.withColumn("example_id", F.when(F.col("example_id") > 1, F.col("example_id")))
    with pytest.raises(Exception, match="has a NULL"):
        ordering.first_n_per_group(missing, ["lang"], "example_id", n).collect()
    with pytest.raises(Exception, match="has a NULL"):
        ordering.number_rows(missing, "example_id", ["lang"]).collect()


def test_no_text_is_sorted_for_the_first_rows(spark):
    df = literal_frame(spark, [[1, "a", "z"]], "example_id BIGINT, lang STRING, text STRING")
    plan = ordering.first_n_per_group(df, ["lang"], "example_id", 15)._jdf.queryExecution().optimizedPlan()
    windows = [x for x in plan.toString().split("\n") if "Window" in x]
    assert windows and not any("text" in x for x in windows)


def test_null_keys_are_numbered(spark):
    df = literal_frame(spark, [[1, None], [2, None], [3, "a"]], "example_id BIGINT, lang STRING")
    got = {tuple(r) for r in ordering.number_rows(df, "example_id", ["lang"]).collect()}
    assert got == {(1, None, 0), (2, None, 1), (3, "a", 0)}


def test_first_rows(spark):
    rows, df = skewed(spark)
    assert [r.example_id for r in ordering.first_rows(df, "example_id", 3).collect()] == sorted(i for i, _ in rows)[:3]


def test_train_eval(spark):
    rows = [["train", "en"], ["train", "de"], ["validation", "en"], ["validation", "de"], ["test", "en"], ["validation", "fr"]]
    train, test = pairs.train_eval_frames(literal_frame(spark, rows, "split STRING, lang STRING"), "en", ["en", "de"])
    assert [tuple(r) for r in train.collect()] == [("train", "en")]
    assert test.where(F.col("split") == "validation").count() == test.count() == 2
