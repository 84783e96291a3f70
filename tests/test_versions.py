"""A table of versions stays readable whatever happens to its writer."""

import pytest

from lingospan import streaming
from lingospan.operators import errors, scoring
from lingospan.schemas import literal_frame
from lingospan.sources import versions

DDL = "example_id BIGINT, lang STRING, l0 DOUBLE, l1 DOUBLE, l2 DOUBLE, gold_label INT"


def values(df):
    return sorted(map(tuple, df.collect()))


def test_versions_follow_each_other(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        versions.read_current(spark, path)
    for i in range(5):
        df = spark.range(i)
        assert versions.publish(df, path, f"run-{i}", keep=2)
        assert values(versions.read_current(spark, path)) == values(df)
    assert versions.publish(spark.range(100), path, "run-3", keep=2) is False
    assert values(versions.read_current(spark, path)) == values(spark.range(4))
    assert [name for _, name in versions.committed(spark, path)] == ["run-2", "run-3", "run-4"]
    assert sorted(p.name for p in (tmp_path / "table" / "data").iterdir()) == ["run-2", "run-3", "run-4"]
    for wrong in ("", "a/b", "a_b", ".."):
        with pytest.raises(ValueError):
            versions.publish(df, path, wrong)


def test_reader_of_an_older_version_is_not_disturbed(spark, tmp_path):
    path = str(tmp_path / "table")
    versions.publish(spark.range(10), path, "a")
    held = versions.read_current(spark, path)
    versions.publish(spark.range(20), path, "b")
    versions.publish(spark.range(30), path, "c")
    assert held.count() == 10 and versions.read_current(spark, path).count() == 30


@pytest.mark.parametrize("stop", ["write", "commit"])
def test_stopped_stream_leaves_the_last_totals(spark, tmp_path, monkeypatch, stop):
    rows = [[i, ["en", "de", None][i % 3], float(i % 5), float(i % 7), 1.5, i % 3] for i in range(90)]
    df = literal_frame(spark, rows, DDL)
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))

    def arrive(part):
        df.where(df.example_id % 3 == part).coalesce(1).write.mode("append").parquet(source)

    def totals(frame):
        return streaming.running_accuracy(scoring.score_logits(frame, ["l0", "l1", "l2"]))

    def run():
        streaming.publish_versions(totals(streaming.read_pair_stream(spark, source, DDL)), out, state).awaitTermination()

    def now():
        return sorted(map(str, versions.read_current(spark, out).collect()))

    def batch(parts):
        return sorted(map(str, totals(df.where((df.example_id % 3).isin(parts))).collect()))

    arrive(0)
    run()
    assert now() == batch([0])
    arrive(1)
    real = versions.commit
    with monkeypatch.context() as patched:

        def stopped(*args):
            if stop == "commit":  # the version became visible, but the stream did not note the batch as done
                real(*args)
            raise RuntimeError("stopped")

        patched.setattr(versions, "commit", stopped)
        with pytest.raises(Exception, match="stopped"):
            run()
        # The second version is written whole; readers see it only if it was committed.
        assert len(list((tmp_path / "out" / "data").iterdir())) == 2
        assert now() == batch([0, 1] if stop == "commit" else [0])
    arrive(2)
    run()
    assert now() == batch([0, 1, 2])
    numbers = [number for number, _ in versions.committed(spark, out)]
    assert numbers == [0, 1, 2]


def test_new_checkpoint_goes_on_after_the_old_versions(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    literal_frame(spark, [[1, "en", 1.0, 0.0, 0.0, 0]], DDL).write.parquet(source)
    for name in ("first", "second"):
        stream = scoring.score_logits(streaming.read_pair_stream(spark, source, DDL), ["l0", "l1", "l2"])
        streaming.publish_versions(streaming.running_accuracy(stream), out, str(tmp_path / name)).awaitTermination()
    assert len(versions.committed(spark, out)) == 2
    assert [tuple(r) for r in versions.read_current(spark, out).collect()] == [("en", 1, 1, 1.0)]


def test_category_suggestion_counts_texts_once(spark):
    ddl = "premise STRING, hypothesis STRING, predicted_label STRING, morphology STRING, word_order STRING, language STRING"
    rows = [["a b", "c", "neutral", "Low", "SVO", "en"], [None, None, None, None, None, None], ["", "", "", "", "", ""]]
    counted = spark.sparkContext.accumulator(0)
    base = literal_frame(spark, rows, ddl)

    def count(batches):
        for batch in batches:
            counted.add(len(batch))
            yield batch

    table = errors.suggest_category(base.mapInArrow(count, base.schema))
    assert len(table.collect()) == 3 and counted.value == 3
    assert "Python" not in table._jdf.queryExecution().executedPlan().toString()

