import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lingospan import streaming
from lingospan.__main__ import main
from lingospan.config import Config, work_folder
from lingospan.operators import encoding, scoring
from lingospan.plans import workflows
from lingospan.schemas import ANNOTATION_COLUMNS, PAIRS_DDL, literal_frame
from lingospan.sources import ingest, readers, registry, writers

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TRICKY = ['say "hi", then\ngo', " padded ", "comma, and 'quotes'", "back\\slash", "tab\tüñ 猫", "\r\n"]


def loader():
    return lambda p, h: np.stack([p.str.len() % 3, h.str.len() % 4, np.ones(len(p))], axis=1)


def test_first_existing_and_splits(spark, tmp_path):
    rows = [[1, "train", "en", "a", "b", 0], [2, "test", "de", "c", "d", 1], [3, "validation", "en", "e", "f", 2]]
    df = literal_frame(spark, rows, PAIRS_DDL)
    path = str(tmp_path / "xnli")
    writers.write_partitioned(df, path)
    back = readers.load_splits(spark, [str(tmp_path / "none"), path], ["train", "test"])
    assert {r.example_id for r in back.collect()} == {1, 2}
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "split" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.example_id for r in readers.load_languages(spark, [path], ["en", "zh"]).collect()} == {1, 3}
    with pytest.raises(FileNotFoundError):
        readers.load_first_existing(spark, [str(tmp_path / "none")])
    catalog = registry.Catalog(spark, [str(tmp_path / "none"), str(tmp_path)])
    assert catalog.open("xnli", ["de"]).count() == 1 and "three classes" in catalog.task("xnli")
    assert catalog.register_views(["xnli"]) == ["xnli"] and spark.table("xnli").count() == 3
    with pytest.raises(KeyError):
        catalog.open("nope")


def test_ingest(spark, tmp_path):
    frame = literal_frame(spark, [[1]], "x INT")
    assert ingest.ingest_dataset(spark, "one", lambda: frame, str(tmp_path)).count() == 1
    assert ingest.ingest_dataset(spark, "one", lambda: frame, str(tmp_path)) is None

    def broken():
        raise OSError("no such source")

    (tmp_path / "multi" / "lang=ru").mkdir(parents=True)
    status = ingest.ingest_languages(
        spark, "multi", {"en": lambda: frame, "de": broken, "ru": lambda: frame, "hi": lambda: frame}, str(tmp_path)
    )
    got = {r.lang: (r.status, r.error) for r in status.collect()}
    assert got["en"] == got["hi"] == ("saved", None) and got["ru"] == ("incomplete", None)
    assert got["de"] == ("error", "OSError: no such source")


def test_ingest_by_language_is_one_pass_and_resumable(spark, tmp_path):
    rows = [[i, "en" if i % 4 else "de"] for i in range(40)]
    df = literal_frame(spark, rows, "id INT, language STRING")

    def run(langs):
        status = ingest.ingest_by_language(spark, "c", df, langs, str(tmp_path), "language")
        return {r.lang: r.status for r in status.collect()}

    assert run(["en", "hi"]) == {"en": "saved", "hi": "no rows"}
    assert run(["en", "de"]) == {"en": "skipped", "de": "saved"}
    stored = spark.read.parquet(str(tmp_path / "c"))
    assert {(r.id, r.lang) for r in stored.collect()} == {tuple(r) for r in rows} and stored.count() == 40


def test_attach_ids_follow_stored_order(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(1000).repartition(3)
    df.write.parquet(path)
    stored = readers.attach_ids(spark.read.parquet(path))
    rows = stored.withColumn("file", F.shiftright("example_id", 40)).collect()
    assert len({r.example_id for r in rows}) == 1000 and {r.file for r in rows} == {0, 1, 2}
    again = {r.id: r.example_id for r in readers.attach_ids(spark.read.parquet(path)).collect()}
    assert again == {r.id: r.example_id for r in rows}


def test_csv_round_trip(spark, tmp_path):
    rows = [[i, text, None if i % 2 else "E1"] for i, text in enumerate(TRICKY)]
    df = literal_frame(spark, rows, "id INT, premise STRING, error_category STRING")
    writers.write_annotation_sheet(df, str(tmp_path / "sheet"), one_file=True)
    back = readers.read_csv(spark, str(tmp_path / "sheet"), "id INT, premise STRING, error_category STRING")
    assert sorted(tuple(r) for r in back.collect()) == [tuple(r) for r in rows]


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, t, (0.1, 0.2, None)) for t in TRICKY], "id int, t string, probs struct<a: double, b: double, c: double>")
    writers.write_json(df, str(tmp_path / "j"))
    assert sorted(map(str, spark.read.schema(df.schema).json(str(tmp_path / "j")).collect())) == sorted(map(str, df.collect()))
    assert "猫" in "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))


def test_work_folder(spark):
    one, two = work_folder(spark, "x"), work_folder(spark, "x")
    base = spark.conf.get("spark.checkpoint.dir", None)
    assert one != two and (not base or one.startswith(base))


def corpus(spark, tmp_path):
    rows = []
    for i in range(200):
        split = "train" if i % 3 else "validation"
        for lang in ("en", "de", "fr"):
            rows.append([i, split, lang, f"premise {i} {'x' * (i % 5)}", f"text {'y' * (i % 7)} {i % 3}", i % 3])
    path = str(tmp_path / "pairs")
    writers.write_partitioned(literal_frame(spark, rows, PAIRS_DDL), path)
    return Config(data_dir=path, eval_langs=["en", "de", "fr", "hi"], output_dir=str(tmp_path / "errors"),
                  checkpoint_dir=str(tmp_path / "models"), errors_per_language=4, num_features=64, max_iter=5)


def test_error_mining_and_annotation(spark, tmp_path):
    config = corpus(spark, tmp_path)
    scored = workflows.score_eval_split(spark, config, loader)
    report = workflows.report(scored, config).collect()
    assert [r.language for r in report] == ["en", "de", "fr", "hi", "Average"]
    mined = workflows.mine_errors(spark, scored, config)
    assert not mined.annotated and mined.records.groupBy("language").count().where("count = 4").count() == 3
    assert {r.language_name: r["count"] for r in mined.summaries["by_language"].collect()} == {"English": 4, "German": 4}
    sheet = f"{config.output_dir}/{workflows.SHEET}"
    blank = readers.read_annotations(spark, sheet)
    assert blank.columns == ANNOTATION_COLUMNS and blank.count() == 12
    assert not workflows.mine_errors(spark, scored, config).annotated
    blank = readers.read_annotations(spark, sheet)
    rows = [[*r] for r in blank.collect()]
    for r in rows:
        r[ANNOTATION_COLUMNS.index("error_category")] = "E2" if r[0] <= 2 else None
    writers.write_annotation_sheet(spark.createDataFrame(rows, blank.schema), sheet)
    analysed = workflows.mine_errors(spark, scored, config)
    assert analysed.annotated
    assert [(r.code, r["count"], r.pct) for r in analysed.summaries["categories"].collect()] == [("E2", 6, 50.0)]
    assert {tuple(r) for r in analysed.summaries["by_language"].collect()} == {("English", 2), ("German", 2)}


def other_loader():
    return lambda p, h: np.stack([np.ones(len(p)), h.str.len() % 4, p.str.len() % 3], axis=1)


def test_compare_two_models(spark, tmp_path):
    config = corpus(spark, tmp_path)
    rows = {r.lang: r for r in workflows.compare(spark, config, loader, other_loader).collect()}
    assert set(rows) == {"en", "de", "fr"} and all(r.n == 67 and r.agree < 67 for r in rows.values())
    same = workflows.compare(spark, config, loader, loader).first()
    assert same.agree == same.n and same.accuracy_delta == 0


def test_encoded_sets(spark, tmp_path):
    config = corpus(spark, tmp_path)
    train, test = workflows.prepare_sets(spark, config, encoding.Vocabulary(spark, ["premise", "text"]))
    assert {r.lang for r in train.select("lang").distinct().collect()} == {"en"} and train.count() == 133
    assert test.count() == 67 * 3 and len(test.first().input_ids) == config.max_length


def test_wide_corpus_is_unpivoted(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.sql("SELECT 1 AS example_id, 'train' AS split, map('en', 'a') AS premise, map('en', 'b') AS hypothesis, 0 AS label").write.parquet(path)
    rows = workflows.load_pairs(spark, Config(data_dir=path, eval_langs=["en", "de"])).collect()
    assert {(r.lang, r.premise, r.hypothesis) for r in rows} == {("en", "a", "b"), ("de", "", "")}


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_bulk_score(spark, tmp_path, fmt):
    rows = [[t, "hypothesis"] for t in TRICKY]
    writers.write_csv(literal_frame(spark, rows, "premise STRING, hypothesis STRING"), str(tmp_path / "in"))
    out = workflows.bulk_score(spark, str(tmp_path / "in"), "premise STRING, hypothesis STRING", str(tmp_path / "out"), loader, fmt)
    assert sorted(r.status for r in out.collect()) == ["missing_premise"] + ["ok"] * 5


def test_command_line(spark, tmp_path, capsys):
    config = corpus(spark, tmp_path)
    common = ["--data", config.data_dir, "--langs", "en", "de", "--checkpoint", f"{config.checkpoint_dir}/pair_pipeline",
              "--checkpoint-dir", config.checkpoint_dir, "--output-dir", config.output_dir]
    main(["train", *common])
    main(["eval", *common])
    main(["errors", *common])
    printed = capsys.readouterr().out
    assert "Average" in printed and "by_script" in printed
    writers.write_csv(literal_frame(spark, [["a b", "a"]], "premise STRING, hypothesis STRING"), str(tmp_path / "in"))
    main(["score", *common[:-1], str(tmp_path / "scores"), "--input", str(tmp_path / "in"), "--format", "json"])
    assert spark.read.json(str(tmp_path / "scores")).first().status == "ok"


DDL = "example_id BIGINT, lang STRING, premise STRING, hypothesis STRING, gold_label INT"


def test_streams_equal_batch(spark, tmp_path):
    rows = [[i, "en" if i % 3 else "de", "p" * (i % 4), "h" * (i % 5), i % 3] for i in range(90)]
    df = literal_frame(spark, rows, DDL)
    source = str(tmp_path / "arrivals")
    for part in range(3):
        df.where(F.col("example_id") % 3 == part).coalesce(1).write.mode("append").parquet(source)
    batch = scoring.score_pairs(df, loader, validate=True)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = streaming.read_pair_stream(spark, source, DDL, files_per_trigger=1)
        streaming.write_stream(streaming.score_stream(stream, loader), out, state).awaitTermination()
        return sorted(map(str, spark.read.schema(batch.schema).parquet(out).collect()))

    assert run() == sorted(map(str, batch.collect()))
    more = literal_frame(spark, [[500, "en", "late", "pair", 1]], DDL)
    more.coalesce(1).write.mode("append").parquet(source)
    everything = df.unionByName(more)
    assert run() == sorted(map(str, scoring.score_pairs(everything, loader, validate=True).collect()))

    stream = streaming.read_pair_stream(spark, source, DDL, files_per_trigger=1)
    totals = streaming.running_accuracy(streaming.score_stream(stream, loader))
    streaming.publish_totals(totals, str(tmp_path / "totals"), str(tmp_path / "totals_state")).awaitTermination()
    want = streaming.running_accuracy(scoring.score_pairs(everything, loader, validate=True)).collect()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "totals")).collect())) == sorted(map(str, want))
