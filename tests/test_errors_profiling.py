import random
import tracemalloc
import unicodedata
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lingospan.functions import text
from lingospan.operators import errors, history, profiling
from lingospan.schemas import ERROR_DDL, NLI_LABELS, category_dim, language_dim, literal_frame
from lingospan.sources.examples import TOKEN_TEXTS, token_texts

DDL = "example_id BIGINT, lang STRING, premise STRING, hypothesis STRING, gold_label INT, predicted_label INT"


def scored(spark, n=500, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in rng.sample(range(10_000), n):
        lang = "en" if rng.random() < 0.7 else rng.choice(["de", "zh", "fr"])
        texts = [rng.choice(["", " ", "some text", None]) if rng.random() < 0.3 else f"t{i}" for _ in range(2)]
        rows.append([i, lang, *texts, rng.randint(0, 2), rng.randint(0, 2)])
    df = literal_frame(spark, rows, DDL)
    probs = F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5))
    return rows, df.withColumns({"probs": probs, "confidence": F.lit(0.5)})


def walk(rows, lang, limit):
    """The rule as a loop: skip empty pairs, stop after the limit-th error."""
    found, checked = [], 0
    for i, row_lang, premise, hypothesis, gold, predicted in sorted(rows):
        if row_lang != lang or not premise or not hypothesis:
            continue
        checked += 1
        if predicted != gold:
            found.append((len(found) + 1, premise, NLI_LABELS[gold], NLI_LABELS[predicted]))
            if len(found) >= limit:
                break
    return found, checked


@pytest.mark.parametrize("limit", [-1, 0, 1, 15, 100_000])
def test_errors_and_rows_checked_follow_the_loop(spark, limit):
    rows, df = scored(spark)
    records = errors.collect_errors(df, language_dim(spark), limit)
    assert records.dtypes == spark.createDataFrame([], ERROR_DDL).dtypes
    got = {}
    for r in records.collect():
        got.setdefault(r.language, []).append((r.id, r.premise, r.gold_label, r.predicted_label))
    visited = {r.lang: (r.checked, r.errors) for r in errors.rows_checked(df, ["en", "de", "zh", "fr"], limit).collect()}
    for lang in ("en", "de", "zh", "fr"):
        found, checked = walk(rows, lang, limit)
        assert sorted(got[lang]) == found
        assert visited[lang] == (checked, len(found))


def test_attributes_and_strict(spark):
    rows, df = scored(spark, 100)
    records = {r.language: r for r in errors.collect_errors(df, language_dim(spark), 1).collect()}
    assert records["de"].word_order == "V2/SOV" and records["fr"].language_name is None
    assert records["de"].probs.contradiction == 0.5 and records["de"].error_category == ""
    with pytest.raises(Exception, match="no attributes for language fr"):
        errors.collect_errors(df, language_dim(spark), 1, strict=True).collect()


RECORDS = [
    ["en", "English", "Germanic", "Latin", "Low", "SVO", "entailment", "neutral", 0.5, "E1"],
    ["en", "English", "Germanic", "Latin", "Low", "SVO", "neutral", "neutral", 0.7, "E9"],
    ["ru", "Russian", "Slavic", "Cyrillic", "High", "Free", "neutral", "entailment", 0.9, None],
    ["fr", None, None, None, None, None, "neutral", "entailment", 0.1, "E1"],
]
RECORD_DDL = (
    "language STRING, language_name STRING, family STRING, script STRING, morphology STRING, word_order STRING, "
    "gold_label STRING, predicted_label STRING, confidence DOUBLE, error_category STRING"
)


def test_summaries(spark):
    df = literal_frame(spark, RECORDS, RECORD_DDL)
    assert {tuple(r) for r in errors.errors_by_language(df).collect()} == {("English", 2, 0.6), ("Russian", 1, 0.9)}
    assert {tuple(r) for r in errors.errors_by_script(df).collect()} == {("Latin", 2), ("Cyrillic", 1)}
    assert {tuple(r) for r in errors.errors_by_morphology(df).collect()} == {("Low", 2), ("High", 1)}
    sets = {(r.dimension, r.value): (r["count"], r.avg_confidence) for r in errors.error_summary(df).collect()}
    assert len(sets) == 11 and sets["total", "all"][0] == len(RECORDS) and sets["family", "Germanic"] == (2, 0.6) and sets["word_order", "Free"] == (1, 0.9)
    confusion = {r.gold_label: (r.entailment, r.neutral, r.contradiction) for r in errors.error_confusion(df).collect()}
    assert confusion == {"entailment": (0, 1, 0), "neutral": (2, 1, 0)}


def test_annotations(spark):
    df = literal_frame(spark, RECORDS, RECORD_DDL)
    table = {r.code: r for r in errors.category_distribution(df, category_dim(spark)).collect()}
    assert set(table) == {"E1", "E9"} and table["E9"].description == "Unknown"
    assert table["E1"].pct == 50.0 and table["E1"].pct_of_annotated == pytest.approx(200 / 3)
    for categories, want in ((None, (1, 1)), (["E1", "E9"], (1, 1, 0)), (["E1"], (1, 1)), (["E5"], (0, 2))):
        assert [tuple(r) for r in errors.category_crosstab(df, "language_name", categories).collect()] == [("English", *want)]
    assert errors.has_annotations(df)
    assert not errors.has_annotations(df.withColumn("error_category", F.lit(None).cast("string")))
    assert not errors.has_annotations(df.drop("error_category"))
    assert {tuple(r) for r in errors.annotation_progress(df).collect()} == {("en", 2, 2), ("ru", 1, 0), ("fr", 1, 1)}
    assert errors.annotation_help(df).count() == 5


def test_suggested_categories(spark):
    rows = [
        ["a b c d", "a b x", "entailment", "Low", "SVO", "en"],
        ["he is not here", "he left", "neutral", "Low", "SVO", "en"],
        ["NOT a b", "c nicht d", "neutral", "Low", "SVO", "en"],
        ["一不二", "三四", "neutral", "Low", "SVO", "zh"],
        ["knot notes", "other things", "neutral", "High", "VSO", "de"],
        ["x y", "z w", "neutral", "Medium", "V2/SOV", "de"],
        ["x y", "z w", "neutral", None, None, "de"],
        ["p, q!", "r?", "neutral", "High", "SVO", "ar"],
        ["p q", "r", "neutral", "High", "SVO", "ar"],
    ]
    ddl = "premise STRING, hypothesis STRING, predicted_label STRING, morphology STRING, word_order STRING, language STRING"
    df = literal_frame(spark, rows, ddl)
    got = {(r.premise, r.morphology): r.suggested_category for r in errors.suggest_category(df).collect()}
    assert [got[r[0], r[3]] for r in rows] == ["E1", "E2", None, "E2", "E4", "E5", None, "E3", "E4"]


def test_script_histogram_matches_python(spark):
    texts = [*TOKEN_TEXTS, ("hi", "नमस्ते दुनिया 123"), ("ja", "カタカナー ﾊﾝｶｸ ａｂ"), ("xx", "ªº µ ǅ 𝒜 😀 ꟊ"), ("xx", ""), ("yy", "123")]
    df = literal_frame(spark, [*texts, ("zz", None), (None, "abc")], "lang STRING, text STRING")
    want = {}
    for lang, text in [*texts, (None, "abc")]:
        for ch in text:
            if ch.isalpha():
                want.setdefault(lang, Counter())[unicodedata.name(ch, "UNKNOWN").split()[0]] += 1
    got = {}
    for r in profiling.script_histogram(profiling.char_counts(df)).collect():
        got.setdefault(r.lang, Counter())[r.script] = r.n
    assert got == want
    top = profiling.top_scripts(profiling.script_histogram(profiling.char_counts(df)), 1).collect()
    assert {r.lang: r.script for r in top}["ru"] == "CYRILLIC"


def test_char_counts_in_blocks_and_first_rows(spark, monkeypatch):
    monkeypatch.setattr(profiling, "BLOCK_CHARS", 7)
    rows = [[i, "en", "ab" * (i % 5) + "é"] for i in range(50)]
    df = literal_frame(spark, rows, "id BIGINT, lang STRING, text STRING")
    got = {r.ch: r.n for r in profiling.char_counts(df).collect()}
    assert got == dict(Counter("".join(r[2] for r in rows)))
    got = {r.ch: r.n for r in profiling.char_counts(df, first=10, order="id").collect()}
    assert got == dict(Counter("".join(r[2] for r in rows[:10])))


def test_char_counts_hold_one_block_of_a_batch(spark):
    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, count, _):
            self.count = count
            return self

        groupBy = agg = where = select

    frame = Frame()
    profiling.char_counts(frame)
    texts = ["猫a\U00031350" * 300_000, None, *["é" * 1_000_000] * 12]
    batch = pa.RecordBatch.from_pydict({"grp": ["zh", "zh", None, *["fr"] * 11], "text": texts})
    want = {("zh", c): 300_000 for c in "猫a\U00031350"} | {(None, "é"): 1_000_000, ("fr", "é"): 11_000_000}
    tracemalloc.start()
    got = Counter()
    for part in frame.count(iter([batch])):
        for r in part.to_pylist():
            got[r["grp"], chr(r["code_point"])] += r["n"]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want
    assert peak < 60e6


def test_token_ratios(spark):
    got = {r.lang: (r.tokens, r.words) for r in profiling.token_word_ratio(token_texts(spark), "text", ["lang"]).collect()}
    assert got["en"] == (10, 9) and got["zh"] == (2, 1)
    by_lang = {r.lang: r.ratio for r in profiling.token_word_ratio_by_language(token_texts(spark)).collect()}
    assert by_lang["en"] == pytest.approx(10 / 9)


def test_counts_match_the_listed_tokens(spark, monkeypatch):
    monkeypatch.setattr(profiling, "BLOCK_CHARS", 40)
    rng = random.Random(9)
    alphabet = ["a", "Z", "9", "é", "e\u0301", "ß", "猫", "か", "क", "\u093f", "ا", "\u0651", ".", "-", "_", "😀", " ", " ", "\n", "\u00a0", "\u3000", "\x1c", "\u200b"]
    rows = [[i, "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 60])))] for i in range(300)]
    df = literal_frame(spark, [*rows, [300, None]], "i INT, t STRING")
    counted = df.select(
        "i", profiling.count_tokens_and_words(df, "t").alias("c"), text.token_count("t").alias("n"), text.word_count("t").alias("w"),
        *[(text.first_tokens("t", k) == F.slice(text.tokens("t"), 1, k)).alias(f"k{k}") for k in (1, 4, 500)],
    )
    for row in counted.collect():
        assert (row.c.tokens, row.c.words) == (row.n, row.w), row
        assert row.k1 and row.k4 and row.k500


def test_label_distribution(spark):
    rows = [["train", 0], ["train", 0], ["train", 2], ["train", 7], ["test", 1], ["other", 1]]
    table = profiling.label_distribution(literal_frame(spark, rows, "split STRING, label INT"), NLI_LABELS)
    got = {(r.split, r.label): (r["count"], r.pct) for r in table.collect()}
    assert got["train", 0] == (2, 50.0) and got["train", 1] == (0, 0.0) and got["train", 2] == (1, 25.0)
    assert got["test", 1] == (1, 100.0) and got["validation", 0] == (0, None) and len(got) == 9
    spread = {r.split: r.pct_spread for r in profiling.label_balance(table).collect()}
    assert spread == {"train": 50.0, "test": 100.0, "validation": None}


def test_sizes_and_lengths(spark):
    rows = [["en", "train", "a" * 4], ["en", "test", "b"], ["de", "train", "ü"], ["en", "train", "ab"]]
    df = literal_frame(spark, rows, "lang STRING, split STRING, text STRING")
    assert {tuple(r) for r in profiling.dataset_sizes(df).collect()} == {("en", 2, 0, 1), ("de", 1, 0, 0)}
    got = {r.lang: tuple(r)[1:] for r in profiling.text_length_stats(df).collect()}
    assert got == {"en": (3, pytest.approx(7 / 3), 2, 4, 4), "de": (1, 1.0, 1, 1, 1)}


def test_history(spark):
    log = literal_frame(spark, [[1, 1, 2.0], [1, 2, 1.0], [2, 1, 0.5]], "epoch INT, step BIGINT, loss DOUBLE")
    assert {tuple(r) for r in history.epoch_loss(log).collect()} == {(1, 2, 1.5), (2, 1, 0.5)}
    rng = random.Random(4)
    rows = [[run, e, rng.choice([0.0, 0.25, 0.5, 0.75])] for run in "ab" for e in range(12)]
    table = history.best_epoch(literal_frame(spark, rows, "run STRING, epoch INT, val_accuracy DOUBLE"), "run")
    got = {(r.run, r.epoch): (r.best_before, r.is_best) for r in table.collect()}
    for run in "ab":
        best = 0.0
        for _, epoch, value in [r for r in rows if r[0] == run]:
            assert got[run, epoch] == (best, value > best)
            best = max(best, value)
