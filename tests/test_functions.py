import math

import pytest
from pyspark.sql import functions as F

from lingospan.functions import labels, text, vectors
from lingospan.functions.multilingual import language_text
from lingospan.schemas import NER_LABELS, NLI_LABELS, label_dim, language_dim, literal_frame
from lingospan.sources.examples import EXAMPLE_PAIRS, TOKEN_TEXTS, example_pairs, token_texts


def one(df, *columns):
    return df.select(*columns).first()


def test_strip_and_words_match_python(spark):
    samples = [
        "", "   ", " ", "　a b ", "\x1ca\x1db\x1f", "no break", " tab\tline\n ", "a​b",
        "\u0085x y", *[t for _, t in TOKEN_TEXTS],
    ]
    rows = literal_frame(spark, [[i, s] for i, s in enumerate(samples)], "i INT, t STRING")
    got = rows.select("i", text.strip_text("t").alias("s"), text.words("t").alias("w")).collect()
    for row in got:
        assert row.s == samples[row.i].strip()
        assert row.w == samples[row.i].split()


def test_tokens(spark):
    row = one(
        literal_frame(spark, [["It's 3.5% über、कि 素早い!"]], "t STRING"), text.tokens("t").alias("t")
    )
    assert row.t == ["It", "'", "s", "3", ".", "5", "%", "über", "、", "कि", "素早い", "!"]


def test_has_text_keeps_white_space(spark):
    rows = literal_frame(spark, [["a"], [" "], [""], [None]], "t STRING")
    assert [r[0] for r in rows.select(text.has_text("t")).collect()] == [True, True, False, False]


def test_ratio_without_words_is_null(spark):
    rows = literal_frame(spark, [["a b."], ["  "], [None]], "t STRING")
    assert [r[0] for r in rows.select(text.token_word_ratio("t")).collect()] == [1.5, None, None]


def test_previews(spark):
    df = spark.createDataFrame([("😀" * 3 + "x" * 100, list("abcdefghijklmnopq")), ("ab", ["a"])], "t string, a array<string>")
    rows = df.select(text.preview_text("t", 5), text.preview_list("a", 15)).collect()
    assert rows[0][0] == "😀😀😀xx..." and rows[0][1].endswith("o]...")
    assert rows[1][0] == "ab..." and rows[1][1] == "[a]"


def test_softmax_and_argmax(spark):
    cases = [[1.0, 2.0, 3.0], [1000.0, 1000.0, -1000.0], [0.0, 0.0, 0.0], [-5.0, 5.0, 5.0]]
    df = literal_frame(spark, cases, "a DOUBLE, b DOUBLE, c DOUBLE")
    got = df.select(vectors.softmax(["a", "b", "c"]).alias("p"), vectors.argmax(["a", "b", "c"]).alias("k")).collect()
    for case, row in zip(cases, got):
        weights = [math.exp(x - max(case)) for x in case]
        assert row.p == pytest.approx([w / sum(weights) for w in weights])
        assert row.k == case.index(max(case))


def test_decode_and_encode_labels(spark):
    df = literal_frame(spark, [[-1], [0], [2], [7], [None]], "k INT")
    got = df.select(labels.decode_label("k"), labels.decode_label("k", otherwise="contradiction")).collect()
    assert [r[0] for r in got] == [None, "entailment", "contradiction", None, None]
    assert [r[1] for r in got] == ["contradiction", "entailment", "contradiction", "contradiction", "contradiction"]
    names = literal_frame(spark, [["neutral"], ["Neutral"], [None]], "n STRING")
    assert [r[0] for r in names.select(labels.encode_label("n")).collect()] == [1, None, None]


def test_decode_paraphrase_and_tags(spark):
    df = literal_frame(spark, [[0], [1], [2]], "k INT")
    assert [r[0] for r in df.select(labels.decode_paraphrase("k")).collect()] == [
        "Not paraphrase", "Paraphrase", "Not paraphrase",
    ]
    tags = spark.createDataFrame([([0, 1, 6, 7, -1],), ([],)], "t array<int>")
    got = [r[0] for r in tags.select(labels.decode_tags("t", NER_LABELS)).collect()]
    assert got == [["O", "B-PER", "I-LOC", None, None], []]


def test_formats(spark):
    df = literal_frame(spark, [[0, 0.875, -0.05]], "k INT, p DOUBLE, g DOUBLE")
    row = one(df, labels.format_prediction("k", "p"), labels.format_accuracy("p"), labels.format_gap("g"),
              labels.format_percent(F.col("p") * 100))
    assert list(row) == ["✅ **Entailment** (87.5% confidence)", "0.8750", "-0.0500", " 87.5%"]


def map_frame(spark):
    """Maps written in SQL keep their order; a Python dict would not."""
    return spark.sql(
        """SELECT * FROM VALUES (0, map('en', 'a', 'de', 'b')), (1, map('fr', 'c', 'de', 'd')),
           (2, CAST(map() AS MAP<STRING, STRING>)), (3, NULL), (4, map('en', NULL, 'de', 'x')) AS t(i, t)"""
    )


def texts(df, *args):
    return [r[0] for r in df.orderBy("i").select(language_text(df, *args)).collect()]


def test_language_policies(spark):
    df = map_frame(spark)
    assert texts(df, "t", "en", "empty") == ["a", "", "", "", ""]
    assert texts(df, "t", "en", "first") == ["a", "c", "", "", ""]
    assert texts(df.where("i = 0"), "t", "en", "error") == ["a"]
    for i in (1, 2, 3):
        with pytest.raises(Exception, match="t has no text in language en"):
            texts(df.where(f"i = {i}"), "t", "en", "error")
    with pytest.raises(ValueError):
        language_text(df, "t", "en", "skip")


def test_plain_text_passes_through(spark):
    df = literal_frame(spark, [[0, "x"], [1, None]], "i INT, t STRING")
    assert texts(df, "t", "zz", "error") == ["x", ""]


def test_parallel_arrays(spark):
    ddl = "i int, t struct<language: array<string>, translation: array<string>>"
    df = spark.createDataFrame([(0, (["en", "de"], ["a", "b"])), (1, (["fr"], ["c"]))], ddl)
    assert texts(df, "t", "de", "first") == ["b", "c"]


def test_dimensions_and_examples(spark):
    assert language_dim(spark, [("fr", "French", "Romance", "Latin", "Medium", "SVO")]).count() == 7
    assert label_dim(spark).count() == len(NLI_LABELS) + 2 + len(NER_LABELS)
    assert example_pairs(spark).count() == len(EXAMPLE_PAIRS) == 13
    assert token_texts(spark).count() == 6
    assert literal_frame(spark, [], "a INT, b STRING").count() == 0
