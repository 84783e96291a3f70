import random
import re

import pytest
from pyspark.sql import functions as F

from lingospan.operators import encoding, profiling
from lingospan.operators.encoding import BOS, EOS, PAD, UNK, Vocabulary
from lingospan.schemas import literal_frame

WORDS = [f"w{i}" for i in range(30)]


def sentence(rng, low=0, high=12):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high)))


def plain_truncate(a, b, budget):
    """Drop words one at a time from the longer list; the second gives way on a tie."""
    a, b = list(a), list(b)
    while len(a) + len(b) > budget:
        (b if len(b) >= len(a) else a).pop()
    return a, b


@pytest.fixture(scope="module")
def vocabulary(spark):
    return Vocabulary(spark, WORDS[:20])


def rows_for(n, seed):
    rng = random.Random(seed)
    return [[i, sentence(rng), sentence(rng), rng.randint(0, 2)] for i in range(n)]


DDL = "example_id BIGINT, premise STRING, hypothesis STRING, label INT"


def ids(words):
    return [4 + WORDS.index(w) if w in WORDS[:20] else UNK for w in words]


@pytest.mark.parametrize("max_length", [5, 9, 12, 128])
def test_pairs_match_step_by_step_truncation(spark, vocabulary, max_length):
    rows = rows_for(150, max_length)
    got = {r.example_id: r for r in encoding.encode(literal_frame(spark, rows, DDL), vocabulary, max_length=max_length).collect()}
    for i, p, h, label in rows:
        a, b = plain_truncate(p.split(), h.split(), max_length - 4)
        real = [BOS, *ids(a), EOS, EOS, *ids(b), EOS]
        assert got[i].input_ids == real + [PAD] * (max_length - len(real))
        assert got[i].attention_mask == [1] * len(real) + [0] * (max_length - len(real))
        assert got[i].labels == label


def test_truncation_rule_on_all_lengths(spark):
    rows = [[a, b, budget] for a in range(14) for b in range(14) for budget in range(1, 12)]
    df = literal_frame(spark, rows, "a INT, b INT, budget INT")
    for budget in range(1, 12):
        part = df.where(F.col("budget") == budget)
        ka, kb = encoding.truncated_lengths(F.col("a"), F.col("b"), budget)
        for a, b, x, y in part.select("a", "b", ka.alias("x"), kb.alias("y")).collect():
            want = plain_truncate(range(a), range(b), budget)
            assert (x, y) == (len(want[0]), len(want[1])), (a, b, budget)


def test_paddings(spark, vocabulary):
    rows = [[1, "w1", "w2", 0], [2, "w1 w2 w3", "w2", 0], [3, "w1 w2", "", 0]]
    df = literal_frame(spark, rows, DDL).withColumn("batch_id", F.when(F.col("example_id") < 3, 0).otherwise(1))

    def sizes(**options):
        frame = encoding.encode(df, vocabulary, max_length=20, **options)
        return {r.example_id: len(r.input_ids) for r in frame.collect()}

    assert sizes(padding="none") == {1: 6, 2: 8, 3: 6}
    assert sizes(padding="longest") == {1: 8, 2: 8, 3: 8}
    assert sizes(padding="longest", batch="batch_id") == {1: 8, 2: 8, 3: 6}
    assert sizes(padding="max_length") == {1: 20, 2: 20, 3: 20}
    with pytest.raises(ValueError):
        sizes(padding="widest")


def test_single_text_and_language_map(spark, vocabulary):
    df = spark.sql("SELECT 1 AS example_id, map('en', 'w1 w2', 'de', 'w3') AS premise, 2 AS label")
    row = encoding.encode(df, vocabulary, second=None, max_length=6, lang="de").first()
    assert row.input_ids == [BOS, 7, EOS, PAD, PAD, PAD] and row.labels == 2
    row = encoding.encode(df, vocabulary, second=None, max_length=4, lang="fr", missing="first", padding="none").first()
    assert row.input_ids == [BOS, 5, 6, EOS]


def test_own_tokenizer(spark, vocabulary):
    df = literal_frame(spark, [[1, "w1|w2", "w3", 0]], DDL)
    row = encoding.encode(df, vocabulary, padding="none", tokenizer=lambda c: F.split(c, r"\|")).first()
    assert row.input_ids == [BOS, 5, 6, EOS, EOS, 7, EOS]


def test_null_and_empty_texts(spark, vocabulary):
    df = literal_frame(spark, [[1, None, "", None]], DDL)
    row = encoding.encode(df, vocabulary, padding="none").first()
    assert row.input_ids == [BOS, EOS, EOS, EOS] and row.labels is None


def test_decode(spark, vocabulary):
    df = literal_frame(spark, [[1, "w1 zz", "w2", 0]], DDL)
    encoded = encoding.encode(df, vocabulary, max_length=9)
    row = encoding.decode_ids(encoded, vocabulary).first()
    assert row.tokens == ["<s>", "w1", "<unk>", "</s>", "</s>", "w2", "</s>", "<pad>", "<pad>"]
    odd = spark.createDataFrame([([0, -1, 999],), ([],)], "input_ids array<int>")
    assert [r.tokens for r in encoding.decode_ids(odd, vocabulary).collect()] == [["<s>", "<unk>", "<unk>"], []]


def test_vocabulary_too_large_to_hold(spark, monkeypatch):
    frame = spark.createDataFrame([(4, "long" * 5), (5, "word")], "token_id int, word string")
    monkeypatch.setattr(encoding, "MAX_BYTES", 39)
    with pytest.raises(ValueError, match="40 bytes"):
        encoding.Vocabulary.from_frame(frame)
    monkeypatch.setattr(encoding, "MAX_BYTES", 40)
    assert len(encoding.Vocabulary.from_frame(frame)) == 6


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_vocabulary_is_the_most_frequent_words(spark, size):
    rng = random.Random(size)
    rows = [[i, sentence(rng), sentence(rng) + " ü ü", 0] for i in range(60)]
    counts = {}
    for _, p, h, _ in rows:
        for w in re.findall(r"\w+", p + " " + h):
            counts[w] = counts.get(w, 0) + 1
    want = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0].encode()))[:size]
    got = encoding.fit_vocabulary(literal_frame(spark, rows, DDL), ["premise", "hypothesis"], size).orderBy("token_id").collect()
    assert [(r.word, r.n) for r in got] == want
    assert [r.token_id for r in got] == list(range(4, 4 + len(want)))


def test_vocabulary_save_and_load(spark, tmp_path, vocabulary):
    vocabulary.save(str(tmp_path / "words"))
    assert Vocabulary.load(spark, str(tmp_path / "words")).words == vocabulary.words
    assert len(vocabulary) == 24


def test_paraphrase_and_shapes(spark, vocabulary):
    df = literal_frame(spark, [[1, "w1", "w2", 1], [2, "w3 w4", "", 0]], "id BIGINT, sentence1 STRING, sentence2 STRING, label INT")
    encoded = encoding.encode_paraphrase(df, vocabulary, max_length=16)
    assert encoded.columns == ["id", "input_ids", "attention_mask", "labels"]
    shapes = {r.column: (r.rows, r.min_size, r.max_size) for r in profiling.array_shapes(encoded, ["input_ids", "attention_mask"]).collect()}
    assert shapes == {"input_ids": (2, 16, 16), "attention_mask": (2, 16, 16)}
    assert [tuple(r) for r in profiling.feature_types(encoded).collect()][1] == (1, "input_ids", "array<int>")


@pytest.fixture
def table(spark):
    words = [[4 + i, w] for i, w in enumerate(WORDS[:20])]
    return encoding.VocabularyTable(literal_frame(spark, words, "token_id INT, word STRING"))


@pytest.mark.parametrize("padding", ["max_length", "none", "longest"])
@pytest.mark.parametrize("block", [4096, 7])
def test_joined_vocabulary_gives_the_same(spark, vocabulary, table, monkeypatch, padding, block):
    monkeypatch.setattr(encoding, "LOOKUP_ROWS", block)
    rows = [*rows_for(120, 3), [500, None, "", 1], [501, "unseen words only", None, None], *[[502, "w1 " * 40, "w1", 0]] * 30]
    df = literal_frame(spark, rows, DDL).repartition(3)
    want = encoding.encode(df, vocabulary, max_length=20, padding=padding).collect()
    got = encoding.encode(df, table, max_length=20, padding=padding).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 152


def test_joined_vocabulary_keeps_other_columns(spark, vocabulary, table):
    df = literal_frame(spark, rows_for(20, 5), DDL).withColumn("word", F.lit("clash")).withColumn("at", F.array(F.struct(F.lit(1).alias("x"))))
    options = {"second": None, "first": "premise", "keep": ("example_id", "word", "at")}
    got, want = (encoding.encode(df, v, **options).collect() for v in (table, vocabulary))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_joined_vocabulary_of_nothing(spark, table):
    assert encoding.encode(literal_frame(spark, [], DDL), table).collect() == []
    empty = encoding.VocabularyTable(literal_frame(spark, [], "token_id INT, word STRING"))
    (row,) = encoding.encode(literal_frame(spark, [[1, "a b", "", 0]], DDL), empty, padding="none").collect()
    assert row.input_ids == [BOS, UNK, UNK, EOS, EOS, EOS]


def test_joined_vocabulary_is_not_broadcast(spark, table):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = encoding.encode(literal_frame(spark, rows_for(20, 5), DDL), table)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "FlatMapCoGroupsInArrow" in plan and "Broadcast" not in plan


def test_longest_of_the_call_encodes_once(spark, vocabulary):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def split(text):
        seen.add(1)
        return text.split()

    df = literal_frame(spark, rows_for(50, 8), DDL)
    got = encoding.encode(df, vocabulary, padding="longest", tokenizer=lambda c: split.asNondeterministic()(c))
    plan = got._jdf.queryExecution().executedPlan().toString()
    widths = {len(r.input_ids) for r in got.collect()}
    assert len(widths) == 1 and widths == {max(sum(r.attention_mask) for r in got.collect())}
    assert seen.value == 100 and "Python" not in plan
    empty = encoding.encode(literal_frame(spark, [], DDL), vocabulary, padding="longest")
    assert empty.collect() == []
