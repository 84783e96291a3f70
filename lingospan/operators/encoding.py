"""Vocabulary fitting and encoding of texts to fixed-length id arrays.

Layout: ``<s> A </s> </s> B </s>`` for a pair and ``<s> A </s>`` for one text, padded with ``<pad>``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lingospan.config import PAIR_MAX_LENGTH, work_folder
from lingospan.functions import text
from lingospan.functions.multilingual import language_text
from lingospan.functions.worker import kept

# Special tokens, in id order.
SPECIAL_TOKENS = ["<s>", "<pad>", "</s>", "<unk>"]
BOS, PAD, EOS, UNK = range(len(SPECIAL_TOKENS))
PADDINGS = ("max_length", "longest", "none")

Tokenizer = Callable[[Column], Column]


def count_words(df: DataFrame, columns: Sequence[str], tokenizer: Tokenizer = text.tokens) -> DataFrame:
    """Occurrences of each word over all rows and the given text columns."""
    listed = F.concat(*[tokenizer(text.text_or_empty(c)) for c in columns])
    return df.select(F.explode(listed).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def fit_vocabulary(
    df: DataFrame, columns: Sequence[str], size: int | None, tokenizer: Tokenizer = text.tokens
) -> DataFrame:
    """The ``size`` most frequent words as (token_id, word, n); ties go to the smaller word. None: all words.

    The count at which the vocabulary ends is found first from the counts of counts, so only words at or
    above it reach the final sort, not the long tail of rare words.
    """
    counts = count_words(df, columns, tokenizer)
    if size is None:
        return _all_words(counts)
    # One row per distinct count: about the square root of the number of tokens at most.
    per_count = counts.groupBy("n").agg(F.count("*").alias("words"))
    more_frequent = F.sum("words").over(Window.orderBy(F.desc("n"))) - F.col("words")
    cut = per_count.select("n", more_frequent.alias("ahead")).where(F.col("ahead") < size)
    # A scalar subquery; the shuffle of the word counts is made once and read by both branches.
    kept = counts.where(F.col("n") >= cut.agg(F.min("n")).scalar())
    top = kept.orderBy(F.desc("n"), "word").limit(size)
    place = F.row_number().over(Window.orderBy(F.desc("n"), "word"))
    return top.select((place + len(SPECIAL_TOKENS) - 1).cast("int").alias("token_id"), "word", "n")


def _all_words(counts: DataFrame) -> DataFrame:
    """Every word with its id. Words are ranked within their count, and within the first bytes of the word, and
    each part starts where the parts before it end; so no task sorts all words."""
    part = F.substring(F.col("word").cast("binary"), 1, 3)
    parted = counts.withColumn("_part", F.hex(part))
    sizes = parted.groupBy("n", "_part").agg(F.count("*").alias("_words"))
    # A row for each count and beginning of a word: far fewer than words.
    before = Window.orderBy(F.desc("n"), "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("n", "_part", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("n", "_part").orderBy("word"))
    numbered = parted.join(starts, ["n", "_part"])
    return numbered.select(
        (F.col("_start") + place + len(SPECIAL_TOKENS) - 1).cast("int").alias("token_id"), "word", "n"
    )


# Bytes of words, with eight more for each, that a vocabulary on the driver and in every worker may take.
MAX_BYTES = 256 << 20
# Bytes of words whose index weighs as much as a model among what a worker keeps.
INDEX_BYTES = 64 << 20
# Rows whose distinct words are looked up together when the vocabulary is not broadcast.
LOOKUP_ROWS = 4096


class Vocabulary:
    """A fitted vocabulary, sent to the executors once.

    Only its words pass through the driver, and no more than ``MAX_BYTES`` of them.
    """

    def __init__(self, spark: SparkSession, words: Sequence[str]):
        self.spark = spark
        self.words = list(words)
        self._key = uuid.uuid4().hex
        self._shared = spark.sparkContext.broadcast(pa.array(self.words, pa.string()))

    @classmethod
    def from_frame(cls, frame: DataFrame) -> Vocabulary:
        """Raises before anything is collected or broadcast if the words take more than ``MAX_BYTES``."""
        bytes_ = frame.agg(F.coalesce(F.sum(F.octet_length("word") + 8), F.lit(0))).first()[0]
        if bytes_ > MAX_BYTES:
            raise ValueError(f"a vocabulary of {bytes_:,} bytes is too large to hold; the limit is {MAX_BYTES:,}")
        rows = frame.select("token_id", "word").orderBy("token_id").toArrow()
        return cls(frame.sparkSession, rows.column("word").to_pylist())

    @classmethod
    def fit(
        cls, df: DataFrame, columns: Sequence[str], size: int | None, tokenizer: Tokenizer = text.tokens
    ) -> Vocabulary:
        return cls.from_frame(fit_vocabulary(df, columns, size, tokenizer))

    def save(self, path: str) -> None:
        table = pa.table(
            {
                "token_id": pa.array(range(len(SPECIAL_TOKENS), len(self)), pa.int32()),
                "word": pa.array(self.words, pa.string()),
            }
        )
        self.spark.createDataFrame(table).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Vocabulary:
        return cls.from_frame(spark.read.parquet(path))

    def __len__(self) -> int:
        return len(SPECIAL_TOKENS) + len(self.words)

    def ids_of(self, tokens: Column) -> Column:
        """Ids of an ARRAY<STRING>; unknown words give ``<unk>``. One hash lookup per Arrow batch."""
        shared, first, unknown, key = self._shared, len(SPECIAL_TOKENS), UNK, self._key

        @F.arrow_udf("array<int>")
        def lookup(batch: pa.Array) -> pa.Array:
            # Python is asked for distinct words only.
            words = pc.dictionary_encode(batch.flatten())
            index = _index_of(shared, key)
            known = [unknown if (at := index.get(w)) is None else at + first for w in words.dictionary.to_pylist()]
            return pa.ListArray.from_arrays(_offsets(batch), pa.array(known, pa.int32()).take(words.indices))

        return lookup(tokens)

    def attach_ids(self, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Replace columns of tokens by columns of ids."""
        return rows.select(*[self.ids_of(F.col(c)).alias(c) if c in columns else c for c in rows.columns])

    def words_of(self, ids: Column) -> Column:
        """Tokens of an ARRAY<INT>; ids outside the vocabulary give ``<unk>``."""
        shared, specials, unknown = self._shared, list(SPECIAL_TOKENS), UNK

        @F.arrow_udf("array<string>")
        def lookup(batch: pa.Array) -> pa.Array:
            table = pa.concat_arrays([pa.array(specials, pa.string()), shared.value])
            flat = batch.flatten()
            known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table)))
            return pa.ListArray.from_arrays(_offsets(batch), table.take(pc.if_else(known, flat, unknown)))

        return lookup(ids)


class VocabularyTable:
    """A fitted vocabulary of any size, as a table of (token_id, word) that is never collected or broadcast.

    Words are found by a join. So that a word in most texts is no hot key, rows are taken in blocks of
    ``LOOKUP_ROWS``: the join has each word once per block, and the block's words then come back to its rows.
    """

    def __init__(self, frame: DataFrame):
        self.frame = frame.select("word", F.col("token_id").cast("int").alias("token_id"))

    def attach_ids(self, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Replace columns of tokens by columns of ids; unknown words give ``<unk>``.

        The rows are stored first. A block is a run of rows of a stored file, so its size is bounded whatever the
        rows hold, and a repeated task finds the same blocks.
        """
        spark, columns, unknown = rows.sparkSession, list(columns), UNK
        path = work_folder(spark, "tokens")
        rows.write.parquet(path)
        block = F.xxhash64("_metadata.file_path", F.expr(f"_metadata.row_index div {LOOKUP_ROWS}"))
        blocks = spark.read.schema(rows.schema).parquet(path).select("*", block.alias("_block"))
        listed = F.array_distinct(F.concat(*columns))
        words = blocks.select("_block", F.explode(listed).alias("word")).distinct()
        found = words.join(self.frame, "word").select("_block", "word", "token_id").toDF("_of", "_word", "_id")

        def lookup(left: pa.Table, right: pa.Table) -> pa.Table:
            out = left.drop_columns(["_block"])
            known, ids = right["_word"].combine_chunks(), right["_id"].combine_chunks()
            for c in columns:
                tokens = pa.chunked_array(left[c], left.schema.field(c).type).combine_chunks()
                places = pc.index_in(tokens.flatten(), value_set=known)
                listed = pa.ListArray.from_arrays(_offsets(tokens), pc.fill_null(ids.take(places), unknown))
                out = out.set_column(out.schema.get_field_index(c), c, listed)
            return out

        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        schema = ", ".join(f"`{c}` {'array<int>' if c in columns else kind}" for c, kind in kinds.items())
        return blocks.groupBy("_block").cogroup(found.groupBy("_of")).applyInArrow(lookup, schema)


def _index_of(shared: Broadcast, key: str) -> dict[str, int]:
    """Places of the words of a broadcast vocabulary, made once in a Python worker."""
    weight = shared.value.nbytes / INDEX_BYTES
    return kept(("vocabulary", key), lambda: {w: i for i, w in enumerate(shared.value.to_pylist())}, weight)


def _offsets(lists: pa.Array) -> pa.Array:
    """Start offsets of the flattened lists; a null list counts as empty."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0)
    return pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(lengths).cast(pa.int32())])


def truncated_lengths(a: Column, b: Column, budget: int) -> tuple[Column, Column]:
    """Lengths after removing words from the longer text until both fit; the second gives way on a tie."""
    half = (budget + 1) // 2
    keep_a = F.least(a, F.greatest(F.lit(budget) - b, F.lit(half)))
    return keep_a, F.least(b, F.lit(budget) - keep_a)


def _ids(*values: int) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _kept_tokens(c: Column, budget: int, tokenizer: Tokenizer) -> Column:
    """The tokens that can survive truncation; no others are sent to Python.

    A tokenizer may have a function ``first(column, n)`` that reads a text no further than its n-th token.
    """
    first = getattr(tokenizer, "first", None)
    return first(c, budget) if first else F.slice(tokenizer(c), 1, budget)


def encode(
    df: DataFrame,
    vocabulary: Vocabulary | VocabularyTable,
    first: str = "premise",
    second: str | None = "hypothesis",
    max_length: int = PAIR_MAX_LENGTH,
    padding: str = "max_length",
    batch: str | None = None,
    label: str | None = "label",
    keep: Sequence[str] = ("example_id",),
    lang: str | None = None,
    missing: str = "empty",
    tokenizer: Tokenizer = text.tokens,
) -> DataFrame:
    """``keep`` columns, ``input_ids``, ``attention_mask`` and ``labels``; all other columns are dropped.

    ``padding`` is ``max_length``, ``none``, or ``longest``: up to the longest row of the whole frame, or
    of each ``batch`` when a batch column is given. For the longest of the frame the ids are stored, so that the width is
    known without encoding twice. ``lang`` selects the language of multilingual columns. A ``Vocabulary`` is broadcast
    and needs no shuffle; a ``VocabularyTable`` is joined.
    """
    if padding not in PADDINGS:
        raise ValueError(f"padding must be one of {PADDINGS}")
    texts = [c for c in (first, second) if c is not None]
    budget = max_length - (4 if second is not None else 2)
    if budget < 1:
        raise ValueError("max_length leaves no room for text")
    listed = {c: _kept_tokens(language_text(df, c, lang or "", missing), budget, tokenizer) for c in texts}
    carried = [*keep, *([batch] if batch and batch not in keep else [])]
    labels = [F.col(label).alias("labels")] if label else []
    parts = [f"_{i}" for i in range(len(texts))]
    rows = df.select(*carried, *labels, *[listed[c].alias(p) for c, p in zip(texts, parts)])
    rows = vocabulary.attach_ids(rows, parts)
    if second is None:
        body = F.concat(_ids(BOS), F.slice("_0", 1, budget), _ids(EOS))
    else:
        len_a, len_b = truncated_lengths(F.size("_0"), F.size("_1"), budget)
        body = F.concat(
            _ids(BOS), F.slice("_0", F.lit(1), len_a), _ids(EOS, EOS), F.slice("_1", F.lit(1), len_b), _ids(EOS)
        )
    rows = rows.select(*carried, *(["labels"] if label else []), body.alias("_ids"))
    length = F.size("_ids")
    if padding == "none":
        width = length
    elif padding == "max_length":
        width = F.lit(max_length)
    elif batch:
        width = F.max(length).over(Window.partitionBy(batch))
    else:
        rows, longest = _stored_with_longest(rows)
        width = F.lit(longest)
    rows = rows.withColumn("_pad", width - length)
    return rows.select(
        *keep,
        F.concat("_ids", F.array_repeat(F.lit(PAD), F.col("_pad"))).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), length), F.array_repeat(F.lit(0), F.col("_pad"))).alias(
            "attention_mask"
        ),
        *(["labels"] if label else []),
    )


def _stored_with_longest(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows as a stored table, and the largest size of ``_ids``, taken while they were written."""
    spark, longest = rows.sparkSession, Observation()
    path = work_folder(spark, "encoded")
    rows.observe(longest, F.max(F.size("_ids")).alias("size")).write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path), longest.get["size"] or 0


def encode_paraphrase(df: DataFrame, vocabulary: Vocabulary, **options) -> DataFrame:
    """Encode a (sentence1, sentence2, label) table."""
    return encode(df, vocabulary, **{"first": "sentence1", "second": "sentence2", "keep": ("id",), **options})


def decode_ids(
    df: DataFrame, vocabulary: Vocabulary, column: str = "input_ids", first: int | None = None, out: str = "tokens"
) -> DataFrame:
    """Add the tokens of an id array: all, or the ``first`` ones for a preview."""
    ids = F.col(column) if first is None else F.slice(column, 1, first)
    return df.withColumn(out, vocabulary.words_of(ids))
