"""Corpus statistics: labels, sizes, scripts, tokens per word, lengths, structure."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lingospan.config import SPLITS
from lingospan.functions import text
from lingospan.operators.ordering import first_n_per_group
from lingospan.schemas import literal_frame


def label_distribution(df: DataFrame, names: Sequence[str], splits: Sequence[str] = SPLITS) -> DataFrame:
    """Count of each label in each split, zeros included, and percent of all rows of the split.

    Labels outside ``names`` count in the denominator only. One aggregation: a conditional count per label.
    """
    wanted = literal_frame(df.sparkSession, [[s] for s in splits], "split STRING")
    counted = df.groupBy("split").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("label") == i).alias(f"_{i}") for i in range(len(names))],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("label"),
                F.lit(name).alias("name"),
                F.coalesce(F.col(f"_{i}"), F.lit(0)).alias("count"),
            )
            for i, name in enumerate(names)
        ]
    )
    return (
        wanted.join(counted, "split", "left")
        .select("split", "total", F.inline(rows))
        .withColumn("pct", F.try_divide(F.col("count") * F.lit(100.0), F.col("total")))
        .drop("total")
    )


def label_balance(distribution: DataFrame) -> DataFrame:
    """Spread between the most and least frequent label of each split, in percentage points."""
    return distribution.groupBy("split").agg((F.max("pct") - F.min("pct")).alias("pct_spread"))


def dataset_sizes(df: DataFrame, splits: Sequence[str] = SPLITS) -> DataFrame:
    """Rows per language, one column per split."""
    return df.groupBy("lang").pivot("split", list(splits)).agg(F.count(F.lit(1))).na.fill(0)


BLOCK_CHARS = 1 << 21
_CODE_POINTS = "grp STRING, code_point INT, n BIGINT"


def _stretches(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows whose sizes add up to about ``limit``; a larger row is alone or ends one."""
    block = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(sizes)]
    return ((i, j) for i, j in zip(cuts, cuts[1:]) if j > i)


def _pieces(texts: pa.Array, limit: int) -> Iterator[str]:
    """The characters of all texts in strings made from at most ``limit`` bytes, or one character, cut between characters."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32 if pa.types.is_string(texts.type) else np.int64)
    at, end = offsets[texts.offset], offsets[texts.offset + len(texts)]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    while at < end:
        stop = min(end, at + max(limit, 4))
        for _ in range(3):
            if stop < end and data[stop] & 0xC0 == 0x80:
                stop -= 1
        yield data[at:stop].tobytes().decode("utf-8")
        at = stop


def char_counts(
    df: DataFrame, column: str = "text", group: str = "lang", first: int | None = None, order: str | None = None
) -> DataFrame:
    """Occurrences of each letter per group: (group, ch, n).

    Each Arrow batch is counted with numpy, so the shuffle carries one row per group, block and distinct
    character rather than one per character of text. Texts stay in Arrow's bytes but for one block at a time.
    Whether a character is a letter is decided afterwards on the distinct ones. ``first`` looks only at the first
    rows of each group by ``order``.
    """
    if first is not None:
        df = first_n_per_group(df, [group], order, first)

    def block_counts(groups: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        encoded = groups.dictionary_encode(null_encoding="encode")
        for code, key in enumerate(encoded.dictionary.to_pylist()):
            for piece in _pieces(texts.filter(pc.equal(encoded.indices, code)), BLOCK_CHARS):
                totals = np.bincount(np.frombuffer(piece.encode("utf-32-le"), dtype=np.uint32))
                seen = np.flatnonzero(totals)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key] * len(seen), pa.string()),
                        pa.array(seen, pa.int32()),
                        pa.array(totals[seen], pa.int64()),
                    ],
                    names=["grp", "code_point", "n"],
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for i, j in _stretches(sizes, BLOCK_CHARS):
                rows = batch.slice(i, j - i).filter(batch.column(1).slice(i, j - i).is_valid())
                yield from block_counts(rows.column(0), rows.column(1))
            del batch

    counted = (
        df.select(F.col(group).alias("grp"), F.col(column).alias("text"))
        .mapInArrow(count, _CODE_POINTS)
        .groupBy("grp", "code_point")
        .agg(F.sum("n").alias("n"))
    )
    return counted.select(F.col("grp").alias(group), _letter("code_point").alias("ch"), "n").where("ch IS NOT NULL")


@F.pandas_udf(T.StringType())
def _letter(code_points: pd.Series) -> pd.Series:
    """The character, or NULL if it is no letter. Python decides, whose Unicode tables also name its script."""
    return code_points.map(lambda point: chr(point) if chr(point).isalpha() else None)


@F.pandas_udf(T.StringType())
def script_of(characters: pd.Series) -> pd.Series:
    """First word of the Unicode name of a character, UNKNOWN when it has none."""
    return characters.map(lambda ch: unicodedata.name(ch, "UNKNOWN").split()[0])


def script_histogram(char_counts: DataFrame, group: str = "lang") -> DataFrame:
    """Letters per script: the name lookup runs on distinct characters only."""
    named = char_counts.withColumn("script", script_of("ch"))
    return named.groupBy(group, "script").agg(F.sum("n").alias("n"))


def top_scripts(histogram: DataFrame, k: int = 3, group: str = "lang") -> DataFrame:
    """The ``k`` most frequent scripts per group; ties go to the smaller name."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "script"))
    return histogram.withColumn("rank", place).where(F.col("rank") <= k)


SPACE, WORD_PART, OTHER = range(3)


_KINDS: list[np.ndarray] = []


def _character_kinds(spark: SparkSession) -> np.ndarray:
    """Whether each code point separates words, is part of a run of letters, marks and digits, or stands alone.

    The patterns that list tokens and words decide, once per driver: one small job over all code points.
    """
    if not _KINDS:
        surrogate = F.col("id").between(0xD800, 0xDFFF)
        ch = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        kind = (
            F.when(surrogate, OTHER)
            .when(~F.rlike(ch, F.lit(text.WORD_PATTERN)), SPACE)
            .when(F.rlike(ch, F.lit(text.WORD_PART_PATTERN)), WORD_PART)
            .otherwise(OTHER)
        )
        rows = spark.range(sys.maxunicode + 1).select("id", kind.cast("byte").alias("kind")).toArrow()
        kinds = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
        kinds[rows.column("id").to_numpy()] = rows.column("kind").to_numpy()
        _KINDS.append(kinds)
    return _KINDS[0]


def _count_block(texts: list[str], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and words of each text, from the kinds of the characters of all of them in one array."""
    ends = np.cumsum([len(t) for t in texts])
    kind = kinds[np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)]
    before = np.empty_like(kind)
    before[1:] = kind[:-1]
    starts = np.concatenate([[0], ends[:-1]])
    before[starts[starts < len(kind)]] = SPACE

    def per_text(marks: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(marks)])
        return running[ends] - running[starts]

    return (
        per_text((kind == OTHER) | ((kind == WORD_PART) & (before != WORD_PART))),
        per_text((kind != SPACE) & (before == SPACE)),
    )


def count_tokens_and_words(df: DataFrame, column: str) -> Column:
    """STRUCT<tokens, words> of a text column, counted with numpy over Arrow batches.

    Counts what ``text.tokens`` and ``text.words`` list, without listing it: several times faster than a
    regular expression.
    """
    shared = df.sparkSession.sparkContext.broadcast(_character_kinds(df.sparkSession))

    @F.arrow_udf("tokens bigint, words bigint")
    def count(batch: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.utf8_length(batch), 0).to_numpy(zero_copy_only=False)
        parts = [
            _count_block(pc.fill_null(batch.slice(i, j - i), "").to_pylist(), shared.value)
            for i, j in _stretches(sizes, BLOCK_CHARS)
        ]
        columns = [np.concatenate([p[k] for p in parts]) if parts else [] for k in range(2)]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["tokens", "words"])

    return count(F.col(column))


def token_word_ratio(df: DataFrame, column: str = "text", keep: Sequence[str] = ("example_id",)) -> DataFrame:
    """Tokens, words and tokens per word of each text; NULL for a text without words."""
    counted = df.select(*keep, count_tokens_and_words(df, column).alias("_c")).select(*keep, "_c.tokens", "_c.words")
    return counted.withColumn("ratio", F.try_divide(F.col("tokens").cast("double"), F.col("words")))


def token_word_ratio_by_language(df: DataFrame, column: str = "text", lang: str = "lang") -> DataFrame:
    """Tokens per word over all texts of a language."""
    return (
        token_word_ratio(df, column, [lang])
        .groupBy(lang)
        .agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words"))
        .withColumn("ratio", F.try_divide(F.col("tokens").cast("double"), F.col("words")))
    )


def text_length_stats(df: DataFrame, column: str = "text", lang: str = "lang") -> DataFrame:
    """Length in characters per language: rows, mean, median, 95th percentile, maximum.

    Rows are first reduced to one per language and length, spread over all tasks; the exact percentiles
    then come from a running count over those.
    """
    counts = (
        df.select(lang, F.length(column).cast("bigint").alias("chars"))
        .groupBy(lang, "chars")
        .agg(F.count("*").alias("n"))
    )
    by_lang = Window.partitionBy(lang)
    running = counts.withColumns(
        {
            "upto": F.sum("n").over(by_lang.orderBy(F.asc_nulls_last("chars"))),
            "filled": F.sum(F.when(F.col("chars").isNotNull(), F.col("n"))).over(by_lang),
        }
    )

    def percentile(percent: int) -> Column:
        return F.min(F.when(F.col("upto") * 100 >= F.col("filled") * percent, F.col("chars")))

    return running.groupBy(lang).agg(
        F.sum("n").alias("n"),
        F.try_divide(F.sum(F.col("chars") * F.col("n")).cast("double"), F.max("filled")).alias("avg_chars"),
        percentile(50).alias("p50_chars"),
        percentile(95).alias("p95_chars"),
        F.max("chars").alias("max_chars"),
    )


def array_shapes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and the shortest and longest array of each column, from one scan."""
    sizes = df.agg(
        F.count("*").alias("rows"),
        *[F.min(F.size(c)).alias(f"_min_{c}") for c in columns],
        *[F.max(F.size(c)).alias(f"_max_{c}") for c in columns],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"_min_{c}").cast("bigint").alias("min_size"),
                F.col(f"_max_{c}").cast("bigint").alias("max_size"),
            )
            for c in columns
        ]
    )
    return sizes.select("rows", F.inline(rows))


def feature_types(df: DataFrame) -> DataFrame:
    """Column names and types; reads no data."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return literal_frame(df.sparkSession, rows, "position INT, column STRING, type STRING")
