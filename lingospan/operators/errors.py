"""Mining, describing, summarising and annotating misclassified examples."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lingospan.config import ERRORS_PER_LANGUAGE, work_folder
from lingospan.functions import text
from lingospan.functions.labels import decode_label
from lingospan.operators.ordering import first_n_per_group, join_same
from lingospan.operators.pairs import nonempty_pairs
from lingospan.operators.profiling import count_tokens_and_words
from lingospan.schemas import ERROR_CATEGORIES, NLI_LABELS, literal_frame

ATTRIBUTES = ("family", "script", "morphology", "word_order")


def misclassified(df: DataFrame) -> DataFrame:
    return df.where(F.col("predicted_label") != F.col("gold_label"))


def with_language_attributes(
    df: DataFrame, languages: DataFrame, lang: str = "language", strict: bool = False
) -> DataFrame:
    """Add language_name, family, script, morphology and word_order.

    A language without an entry gets NULLs, or fails the job when ``strict``. No broadcast is forced: the
    entries are a frame of known size, and Catalyst broadcasts it while it is small.
    """
    entries = languages.select(
        F.col("language").alias(lang), F.col("name").alias("language_name"), *ATTRIBUTES
    )
    joined = df.join(entries, lang, "left")
    if strict:
        unknown = F.raise_error(F.concat(F.lit("no attributes for language "), F.col(lang))).cast("string")
        joined = joined.withColumn("language_name", F.coalesce("language_name", unknown))
    return joined


def collect_errors(
    scored: DataFrame,
    languages: DataFrame,
    max_errors: int = ERRORS_PER_LANGUAGE,
    names: Sequence[str] = NLI_LABELS,
    order: str = "example_id",
    lang: str = "lang",
    strict: bool = False,
) -> DataFrame:
    """The first ``max_errors`` misclassified pairs of each language (at least one), as error records.

    Pairs with an empty side are not considered. ``id`` restarts at 1 in every language.
    """
    wrong = misclassified(nonempty_pairs(scored)).select(
        order, F.col(lang).alias("language"), "premise", "hypothesis", "gold_label", "predicted_label",
        "confidence", "probs",
    )
    first = first_n_per_group(wrong, ["language"], order, max(max_errors, 1), "id")
    described = with_language_attributes(first, languages, "language", strict)
    probs = F.struct(*[F.get("probs", i).alias(name) for i, name in enumerate(names)])
    return described.select(
        F.col("id").cast("int").alias("id"),
        "language",
        "language_name",
        *ATTRIBUTES,
        "premise",
        "hypothesis",
        decode_label("gold_label", names).alias("gold_label"),
        decode_label("predicted_label", names).alias("predicted_label"),
        "confidence",
        probs.alias("probs"),
        F.lit("").alias("error_category"),
        F.lit("").alias("notes"),
    )


def rows_checked(
    scored: DataFrame, languages: Sequence[str], max_errors: int = ERRORS_PER_LANGUAGE, order: str = "example_id",
    lang: str = "lang",
) -> DataFrame:
    """How many non-empty rows are visited per language until its ``max_errors``-th error (all, if fewer).

    Rows are scored once: their ids, and whether they are wrong, are stored. The id of the last error is then
    found from the first-N rows, and rows up to it are counted: no running sum over a whole language.
    """
    limit = max(max_errors, 1)
    rows = nonempty_pairs(scored).where(F.col(lang).isin(list(languages)))
    rows = rows.select(order, lang, (F.col("predicted_label") != F.col("gold_label")).alias("wrong"))
    path = work_folder(scored.sparkSession, "checked")
    rows.write.parquet(path)
    rows = scored.sparkSession.read.schema(rows.schema).parquet(path)
    last = (
        first_n_per_group(rows.where("wrong"), [lang], order, limit, "rank")
        .where(F.col("rank") == limit)
        .select(lang, F.col(order).alias("_last"))
    )
    # At most one row per requested language.
    visited = rows.join(F.broadcast(last), lang, "left").where(
        F.col("_last").isNull() | (F.col(order) <= F.col("_last"))
    )
    return visited.groupBy(lang).agg(F.count("*").alias("checked"), F.count_if("wrong").alias("errors"))


def _grouped(errors: DataFrame, key: str, *extra: Column) -> DataFrame:
    return errors.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("count"), *extra)


def ranked(counts: DataFrame, *by: str | Column) -> DataFrame:
    """Add ``rank`` (1, 2, ...) in the given order, and order the rows by it.

    For tables of one row per language or category: the window spans all of them.
    """
    place = F.row_number().over(Window.orderBy(*by)).cast("bigint")
    return counts.withColumn("rank", place).orderBy("rank")


def total_errors(errors: DataFrame) -> DataFrame:
    """The number of errors, in one row."""
    return errors.agg(F.count("*").alias("errors"))


def errors_by_language(errors: DataFrame) -> DataFrame:
    return _grouped(errors, "language_name", F.avg("confidence").alias("avg_confidence"))


def errors_by_script(errors: DataFrame) -> DataFrame:
    return _grouped(errors, "script")


def errors_by_morphology(errors: DataFrame) -> DataFrame:
    return _grouped(errors, "morphology")


SUMMARY_KEYS = ("language_name", "family", "script", "morphology", "word_order")


def error_summary(errors: DataFrame, keys: Sequence[str] = SUMMARY_KEYS) -> DataFrame:
    """Count and mean confidence by each of the attributes and over all errors (``total``), from one scan.

    Rows are first reduced to one per combination of attributes; the grouping sets then expand only
    those, not the errors themselves.
    """
    keys = list(keys)
    base = errors.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.sum("confidence").alias("_sum"), F.count("confidence").alias("_m")
    )
    sets = base.groupingSets([[], *[[k] for k in keys]], *keys).agg(
        F.sum("_n").alias("count"),
        F.sum("_sum").alias("_sum"),
        F.sum("_m").alias("_m"),
        *[F.grouping(k).alias(f"_{k}") for k in keys],
    )
    dimension, value = F.lit("total"), F.lit("all")
    for k in keys:
        dimension = F.when(F.col(f"_{k}") == 0, k).otherwise(dimension)
        value = F.when(F.col(f"_{k}") == 0, F.col(k)).otherwise(value)
    return sets.select(
        dimension.alias("dimension"),
        value.alias("value"),
        "count",
        F.try_divide("_sum", "_m").alias("avg_confidence"),
    ).where(F.col("value").isNotNull())


def error_confusion(errors: DataFrame, names: Sequence[str] = NLI_LABELS) -> DataFrame:
    """Gold x predicted counts of the errors, one column per predicted name, zeros filled in.

    ``gold_label`` and ``predicted_label`` hold names.
    """
    counted = errors.groupBy("gold_label").pivot("predicted_label", list(names)).agg(F.count(F.lit(1)))
    return counted.na.fill(0)


def category_distribution(annotated: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotated categories with count, description, and percent of all rows and of annotated rows.

    The window spans one row per category, not the data.
    """
    counts = annotated.groupBy("error_category").agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    known = F.sum(F.when(F.col("error_category").isNotNull(), F.col("count"))).over(Window.partitionBy())
    shares = counts.select(
        F.col("error_category").alias("code"),
        "count",
        (F.col("count") / total * 100).alias("pct"),
        (F.col("count") / known * 100).alias("pct_of_annotated"),
    ).where(F.col("code").isNotNull())
    return shares.join(categories, "code", "left").select(
        "code", "count", "pct", "pct_of_annotated", F.coalesce("description", F.lit("Unknown")).alias("description")
    )


OTHER_CATEGORY = "other"


def category_crosstab(
    annotated: DataFrame, key: str, categories: Sequence[str] | None = None
) -> DataFrame:
    """Count of each category per ``key``, zeros filled in; unannotated rows and NULL keys are left out.

    Codes outside ``categories`` are counted in the column ``other``. Without ``categories`` Spark finds the
    codes in use with one extra small job.
    """
    rows = annotated.where(F.col("error_category").isNotNull() & F.col(key).isNotNull())
    if categories is None:
        return rows.groupBy(key).pivot("error_category").agg(F.count(F.lit(1))).na.fill(0)
    listed = F.when(F.col("error_category").isin(list(categories)), F.col("error_category"))
    rows = rows.withColumn("_category", F.coalesce(listed, F.lit(OTHER_CATEGORY)))
    pivoted = rows.groupBy(key).pivot("_category", [*categories, OTHER_CATEGORY])
    return pivoted.agg(F.count(F.lit(1))).na.fill(0)


def has_annotations(df: DataFrame) -> bool:
    """True when at least one row carries a category."""
    return "error_category" in df.columns and not df.where(F.col("error_category").isNotNull()).isEmpty()


def annotation_progress(annotated: DataFrame, key: str = "language") -> DataFrame:
    """Annotated and total rows per language."""
    return annotated.groupBy(key).agg(
        F.count("*").alias("total"), F.count("error_category").alias("annotated")
    )


# Negation words named in the category definitions.
NEGATION_WORDS = ["not", "لا", "不", "nicht"]


def _negated(column: str, negations: Sequence[str]) -> Column:
    """A negation word as a token of its own; one in a script written without spaces anywhere."""
    spaced = "|".join(re.escape(w) for w in negations if not _is_han(w))
    unspaced = [re.escape(w) for w in negations if _is_han(w)]
    inside = r"[\p{L}\p{M}\p{N}]"
    pattern = "|".join([rf"(?<!{inside})(?:{spaced})(?!{inside})", *unspaced])
    return F.rlike(column, F.lit(f"(?iu){pattern}"))


def _is_han(word: str) -> bool:
    return any("\u4e00" <= c <= "\u9fff" for c in word)


def suggest_category(
    errors: DataFrame, entailment: str = NLI_LABELS[0], negations: Sequence[str] = NEGATION_WORDS
) -> DataFrame:
    """Add ``suggested_category``, a first guess from the category definitions; the first that fits wins.

    E1: half of the distinct hypothesis words are in the premise and entailment was predicted. E2: exactly
    one side is negated. E3: more tokens per word than the mean of the language. E4: high morphology. E5:
    word order other than SVO. ``error_category`` stays for people to fill in. Every language has its mean,
    a NULL language too. Texts are counted once: the rows are stored with their ratio, and the means read only that.
    """
    both = errors.withColumn("_text", F.concat_ws(" ", F.col("premise"), F.col("hypothesis")))
    counted = both.withColumn("_c", count_tokens_and_words(both, "_text"))
    measured = counted.select(
        *errors.columns,
        F.try_divide(F.col("_c.tokens").cast("double"), F.col("_c.words").cast("double")).alias("_ratio"),
    )
    path = work_folder(errors.sparkSession, "measured")
    measured.write.parquet(path)
    measured = errors.sparkSession.read.schema(measured.schema).parquet(path)
    # Texts are split only where the rule can apply.
    mentioned = F.array_distinct(text.tokens("hypothesis"))
    overlap = F.try_divide(
        F.size(F.array_intersect(mentioned, text.tokens("premise"))).cast("double"), F.size(mentioned).cast("double")
    )
    overlapping = F.when(F.col("predicted_label") == entailment, overlap >= 0.5)
    means = measured.groupBy("language").agg(F.avg("_ratio").alias("_mean"))
    joined = join_same(measured, means, ["language"], "left")
    return joined.withColumn(
        "suggested_category",
        F.when(overlapping, "E1")
        .when(_negated("premise", negations) != _negated("hypothesis", negations), "E2")
        .when(F.col("_ratio") > F.col("_mean"), "E3")
        .when(F.col("morphology") == "High", "E4")
        .when(F.col("word_order") != "SVO", "E5"),
    ).drop("_ratio", "_mean")


def annotation_help(df: DataFrame) -> DataFrame:
    """The codes an annotator may enter, with their meaning."""
    return literal_frame(df.sparkSession, ERROR_CATEGORIES, "code STRING, description STRING")
