"""Evaluation of predictions: accuracy per language, transfer gap, confusion, comparison, typology.

Every operator aggregates first (partial sums before the shuffle), so a language holding most of the rows
costs no more than any other. What follows works on one row per language or cell.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lingospan.schemas import MORPHOLOGY_LEVELS, literal_frame


def _correct() -> Column:
    return F.count_if(F.col("predicted_label") == F.col("gold_label"))


def accuracy(df: DataFrame) -> DataFrame:
    """Rows, correct rows and accuracy over the whole frame; NULL accuracy for an empty frame."""
    return df.agg(F.count("*").alias("n"), _correct().alias("correct")).withColumn(
        "accuracy", F.try_divide(F.col("correct").cast("double"), F.col("n"))
    )


def accuracy_by_language(df: DataFrame, languages: Sequence[str], lang: str = "lang") -> DataFrame:
    """One row per requested language in list order; a language without rows has n = 0 and NULL accuracy."""
    counted = (
        df.where(F.col(lang).isin(list(languages)))
        .groupBy(lang)
        .agg(F.count("*").alias("n"), _correct().alias("correct"))
    )
    wanted = literal_frame(df.sparkSession, list(enumerate(languages)), f"position INT, {lang} STRING")
    # At most one row per requested language.
    return wanted.join(F.broadcast(counted), lang, "left").select(
        "position",
        lang,
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("correct", F.lit(0)).alias("correct"),
        F.try_divide(F.col("correct").cast("double"), F.col("n")).alias("accuracy"),
    )


def add_gap(by_language: DataFrame, source_lang: str = "en", lang: str = "lang") -> DataFrame:
    """Add ``gap``: accuracy on the source language (0 when it has none) minus accuracy here.

    The window spans one row per requested language, not the data.
    """
    everything = Window.partitionBy()
    source = F.max(F.when(F.col(lang) == source_lang, F.col("accuracy"))).over(everything)
    return by_language.withColumn("gap", F.coalesce(source, F.lit(0.0)) - F.col("accuracy"))


def zero_shot_eval(
    df: DataFrame, languages: Sequence[str], source_lang: str = "en", lang: str = "lang"
) -> DataFrame:
    """Accuracy per language with its gap to the source language, from one scan of the predictions."""
    return add_gap(accuracy_by_language(df, languages, lang), source_lang, lang)


def macro_average(by_language: DataFrame, exclude: Sequence[str] = (), lang: str = "lang") -> DataFrame:
    """Unweighted mean accuracy over languages; the source language counts unless excluded."""
    if exclude:
        by_language = by_language.where(~F.col(lang).isin(list(exclude)))
    return by_language.agg(F.count("accuracy").alias("languages"), F.avg("accuracy").alias("macro_accuracy"))


def zero_shot_report(
    df: DataFrame, languages: Sequence[str], source_lang: str = "en", lang: str = "lang"
) -> DataFrame:
    """The per-language table with an ``Average`` row at the end.

    The average comes out of the same aggregation as a grouping-set total, so the data is read once.
    """
    table = zero_shot_eval(df, languages, source_lang, lang)
    return (
        table.groupingSets([[lang], []], lang)
        .agg(
            F.coalesce(F.max(F.when(F.col(lang).isNotNull(), F.col("position"))), F.lit(0)).alias("position"),
            F.avg("accuracy").alias("accuracy"),
            F.max("gap").alias("gap"),
            F.grouping(lang).alias("_total"),
        )
        .select(
            F.when(F.col("_total") == 1, len(languages)).otherwise(F.col("position")).alias("position"),
            F.when(F.col("_total") == 1, "Average").otherwise(F.col(lang)).alias("language"),
            "accuracy",
            F.when(F.col("_total") == 0, F.col("gap")).alias("gap"),
        )
    )


def confusion_by_language(df: DataFrame, num_classes: int = 3, lang: str = "lang") -> DataFrame:
    """Every gold x predicted cell per language, zeros included."""
    counts = df.groupBy(lang, "gold_label", "predicted_label").agg(F.count("*").alias("n"))
    cells = [(g, p) for g in range(num_classes) for p in range(num_classes)]

    def cell(g: int, p: int) -> Column:
        here = (F.col("gold_label") == g) & (F.col("predicted_label") == p)
        return F.sum(F.when(here, F.col("n")).otherwise(0))

    wide = counts.groupBy(lang).agg(*[cell(g, p).alias(f"_{g}_{p}") for g, p in cells])
    rows = F.array(
        *[
            F.struct(
                F.lit(g).alias("gold_label"), F.lit(p).alias("predicted_label"), F.col(f"_{g}_{p}").alias("n")
            )
            for g, p in cells
        ]
    )
    return wide.select(lang, F.inline(rows))


def macro_prf(df: DataFrame, num_classes: int = 3, lang: str = "lang") -> DataFrame:
    """Macro precision, recall and F1 per language; an undefined ratio counts as 0."""
    counts = df.groupBy(lang, "gold_label", "predicted_label").agg(F.count("*").alias("n"))
    gold, predicted = F.col("gold_label"), F.col("predicted_label")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).cast("double")

    sums = counts.groupBy(lang).agg(
        *[total((gold == c) & (predicted == c)).alias(f"_tp{c}") for c in range(num_classes)],
        *[total(predicted == c).alias(f"_predicted{c}") for c in range(num_classes)],
        *[total(gold == c).alias(f"_gold{c}") for c in range(num_classes)],
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    def mean(parts: list[Column]) -> Column:
        return reduce(add, parts) / num_classes

    classes = range(num_classes)
    return sums.select(
        lang,
        mean([ratio(F.col(f"_tp{c}"), F.col(f"_predicted{c}")) for c in classes]).alias("macro_precision"),
        mean([ratio(F.col(f"_tp{c}"), F.col(f"_gold{c}")) for c in classes]).alias("macro_recall"),
        mean(
            [ratio(2 * F.col(f"_tp{c}"), F.col(f"_predicted{c}") + F.col(f"_gold{c}")) for c in classes]
        ).alias("macro_f1"),
    )


def compare_models(
    a: DataFrame, b: DataFrame, keys: Sequence[str] = ("example_id", "lang"), lang: str = "lang"
) -> DataFrame:
    """Two models on the same examples, per language: agreement, who is right where, accuracy difference.

    ``n`` counts the examples that either has. An example without a prediction, because it failed or because a
    model never saw it, is one that this model has not got right: ``missing_a`` and ``missing_b`` count them.
    """
    keys = list(keys)
    right_a = a.select(*keys, F.col("gold_label").alias("_gold_a"), F.col("predicted_label").alias("_a"))
    right_b = b.select(
        *[F.col(k).alias(f"_b_{k}") for k in keys], F.col("gold_label").alias("_gold_b"), F.col("predicted_label").alias("_b")
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys])
    both = right_a.join(right_b, same, "full").withColumn("_gold", F.coalesce("_gold_a", "_gold_b"))
    both = both.withColumns({k: F.coalesce(k, f"_b_{k}") for k in keys})
    hit_a, hit_b = (F.coalesce(F.col(c) == F.col("_gold"), F.lit(False)) for c in ("_a", "_b"))
    return (
        both.groupBy(lang)
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("_a") == F.col("_b")).alias("agree"),
            F.count_if(hit_a & hit_b).alias("both_right"),
            F.count_if(hit_a & ~hit_b).alias("only_a"),
            F.count_if(~hit_a & hit_b).alias("only_b"),
            F.count_if(F.col("_a").isNull()).alias("missing_a"),
            F.count_if(F.col("_b").isNull()).alias("missing_b"),
        )
        .withColumns(
            {
                "agreement": F.col("agree") / F.col("n"),
                "accuracy_delta": (F.col("only_b") - F.col("only_a")) / F.col("n"),
            }
        )
    )


TYPOLOGY_FEATURES = ("family", "script", "morphology", "word_order")


def typology_gap(by_language: DataFrame, languages: DataFrame, lang: str = "lang") -> DataFrame:
    """Mean accuracy and gap of the languages sharing a family, script, morphology or word order.

    Both inputs hold one row per language.
    """
    joined = by_language.join(languages, F.col(lang) == F.col("language"), "left")
    features = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in TYPOLOGY_FEATURES]
    )
    return (
        joined.select("accuracy", "gap", F.inline(features))
        .where(F.col("value").isNotNull() & F.col("accuracy").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count("*").alias("languages"), F.avg("accuracy").alias("avg_accuracy"), F.avg("gap").alias("avg_gap"))
    )


def typology_corr(by_language: DataFrame, languages: DataFrame, lang: str = "lang") -> DataFrame:
    """Correlation of morphological complexity (1 low .. 3 high) with the transfer gap."""
    level = F.array_position(F.array(*[F.lit(m) for m in MORPHOLOGY_LEVELS]), F.col("morphology"))
    joined = by_language.join(languages, F.col(lang) == F.col("language")).where(F.col("gap").isNotNull())
    return joined.select(level.cast("double").alias("level"), "gap").agg(
        F.count("*").alias("languages"), F.corr("level", "gap").alias("morphology_gap_corr")
    )
