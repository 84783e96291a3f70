"""End-to-end jobs: train, evaluate, mine errors, analyse annotations, score a file."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingospan.config import Config, work_folder
from lingospan.functions.labels import format_accuracy, format_gap
from lingospan.operators import encoding, errors, evaluation, pairs, progressive, scoring, transfer
from lingospan.schemas import NLI_LABELS, category_dim, language_dim
from lingospan.sources import readers, writers

SHEET = "errors_for_annotation"
RECORDS = "errors_full"


def load_pairs(spark: SparkSession, config: Config) -> DataFrame:
    """The corpus as one row per example and language; a table of language maps is unpivoted on the way."""
    df = readers.load_splits(
        spark, [config.data_dir, *config.fallback_dirs], [config.train_split, config.eval_split]
    )
    if "lang" in df.columns:
        return df
    wanted = list(dict.fromkeys([config.source_lang, *config.eval_langs]))
    return pairs.unpivot_languages(df, wanted, "empty")


def prepare_sets(
    spark: SparkSession, config: Config, vocabulary: encoding.Vocabulary
) -> tuple[DataFrame, DataFrame]:
    """Encoded training rows of the source language, and encoded evaluation rows of all languages."""
    train, test = pairs.train_eval_frames(
        load_pairs(spark, config), config.source_lang, config.eval_langs, config.train_split, config.eval_split
    )
    options = {"max_length": config.max_length, "keep": ("example_id", "lang")}
    return encoding.encode(train, vocabulary, **options), encoding.encode(test, vocabulary, **options)


def eval_pairs(spark: SparkSession, config: Config) -> DataFrame:
    """Evaluation rows of all languages, with ``gold_label``."""
    _, test = pairs.train_eval_frames(
        load_pairs(spark, config), config.source_lang, config.eval_langs, config.train_split, config.eval_split
    )
    return test.withColumnRenamed("label", "gold_label")


def score_eval_split(spark: SparkSession, config: Config, scorer, **options) -> DataFrame:
    """Evaluation rows of all languages, scored once and stored; evaluation and error mining read the table."""
    path = work_folder(spark, "predictions")
    scored = scoring.score_pairs(eval_pairs(spark, config), scorer, **options)
    scored.write.parquet(path)
    return spark.read.schema(scored.schema).parquet(path)


def train(spark: SparkSession, config: Config) -> transfer.TransferResult:
    """Fit on the source language, evaluate on every language, save the pipeline."""
    result = transfer.train_and_evaluate(
        load_pairs(spark, config),
        config.eval_langs,
        config.source_lang,
        config.train_split,
        config.eval_split,
        num_features=config.num_features,
        max_iter=config.max_iter,
    )
    transfer.save_model(result.model, f"{config.checkpoint_dir}/pair_pipeline")
    return result


def report(scored: DataFrame, config: Config) -> DataFrame:
    """Accuracy and gap per language and their average, with display texts."""
    table = evaluation.zero_shot_report(scored, config.eval_langs, config.source_lang)
    shown = {"accuracy_text": format_accuracy("accuracy"), "gap_text": format_gap("gap")}
    return table.withColumns(shown).orderBy("position")


def compare(spark: SparkSession, config: Config, scorer_a, scorer_b, **options) -> DataFrame:
    """Two models, such as a baseline and a tuned one, on the same evaluation rows, per language."""
    scored = [score_eval_split(spark, config, scorer, **options) for scorer in (scorer_a, scorer_b)]
    return evaluation.compare_models(*scored)


@dataclass
class ErrorReport:
    """Error records with their summaries, or the analysis of an annotated sheet."""

    annotated: bool
    records: DataFrame
    summaries: dict[str, DataFrame]


def mine_errors(
    spark: SparkSession,
    scored: DataFrame,
    config: Config,
    languages: DataFrame | None = None,
    names: Sequence[str] = NLI_LABELS,
) -> ErrorReport:
    """Collect, summarise and export the first errors of each language.

    When the output folder already holds a sheet with annotations, that sheet is analysed instead.
    """
    sheet = f"{config.output_dir}/{SHEET}"
    if readers.path_exists(spark, sheet):
        annotated = readers.read_annotations(spark, sheet)
        if errors.has_annotations(annotated):
            return analyse_annotations(annotated)
    languages = language_dim(spark) if languages is None else languages
    rows = scored.where(F.col("lang").isin(config.eval_langs))
    path = f"{config.output_dir}/{RECORDS}"
    writers.write_json(errors.collect_errors(rows, languages, config.errors_per_language, names), path)
    records = readers.read_json_errors(spark, path)
    # At most errors_per_language rows for each requested language, so one file is enough.
    writers.write_annotation_sheet(records, sheet, one_file=True)
    return ErrorReport(
        False,
        records,
        {
            "by_language": errors.errors_by_language(records),
            "by_script": errors.errors_by_script(records),
            "by_morphology": errors.errors_by_morphology(records),
            "confusion": errors.error_confusion(records, names),
            "all_attributes": errors.error_summary(records),
        },
    )


def mine_errors_early(
    spark: SparkSession, pairs: DataFrame, scorer, config: Config, languages: DataFrame | None = None,
    names: Sequence[str] = NLI_LABELS,
) -> ErrorReport:
    """``mine_errors`` on pairs that are not scored yet: scoring stops once every language has its errors."""
    rows = pairs.where(F.col("lang").isin(config.eval_langs))
    scan = progressive.score_until(rows, lambda some: scoring.score_pairs(some, scorer, names), config.errors_per_language)
    return mine_errors(spark, scan.scored, config, languages, names)


def analyse_annotations(annotated: DataFrame) -> ErrorReport:
    """Category distribution and the two cross tables of an annotated sheet."""
    return ErrorReport(
        True,
        annotated,
        {
            "progress": errors.annotation_progress(annotated),
            "categories": errors.category_distribution(annotated, category_dim(annotated.sparkSession)),
            "by_language": errors.category_crosstab(annotated, "language_name"),
            "by_script": errors.category_crosstab(annotated, "script"),
        },
    )


def bulk_score(
    spark: SparkSession, source: str, schema: str, target: str, scorer, fmt: str = "csv", **options
) -> DataFrame:
    """Score the pairs of an uploaded CSV and export the results as CSV or JSON."""
    if fmt not in ("csv", "json"):
        raise ValueError("fmt must be csv or json")
    uploaded = readers.read_pairs_csv(spark, source, schema)
    scored = scoring.score_pairs(uploaded, scorer, validate=True, **options)
    flat = scored.withColumn("probs", F.to_json("probs")) if fmt == "csv" else scored
    (writers.write_csv if fmt == "csv" else writers.write_json)(flat, target)
    reader = readers.read_csv(spark, target, flat.schema) if fmt == "csv" else spark.read.schema(flat.schema).json(target)
    return reader
