"""The registered queries: every operator over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lingospan.config import PAIR_MAX_LENGTH, TOKEN_SEQUENCE_MAX_LENGTH, work_folder
from lingospan.functions import labels, multilingual, text, vectors
from lingospan.operators import encoding, epochs, errors, evaluation, history, ordering, pairs, profiling, progressive, scoring, transfer
from lingospan.plans import fixtures as fx
from lingospan.schemas import NER_LABELS, NLI_LABELS, category_dim, language_dim
from lingospan.sources import ingest, readers, registry, versions, writers
from lingospan import streaming

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

LANGUAGES = ["en", "de", "zh", "ar", "ru", "hi", "fr", "es"]
PRESENT = ["de", "en", "es", "fr"]
VOCABULARY_SIZE = 20_000


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def big(c: Column | str) -> Column:
    return text.col(c).cast("bigint")


def r6(c: Column | str) -> Column:
    return F.round(text.col(c), 6)


# ---- sources and sinks -------------------------------------------------------------------------------


@query
def load_splits(spark, sf_dir):
    """Rows and characters per split of a stored corpus, the first of two paths that exists."""
    paths = [f"{sf_dir}/no_such_corpus.parquet", f"{sf_dir}/documents.parquet"]
    documents = readers.load_first_existing(spark, paths, fx.TABLES["documents"])
    digit = F.col("doc_id") % 10
    split = F.when(digit < 8, "train").when(digit == 8, "validation").otherwise("test")
    return (
        documents.select(split.alias("split"), "n_chars")
        .groupBy("split")
        .agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    )


@query
def ingest_status(spark, sf_dir):
    """Two ingest runs into one folder: languages are saved, then skipped; a bad source is reported."""
    documents = fx.table(spark, sf_dir, "documents")
    target = work_folder(spark, "ingest")
    sources = {lang: (lambda lang=lang: documents.where(F.col("lang") == lang)) for lang in PRESENT}
    sources["ja"] = lambda: readers.load_first_existing(spark, [f"{sf_dir}/no_such_corpus.parquet"])
    first = ingest.ingest_languages(spark, "corpus", sources, target)
    second = ingest.ingest_languages(spark, "corpus", sources, target)
    runs = first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))
    rows = spark.read.parquet(f"{target}/corpus").groupBy("lang").agg(F.count("*").alias("n"))
    return runs.join(rows, "lang", "left").select(
        big("run").alias("run"), "lang", "status", F.coalesce("n", F.lit(0)).alias("n")
    )


@query
def load_languages(spark, sf_dir):
    """The corpus stored by language in one pass, then read back for two languages that exist and one that does not."""
    target = work_folder(spark, "by-language")
    documents = fx.table(spark, sf_dir, "documents")
    status = ingest.ingest_by_language(spark, "corpus", documents, ["de", "en", "fr", "zh"], target)
    stored = readers.load_languages(spark, [f"{target}/corpus"], ["de", "en", "zh"])
    sizes = stored.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return status.join(sizes, "lang", "left").select("lang", "status", "n", "chars")


@query
def dataset_sizes(spark, sf_dir):
    return profiling.dataset_sizes(fx.pairs_long(spark, sf_dir))


@query
def errors_csv_roundtrip(spark, sf_dir):
    """All error records to an annotation sheet and back."""
    path = work_folder(spark, "annotation-sheet")
    records = fx.errors(spark, sf_dir).select(
        F.col("example_id").cast("int").alias("id"), "language", "language_name", "premise", "hypothesis",
        labels.decode_label("gold_label").alias("gold_label"), F.col("predicted_name").alias("predicted_label"),
        "confidence", F.lit("").alias("error_category"), F.lit("say \"why\", then\nmore").alias("notes"),
        "family", "script", "morphology", "word_order", "probs",
    )
    writers.write_annotation_sheet(records, path)
    back = readers.read_annotations(spark, path)
    return back.select(
        big("id").alias("id"), "language", "language_name", F.md5("premise").alias("premise"),
        F.md5("hypothesis").alias("hypothesis"), "gold_label", "predicted_label", r6("confidence").alias("confidence"),
        "error_category", "notes", "family", "script", "morphology",
    )


@query
def errors_json_roundtrip(spark, sf_dir):
    """The first errors of each language as full JSON records and back."""
    path = work_folder(spark, "error-records")
    records = errors.collect_errors(fx.nli_predictions(spark, sf_dir), language_dim(spark))
    writers.write_json(records, path)
    return _flat_records(readers.read_json_errors(spark, path))


def _flat_records(records: DataFrame) -> DataFrame:
    return records.select(
        big("id").alias("id"), "language", "language_name", "family", "script", "morphology", "word_order",
        "premise", "hypothesis", "gold_label", "predicted_label", r6("confidence").alias("confidence"),
        r6("probs.entailment").alias("p_entailment"), r6("probs.neutral").alias("p_neutral"),
        r6("probs.contradiction").alias("p_contradiction"), "error_category", "notes",
    )


@query
def annotation_progress(spark, sf_dir):
    return errors.annotation_progress(fx.annotated_errors(spark, sf_dir))


def length_model() -> scoring.Model:
    """A stand-in for a user's model: logits from the lengths of the two texts."""

    def model(premises: pd.Series, hypotheses: pd.Series) -> np.ndarray:
        a, b = premises.str.len().to_numpy(), hypotheses.str.len().to_numpy()
        return np.stack([a % 7, b % 5, (a + b) % 6], axis=1) / 2.0

    return model


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pairs_from_turns(fx.table(spark, sf_dir, "conversations"))


def _scored_turns(scored: DataFrame) -> DataFrame:
    return scored.select(
        "conv_id", "turn", "predicted_name", r6("confidence").alias("confidence"), "status"
    )


@query
def bulk_score_csv(spark, sf_dir):
    """Pairs from a CSV upload, scored with a user's model, results stored as JSON."""
    upload, result = work_folder(spark, "upload"), work_folder(spark, "scored")
    writers.write_csv(_turn_pairs(spark, sf_dir), upload)
    schema = "conv_id BIGINT, turn BIGINT, premise STRING, hypothesis STRING"
    scored = scoring.score_pairs(readers.read_pairs_csv(spark, upload, schema), length_model)
    writers.write_json(scored, result)
    back = spark.read.schema(scored.schema).json(result)
    # The same as a sheet; what is read back from the two must agree.
    sheet = work_folder(spark, "scored-sheet")
    columns = ["conv_id", "turn", "predicted_name", "confidence", "status"]
    writers.write_csv(back.select(*columns), sheet)
    return _scored_turns(readers.read_csv(spark, sheet, back.select(*columns).schema))


@query
def encoded_shape_check(spark, sf_dir):
    encoded = _encoded(spark, sf_dir)
    return profiling.array_shapes(encoded, ["input_ids", "attention_mask"]).select(
        "rows", "column", "min_size", "max_size"
    )


@query
def attach_ids(spark, sf_dir):
    """Ids from stored order; on one file they are the row numbers."""
    placed = readers.attach_ids(fx.table(spark, sf_dir, "documents"))
    return placed.select("example_id", "doc_id")


# ---- projections, filters, predicates ----------------------------------------------------------------


def _texts(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "premise", "hypothesis", big("label").alias("label"))


@query
def select_lang_strict(spark, sf_dir):
    """Rows that have the language; on any other row the strict policy fails the job."""
    wide = fx.pairs_wide(spark, sf_dir).where(F.map_contains_key("premise", F.lit("de")))
    return _texts(pairs.select_language(wide, "de", "error"), "example_id")


@query
def select_lang_default(spark, sf_dir):
    return _texts(pairs.select_language(fx.pairs_wide(spark, sf_dir), "fr", "empty"), "example_id")


@query
def select_lang_first(spark, sf_dir):
    return _texts(pairs.select_language(fx.pairs_wide(spark, sf_dir), "fr", "first"), "example_id")


@query
def select_lang_plain(spark, sf_dir):
    """Plain text is passed through, whatever language is asked for."""
    rows = fx.pairs_long(spark, sf_dir)
    chosen = [multilingual.language_text(rows, c, "zh", "error").alias(c) for c in ("premise", "hypothesis")]
    return rows.select("example_id", *chosen, big("label").alias("label"))


@query
def catalog_open(spark, sf_dir):
    """A registered dataset stored by language, opened by name for some languages."""
    base = work_folder(spark, "catalog")
    writers.write_partitioned(fx.pairs_long(spark, sf_dir), f"{base}/xnli/all_languages", ["lang"])
    opened = registry.Catalog(spark, [f"{base}/none", base]).open("xnli", ["de", "fr", "zh"])
    return opened.groupBy("lang", "split").agg(F.count("*").alias("n"), F.sum(F.length("premise")).alias("chars"))


@query
def unpivot_languages(spark, sf_dir):
    return _texts(pairs.unpivot_languages(fx.pairs_wide(spark, sf_dir), ["en", "de", "fr"]), "example_id", "lang")


@query
def nonempty_pairs(spark, sf_dir):
    return _texts(pairs.nonempty_pairs(fx.pairs_long(spark, sf_dir)), "example_id")


@query
def validate_pairs(spark, sf_dir):
    checked = pairs.validate_pairs(fx.pairs_long(spark, sf_dir))
    return checked.select("example_id", "status", F.md5("premise").alias("premise"), F.md5("hypothesis").alias("hypothesis"))


@query
def train_eval_split(spark, sf_dir):
    """Training rows of the source language and evaluation rows of every language."""
    train, test = pairs.train_eval_frames(fx.pairs_long(spark, sf_dir), "en", PRESENT)
    sets = train.withColumn("use", F.lit("train")).unionByName(test.withColumn("use", F.lit("eval")))
    return sets.groupBy("use", "lang", "split").agg(
        F.count("*").alias("n"), F.sum(big(F.length("premise") + F.length("hypothesis"))).alias("chars")
    )


@query
def decode_labels(spark, sf_dir):
    return fx.nli_predictions(spark, sf_dir).select(
        "example_id",
        labels.decode_label("gold_label").alias("gold_name"),
        labels.decode_label("predicted_label").alias("predicted_name"),
        labels.decode_label(F.col("gold_label") + 1, otherwise="contradiction").alias("open_name"),
    )


@query
def encode_labels(spark, sf_dir):
    roles = ["system", "user"]
    return fx.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", big(labels.encode_label("role", roles)).alias("role_id")
    )


@query
def decode_paraphrase(spark, sf_dir):
    return fx.paraphrase_pairs(spark, sf_dir).select("id", "lang", labels.decode_paraphrase("label").alias("name"))


@query
def decode_ner_tags(spark, sf_dir):
    tags = labels.decode_tags("ner_tags", NER_LABELS)
    return fx.ner(spark, sf_dir).select(
        "id", big(F.size("tokens")).alias("tokens"), F.md5(F.array_join(tags, " ")).alias("tags")
    )


@query
def preview_pairs(spark, sf_dir):
    words = text.words("premise")
    return fx.pairs_long(spark, sf_dir).select(
        "example_id",
        text.preview_text("premise", 80).alias("premise"),
        text.preview_text("hypothesis", 50).alias("hypothesis"),
        text.preview_list(words, 15).alias("words"),
    )


@query
def format_predictions(spark, sf_dir):
    return fx.nli_predictions(spark, sf_dir).select(
        "example_id", labels.format_prediction("predicted_label", "confidence").alias("shown")
    )


@query
def confidence_long(spark, sf_dir):
    rows = scoring.confidence_rows(fx.nli_predictions(spark, sf_dir), NLI_LABELS)
    return rows.withColumn("confidence", r6("confidence"))


# ---- joins -------------------------------------------------------------------------------------------


@query
def enrich_errors(spark, sf_dir):
    return fx.errors(spark, sf_dir).select(
        "example_id", "language", "language_name", "family", "script", "morphology", "word_order"
    )


@query
def align_languages(spark, sf_dir):
    return pairs.align_languages(fx.paraphrase_pairs(spark, sf_dir), PRESENT)


@query
def pairs_from_turns(spark, sf_dir):
    return _turn_pairs(spark, sf_dir).select("conv_id", "turn", "premise", "hypothesis")


@query
def compare_models(spark, sf_dir):
    logits = fx.nli_logits(spark, sf_dir)
    both = evaluation.compare_models(scoring.score_logits(logits, fx.LOGITS_A), scoring.score_logits(logits, fx.LOGITS_B))
    return both.withColumns({"agreement": r6("agreement"), "accuracy_delta": r6("accuracy_delta")})


# ---- evaluation --------------------------------------------------------------------------------------


@query
def accuracy(spark, sf_dir):
    return evaluation.accuracy(fx.nli_predictions(spark, sf_dir)).withColumn("accuracy", r6("accuracy"))


@query
def zero_shot_eval(spark, sf_dir):
    table = evaluation.zero_shot_eval(fx.nli_predictions(spark, sf_dir), LANGUAGES)
    return table.select(
        big("position").alias("position"), "lang", "n", "correct", r6("accuracy").alias("accuracy"), r6("gap").alias("gap")
    )


@query
def zero_shot_report(spark, sf_dir):
    table = evaluation.zero_shot_report(fx.nli_predictions(spark, sf_dir), LANGUAGES)
    return table.select(
        big("position").alias("position"), "language", r6("accuracy").alias("accuracy"), r6("gap").alias("gap")
    )


@query
def macro_average(spark, sf_dir):
    by_language = evaluation.accuracy_by_language(fx.nli_predictions(spark, sf_dir), LANGUAGES)
    return evaluation.macro_average(by_language).withColumn("macro_accuracy", r6("macro_accuracy"))


@query
def confusion_by_language(spark, sf_dir):
    cells = evaluation.confusion_by_language(fx.nli_predictions(spark, sf_dir))
    return cells.select("lang", big("gold_label").alias("gold_label"), big("predicted_label").alias("predicted_label"), "n")


@query
def macro_prf(spark, sf_dir):
    table = evaluation.macro_prf(fx.nli_predictions(spark, sf_dir))
    return table.select("lang", *[r6(c).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1")])


@query
def typology_gap(spark, sf_dir):
    table = evaluation.zero_shot_eval(fx.nli_predictions(spark, sf_dir), LANGUAGES)
    grouped = evaluation.typology_gap(table, language_dim(spark))
    return grouped.withColumns({"avg_accuracy": r6("avg_accuracy"), "avg_gap": r6("avg_gap")})


@query
def typology_corr(spark, sf_dir):
    """With French and Spanish added to the language attributes, so that the correlation has four points."""
    extra = [("fr", "French", "Romance", "Latin", "Medium", "SVO"), ("es", "Spanish", "Romance", "Latin", "High", "SVO")]
    table = evaluation.zero_shot_eval(fx.nli_predictions(spark, sf_dir), LANGUAGES)
    corr = evaluation.typology_corr(table, language_dim(spark, extra))
    return corr.withColumn("morphology_gap_corr", r6("morphology_gap_corr"))


# ---- errors ------------------------------------------------------------------------------------------


@query
def error_records(spark, sf_dir):
    return _flat_records(errors.collect_errors(fx.nli_predictions(spark, sf_dir), language_dim(spark)))


@query
def error_records_progressive(spark, sf_dir):
    """The same records without scoring every pair: ranges of ids are scored until each language has its errors."""
    scan = progressive.score_until(fx.nli_logits(spark, sf_dir), lambda rows: scoring.score_logits(rows, fx.LOGITS_A))
    return _flat_records(errors.collect_errors(scan.scored, language_dim(spark)))


@query
def rows_checked_progressive(spark, sf_dir):
    """Rows visited until the last error needed, counted on the scored ranges alone."""
    scan = progressive.score_until(fx.nli_logits(spark, sf_dir), lambda rows: scoring.score_logits(rows, fx.LOGITS_A))
    return errors.rows_checked(scan.scored, LANGUAGES)


@query
def union_language_errors(spark, sf_dir):
    """Per-language error lists collected separately and appended."""
    # Predictions by language, as they are stored when every language is scored by itself.
    folder = work_folder(spark, "predictions")
    fx.nli_predictions(spark, sf_dir).write.partitionBy("lang").parquet(folder)
    scored = spark.read.parquet(folder)
    lists = [
        errors.collect_errors(scored.where(F.col("lang") == lang), language_dim(spark)) for lang in PRESENT
    ]
    union = lists[0]
    for part in lists[1:]:
        union = union.unionByName(part)
    return union.select(big("id").alias("id"), "language", "gold_label", "predicted_label", r6("confidence").alias("confidence"))


@query
def rows_checked(spark, sf_dir):
    return errors.rows_checked(fx.nli_predictions(spark, sf_dir), LANGUAGES)


@query
def errors_by_language(spark, sf_dir):
    table = errors.errors_by_language(fx.errors(spark, sf_dir))
    return table.withColumn("avg_confidence", r6("avg_confidence"))


@query
def errors_by_script(spark, sf_dir):
    return errors.errors_by_script(fx.errors(spark, sf_dir))


@query
def errors_by_morphology(spark, sf_dir):
    return errors.errors_by_morphology(fx.errors(spark, sf_dir))


@query
def error_summary_sets(spark, sf_dir):
    return errors.error_summary(fx.errors(spark, sf_dir)).withColumn("avg_confidence", r6("avg_confidence"))


@query
def error_confusion(spark, sf_dir):
    named = fx.errors(spark, sf_dir).select(
        labels.decode_label("gold_label").alias("gold_label"), F.col("predicted_name").alias("predicted_label")
    )
    return errors.error_confusion(named)


@query
def category_distribution(spark, sf_dir):
    table = errors.category_distribution(fx.annotated_errors(spark, sf_dir), category_dim(spark))
    return table.withColumns({"pct": r6("pct"), "pct_of_annotated": r6("pct_of_annotated")})


CATEGORIES_IN_USE = ["E1", "E2", "E3", "E4", "E5", "E9"]


@query
def category_by_language(spark, sf_dir):
    return errors.category_crosstab(fx.annotated_errors(spark, sf_dir), "language_name", CATEGORIES_IN_USE)


@query
def category_by_script(spark, sf_dir):
    return errors.category_crosstab(fx.annotated_errors(spark, sf_dir), "script", CATEGORIES_IN_USE)


@query
def suggest_category(spark, sf_dir):
    named = fx.errors(spark, sf_dir).withColumn("predicted_label", F.col("predicted_name"))
    return errors.suggest_category(named).select("example_id", "language", "suggested_category")


# ---- corpus statistics -------------------------------------------------------------------------------


@query
def label_distribution(spark, sf_dir):
    table = profiling.label_distribution(fx.pairs_long(spark, sf_dir), NLI_LABELS)
    return table.select("split", big("label").alias("label"), "name", "count", r6("pct").alias("pct"))


@query
def label_balance(spark, sf_dir):
    table = profiling.label_distribution(fx.pairs_long(spark, sf_dir), NLI_LABELS)
    return profiling.label_balance(table).withColumn("pct_spread", r6("pct_spread"))


@query
def char_script_counts(spark, sf_dir):
    return profiling.char_counts(fx.documents(spark, sf_dir))


@query
def script_histogram(spark, sf_dir):
    return profiling.script_histogram(profiling.char_counts(fx.documents(spark, sf_dir)))


@query
def top_scripts(spark, sf_dir):
    histogram = profiling.script_histogram(profiling.char_counts(fx.documents(spark, sf_dir)))
    return profiling.top_scripts(histogram).select("lang", "script", "n", big("rank").alias("rank"))


@query
def token_word_ratio(spark, sf_dir):
    return profiling.token_word_ratio(fx.documents(spark, sf_dir), "text", ["doc_id"]).withColumn("ratio", r6("ratio"))


@query
def token_word_ratio_by_language(spark, sf_dir):
    table = profiling.token_word_ratio_by_language(fx.documents(spark, sf_dir))
    return table.withColumn("ratio", r6("ratio"))


@query
def text_length_stats(spark, sf_dir):
    table = profiling.text_length_stats(fx.table(spark, sf_dir, "documents"))
    return table.withColumn("avg_chars", r6("avg_chars"))


@query
def sample_rows(spark, sf_dir):
    """The first 100 documents of each language."""
    first = ordering.first_n_per_group(fx.table(spark, sf_dir, "documents"), ["lang"], "doc_id", 100)
    return first.select("lang", big("rank").alias("rank"), "doc_id", "text")


@query
def first_rows(spark, sf_dir):
    """The first three documents."""
    return ordering.first_rows(fx.table(spark, sf_dir, "documents"), "doc_id", 3).select("doc_id", "lang", "text")


@query
def feature_types(spark, sf_dir):
    """Columns, types and filled rows of a table."""
    labelled = fx.table(spark, sf_dir, "labels")
    filled = labelled.agg(*[F.count(c).alias(c) for c in labelled.columns])
    counts = filled.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in labelled.columns]))
    )
    return profiling.feature_types(labelled).join(counts, "column").select(
        big("position").alias("position"), "column", "type", "filled"
    )


# ---- training history --------------------------------------------------------------------------------


@query
def epoch_loss(spark, sf_dir):
    return history.epoch_loss(fx.train_log(spark, sf_dir)).select(
        big("epoch").alias("epoch"), "steps", r6("avg_loss").alias("avg_loss")
    )


@query
def best_epoch(spark, sf_dir):
    return history.best_epoch(fx.epoch_log(spark, sf_dir)).select(
        big("epoch").alias("epoch"), r6("val_accuracy").alias("val_accuracy"), r6("best_before").alias("best_before"), "is_best"
    )


@query
def error_total(spark, sf_dir):
    return errors.total_errors(fx.errors(spark, sf_dir))


@query
def category_ranked(spark, sf_dir):
    """Categories as a list of value counts: the most frequent first, ties by code."""
    table = errors.category_distribution(fx.annotated_errors(spark, sf_dir), category_dim(spark))
    return errors.ranked(table.select("code", "count"), F.desc("count"), "code")


@query
def errors_by_language_ranked(spark, sf_dir):
    """Errors per language in ascending order of its name."""
    table = errors.errors_by_language(fx.errors(spark, sf_dir)).select("language_name", "count")
    return errors.ranked(table, "language_name")


@query
def category_unlisted(spark, sf_dir):
    """Codes that were not asked for are counted together."""
    return errors.category_crosstab(fx.annotated_errors(spark, sf_dir), "language", ["E1", "E2"])


@query
def char_scripts_shifted(spark, sf_dir):
    """Letters of documents whose a-z are mapped to Cyrillic, Greek and Han letters, one of them newer than the JVM."""
    other = "абвгдежзийклмαβγδεζηθ猫犬鳥\U00031350\U0002ebf0"
    texts = fx.documents(spark, sf_dir).select(
        "lang", F.translate("text", "abcdefghijklmnopqrstuvwxyz", other).alias("text")
    )
    return profiling.char_counts(texts).where(F.col("ch").isin(list(other)))


# ---- order and batches -------------------------------------------------------------------------------


@query
def assign_batches(spark, sf_dir):
    ids = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("example_id"))
    return ordering.assign_batches(ids).select("example_id", "row_index", "batch_id")


@query
def assign_batches_shuffled(spark, sf_dir):
    """Sizes of the batches of a seeded shuffle, and the ids they hold together."""
    ids = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("example_id"))
    batches = ordering.assign_batches(ids, shuffle=True, seed=7, epoch=1)
    sizes = batches.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("row_index").alias("first_row"))
    held = batches.agg(F.countDistinct("example_id").alias("ids"), F.sum("example_id").alias("id_sum"))
    return sizes.select("*", held.select("ids").scalar().alias("ids"), held.select("id_sum").scalar().alias("id_sum"))


@query
def number_rows_by_language(spark, sf_dir):
    documents = fx.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return ordering.number_rows(documents, "doc_id", ["lang"])


def _some_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their language, every third one without."""
    lang = F.when(F.col("doc_id") % 3 > 0, F.col("lang"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", lang.alias("lang"), "text")


@query
def number_rows_null_key(spark, sf_dir):
    """Rows without a language are a group of their own."""
    return ordering.number_rows(_some_language(spark, sf_dir).select("doc_id", "lang"), "doc_id", ["lang"])


@query
def first_n_large(spark, sf_dir):
    """The first 5,000 rows of each language, and of those without one."""
    first = ordering.first_n_per_group(_some_language(spark, sf_dir), ["lang"], "doc_id", 5_000)
    return first.select("doc_id", "lang", big("rank").alias("rank"), F.md5("text").alias("text"))


# ---- vocabulary and encoding -------------------------------------------------------------------------


@query
def fit_vocab(spark, sf_dir):
    fitted = encoding.fit_vocabulary(fx.documents(spark, sf_dir), ["text"], VOCABULARY_SIZE)
    return fitted.select(big("token_id").alias("token_id"), "word", "n")


@query
def fit_vocab_all(spark, sf_dir):
    """Every word of the corpus, none left out."""
    fitted = encoding.fit_vocabulary(fx.documents(spark, sf_dir), ["text"], None)
    return fitted.select(big("token_id").alias("token_id"), "word", "n")


def _training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.select_rows(fx.pairs_long(spark, sf_dir), "train", ["en"])


#: Where the fitted vocabulary of (application, data) is stored.
SAVED: dict[tuple[str, str], str] = {}


def _vocabulary(spark: SparkSession, sf_dir: str) -> encoding.Vocabulary:
    """Fitted on the training rows of the source language; saved by the first query that needs it, loaded by others."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in SAVED:
        fitted = encoding.Vocabulary.fit(_training_rows(spark, sf_dir), ["premise", "hypothesis"], VOCABULARY_SIZE)
        path = work_folder(spark, "vocabulary")
        fitted.save(path)
        SAVED[key] = path
        return fitted
    return encoding.Vocabulary.load(spark, SAVED[key])


def _encoded(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return encoding.encode(fx.pairs_long(spark, sf_dir), _vocabulary(spark, sf_dir), **options)


def _flat_ids(encoded: DataFrame, key: str = "example_id") -> DataFrame:
    return encoded.select(
        key,
        big(F.size("input_ids")).alias("n_ids"),
        big(F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b)).alias("n_real"),
        F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
        big("labels").alias("labels"),
    )


@query
def encode_pairs(spark, sf_dir):
    return _flat_ids(_encoded(spark, sf_dir))


@query
def encode_shuffled(spark, sf_dir):
    """The same ids from a vocabulary that is joined instead of broadcast."""
    fitted = encoding.fit_vocabulary(_training_rows(spark, sf_dir), ["premise", "hypothesis"], VOCABULARY_SIZE)
    return _flat_ids(encoding.encode(fx.pairs_long(spark, sf_dir), encoding.VocabularyTable(fitted)))


@query
def encode_nopad(spark, sf_dir):
    return _flat_ids(_encoded(spark, sf_dir, padding="none"))


@query
def encode_longest(spark, sf_dir):
    """Each batch of 16 padded to its own longest row."""
    batched = ordering.assign_batches(fx.pairs_long(spark, sf_dir))
    vocabulary = _vocabulary(spark, sf_dir)
    return _flat_ids(encoding.encode(batched, vocabulary, padding="longest", batch="batch_id"))


@query
def encode_longest_all(spark, sf_dir):
    """All rows padded to the longest of the call."""
    return _flat_ids(_encoded(spark, sf_dir, padding="longest", max_length=4096))


@query
def encode_paraphrase(spark, sf_dir):
    encoded = encoding.encode_paraphrase(
        fx.paraphrase_pairs(spark, sf_dir), _vocabulary(spark, sf_dir), keep=("id", "lang"), max_length=PAIR_MAX_LENGTH
    )
    return _flat_ids(encoded.withColumn("id", F.concat_ws("-", "id", "lang")), "id")


@query
def encode_single(spark, sf_dir):
    """One text per row: ids of the whole document between the two special tokens, up to the length limit."""
    documents = fx.documents(spark, sf_dir).select(F.col("doc_id").alias("example_id"), "text", F.lit(0).alias("label"))
    return _flat_ids(encoding.encode(documents, _vocabulary(spark, sf_dir), first="text", second=None))


@query
def encode_tokens_256(spark, sf_dir):
    """Pairs in the length that token-level tasks use."""
    return _flat_ids(_encoded(spark, sf_dir, max_length=TOKEN_SEQUENCE_MAX_LENGTH))


@query
def decode_ids(spark, sf_dir):
    vocabulary = _vocabulary(spark, sf_dir)
    encoded = encoding.encode(fx.pairs_long(spark, sf_dir), vocabulary)
    return encoding.decode_ids(encoded, vocabulary).select("example_id", F.array_join("tokens", " ").alias("tokens"))


# ---- scoring -----------------------------------------------------------------------------------------


@query
def softmax_probs(spark, sf_dir):
    probs = vectors.softmax(fx.LOGITS_A)
    return fx.nli_logits(spark, sf_dir).select(
        "example_id", *[r6(F.get(probs, i)).alias(f"p{i}") for i in range(3)]
    )


@query
def argmax_label(spark, sf_dir):
    return fx.nli_predictions(spark, sf_dir).select(
        "example_id", big("predicted_label").alias("predicted_label"), r6("confidence").alias("confidence")
    )


@query
def score_pairs(spark, sf_dir):
    scored = scoring.score_pairs(fx.nli_logits(spark, sf_dir), fx.LOGITS_A, validate=True)
    return _scored(scored)


def _scored(scored: DataFrame) -> DataFrame:
    return scored.select(
        "example_id", "lang", "status", "predicted_name",
        *[r6(F.get("probs", i)).alias(f"p{i}") for i in range(3)], r6("confidence").alias("confidence"),
    )


@query
def score_callable(spark, sf_dir):
    return _scored_turns(scoring.score_pairs(_turn_pairs(spark, sf_dir), length_model, validate=True))


def text_model() -> scoring.Model:
    """A stand-in for a user's model of single texts: logits from the length."""

    def model(texts: pd.Series, _: pd.Series | None) -> np.ndarray:
        n = texts.str.len().to_numpy()
        return np.stack([n % 7, n % 5, n % 3], axis=1) / 2.0

    return model


@query
def predict_single(spark, sf_dir):
    """Single texts scored with a user's model."""
    documents = fx.documents(spark, sf_dir).select(F.col("doc_id").alias("example_id"), "text")
    scored = scoring.score_pairs(documents, text_model, premise="text", hypothesis=None)
    return scored.select("example_id", "status", "predicted_name", r6("confidence").alias("confidence"))


@query
def compare_models_failed(spark, sf_dir):
    """The second model fails on some pairs and was not run on others."""
    logits = fx.nli_logits(spark, sf_dir)
    some = logits.where(F.col("example_id") % 7 > 0).withColumn("m0", F.when(F.col("example_id") % 5 > 0, F.col("m0")))
    both = evaluation.compare_models(scoring.score_logits(logits, fx.LOGITS_A), scoring.score_logits(some, fx.LOGITS_B))
    return both.withColumns({"agreement": r6("agreement"), "accuracy_delta": r6("accuracy_delta")})


@query
def model_roundtrip(spark, sf_dir):
    """A fitted pipeline, and the same saved and loaded, give the same predictions."""
    rows = fx.pairs_long(spark, sf_dir)
    train, test = pairs.train_eval_frames(rows, "en", PRESENT)
    model = transfer.fit_pairs(train)
    path = work_folder(spark, "model")
    transfer.save_model(model, path)
    one = scoring.score_pipeline(test, model).select("example_id", "lang", F.col("probs").alias("one"))
    two = scoring.score_pipeline(test, transfer.load_model(path)).select("example_id", F.col("probs").alias("two"))
    return one.join(two, "example_id").groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(F.col("one") == F.col("two")).alias("same")
    )


@query
def score_latency(spark, sf_dir):
    scored = scoring.score_callable(fx.pairs_long(spark, sf_dir), length_model, timed=True)
    return scoring.latency_summary(scored, ["lang"]).select(
        "lang", "n", (F.col("p50_ms") >= 0).alias("positive"), (F.col("p50_ms") <= F.col("p95_ms")).alias("ordered")
    )


@query
def zero_shot_transfer(spark, sf_dir):
    """Fitted on English training rows, evaluated on the validation rows of every language."""
    table = transfer.train_and_evaluate(fx.pairs_long(spark, sf_dir), PRESENT).evaluation
    source = F.max(F.when(F.col("lang") == "en", F.col("accuracy"))).over(Window.partitionBy())
    return table.select(
        "lang", "n", F.col("correct").between(0, F.col("n")).alias("counted"),
        (r6("accuracy") == r6(F.try_divide(F.col("correct").cast("double"), F.col("n")))).alias("divided"),
        (r6("gap") == r6(source - F.col("accuracy"))).alias("compared"),
    )


@query
def zero_shot_epochs(spark, sf_dir):
    """Three epochs of mini-batches on English, averaged over four tasks, every language evaluated after each."""
    table = epochs.train_epochs(fx.pairs_long(spark, sf_dir), PRESENT, parts=4).evaluation
    source = table.where(F.col("lang") == "en").select("epoch", F.col("accuracy").alias("_source"))
    before = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)  # one row per epoch
    source = source.withColumn("_best", F.coalesce(F.max("_source").over(before), F.lit(0.0)))
    return table.join(source, "epoch").select(
        big("epoch").alias("epoch"), "lang", "n", F.col("correct").between(0, F.col("n")).alias("counted"),
        (r6("accuracy") == r6(F.try_divide(F.col("correct").cast("double"), F.col("n")))).alias("divided"),
        (F.col("is_best") == (F.col("_source") > F.col("_best"))).alias("ruled"),
    )


# ---- streams -----------------------------------------------------------------------------------------


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = streaming.read_pair_stream(spark, f"{sf_dir}/embeddings*.parquet", fx.TABLES["embeddings"])
    return fx.logits_of(embeddings, fx.table(spark, sf_dir, "documents"))


@query
def stream_score_pairs(spark, sf_dir):
    out, state = work_folder(spark, "stream-scores"), work_folder(spark, "stream-scores-state")
    scored = streaming.score_stream(_arrivals(spark, sf_dir), fx.LOGITS_A)
    streaming.write_stream(scored, out, state).awaitTermination()
    return _scored(spark.read.parquet(out))


@query
def stream_accuracy(spark, sf_dir):
    out, state = work_folder(spark, "stream-accuracy"), work_folder(spark, "stream-accuracy-state")
    scored = scoring.score_logits(_arrivals(spark, sf_dir), fx.LOGITS_A)
    streaming.publish_totals(streaming.running_accuracy(scored), out, state).awaitTermination()
    return spark.read.parquet(out).withColumn("accuracy", r6("accuracy"))


@query
def stream_accuracy_versions(spark, sf_dir):
    """The same totals, published as versions that can be read at any moment."""
    out, state = work_folder(spark, "stream-versions"), work_folder(spark, "stream-versions-state")
    scored = scoring.score_logits(_arrivals(spark, sf_dir), fx.LOGITS_A)
    streaming.publish_versions(streaming.running_accuracy(scored), out, state).awaitTermination()
    return versions.read_current(spark, out).withColumn("accuracy", r6("accuracy"))
