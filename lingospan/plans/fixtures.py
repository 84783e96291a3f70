"""Views of the driver tables in the shapes the operators read.

Every view uses all rows and the whole text: the premise is the first line of a document, the hypothesis
everything after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lingospan.functions import text
from lingospan.operators.errors import misclassified, with_language_attributes
from lingospan.operators.pairs import nonempty_pairs
from lingospan.operators.scoring import score_logits
from lingospan.schemas import language_dim

LOGITS_A = ["l0", "l1", "l2"]
LOGITS_B = ["m0", "m1", "m2"]


# Declared, so that opening a table starts no job to read file footers.
TABLES = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _premise() -> Column:
    return F.substring_index("text", "\n", 1)


def _hypothesis() -> Column:
    return F.substr("text", F.length(_premise()) + 2)


def logits_of(embeddings: DataFrame, documents: DataFrame) -> DataFrame:
    """Logits of two models (``l*`` and ``m*``) for the pair in each document."""
    values = [F.get("embedding", i).cast("double").alias(c) for i, c in enumerate(LOGITS_A + LOGITS_B)]
    joined = embeddings.join(documents, F.col("vec_id") == F.col("doc_id"))
    return joined.select(
        F.col("vec_id").alias("example_id"),
        "lang",
        _premise().alias("premise"),
        _hypothesis().alias("hypothesis"),
        (F.col("label") % 3).cast("int").alias("gold_label"),
        *values,
    )


def nli_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logits_of(table(spark, sf_dir, "embeddings"), documents(spark, sf_dir))


def nli_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_logits(nli_logits(spark, sf_dir), LOGITS_A)


def pairs_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a pair; the split follows the last digit of the id."""
    digit = F.col("doc_id") % 10
    split = F.when(digit < 8, "train").when(digit == 8, "validation").otherwise("test")
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("example_id"),
        split.alias("split"),
        "lang",
        _premise().alias("premise"),
        _hypothesis().alias("hypothesis"),
        (F.col("n_chars") % 3).cast("int").alias("label"),
    )


def aligned_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of ten consecutive ids as one example; texts of a language are joined, so none is lost.

    Ids are unique, so a group holds ten rows at most.
    """
    block = F.expr("example_id div 10")

    def joined(column: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct("example_id", column)))
        return F.array_join(F.transform(ordered, lambda r: r[column]), "\n")

    return (
        pairs_long(spark, sf_dir)
        .groupBy(block.alias("id"), "lang")
        .agg(joined("premise").alias("premise"), joined("hypothesis").alias("hypothesis"))
        .withColumn("label", (F.col("id") % 3).cast("int"))
    )


def pairs_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per block with language maps, languages in name order, some missing."""

    def language_map(column: str) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", column))))

    return (
        aligned_long(spark, sf_dir)
        .groupBy(F.col("id").alias("example_id"))
        .agg(
            language_map("premise").alias("premise"),
            language_map("hypothesis").alias("hypothesis"),
            F.max("label").alias("label"),
        )
    )


def paraphrase_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_long(spark, sf_dir).select(
        "id",
        "lang",
        F.col("premise").alias("sentence1"),
        F.col("hypothesis").alias("sentence2"),
        (F.col("id") % 2).cast("int").alias("label"),
    )


def ner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of a document with a tag id from 0 to 6 each."""
    listed = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "lang", text.words("text").alias("tokens"))
    return listed.withColumn("ner_tags", F.transform("tokens", lambda w: F.length(w) % 7))


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.dayofmonth("ts").alias("epoch"), F.col("event_id").alias("step"), F.col("value").alias("loss"), "event_type"
    )


def epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.when(F.col("event_type").isin("view", "click"), 1.0).otherwise(0.0)
    return train_log(spark, sf_dir).groupBy("epoch").agg(F.avg(hit).alias("val_accuracy"))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All misclassified non-empty pairs with the attributes of their language."""
    wrong = misclassified(nonempty_pairs(nli_predictions(spark, sf_dir)))
    return with_language_attributes(wrong.withColumnRenamed("lang", "language"), language_dim(spark))


def annotated_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a category each, one of which has no description, and some left blank."""
    codes = F.array(*[F.lit(c) for c in ("E1", "E2", "E3", "E4", "E5", "E9")])
    category = F.get(codes, (F.col("example_id") % 7).cast("int"))
    return errors(spark, sf_dir).withColumn("error_category", category)


