"""Table schemas, and the small dimension tables with their fixed contents."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


PAIRS_DDL = "example_id BIGINT, split STRING, lang STRING, premise STRING, hypothesis STRING, label INT"
PARAPHRASE_DDL = "id BIGINT, split STRING, lang STRING, sentence1 STRING, sentence2 STRING, label INT"
NER_DDL = "id BIGINT, split STRING, lang STRING, tokens ARRAY<STRING>, ner_tags ARRAY<INT>"
ERROR_DDL = (
    "id INT, language STRING, language_name STRING, family STRING, script STRING, morphology STRING, "
    "word_order STRING, premise STRING, hypothesis STRING, gold_label STRING, predicted_label STRING, "
    "confidence DOUBLE, probs STRUCT<entailment: DOUBLE, neutral: DOUBLE, contradiction: DOUBLE>, "
    "error_category STRING, notes STRING"
)
# Column order of the annotation sheet.
ANNOTATION_DDL = (
    "id INT, language STRING, language_name STRING, premise STRING, hypothesis STRING, gold_label STRING, "
    "predicted_label STRING, confidence DOUBLE, error_category STRING, notes STRING, family STRING, "
    "script STRING, morphology STRING"
)
LANGUAGE_DDL = (
    "language STRING, name STRING, family STRING, script STRING, morphology STRING, word_order STRING"
)
CATEGORY_DDL = "code STRING, description STRING"
LABEL_DDL = "task STRING, id INT, name STRING"
EXAMPLE_DDL = "premise STRING, hypothesis STRING, language STRING"
TRAIN_LOG_DDL = "epoch INT, step BIGINT, loss DOUBLE"

ANNOTATION_COLUMNS = [part.split()[0] for part in ANNOTATION_DDL.split(", ")]

# Class names per task, in id order.
NLI_LABELS = ["entailment", "neutral", "contradiction"]
NLI_DISPLAY_LABELS = ["Entailment", "Neutral", "Contradiction"]
NLI_EMOJIS = ["✅", "🤔", "❌"]
PARAPHRASE_LABELS = ["Not paraphrase", "Paraphrase"]
NER_LABELS = ["O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC"]

# Language code, name, family, script, morphology, word order.
LANGUAGES = [
    ("en", "English", "Germanic", "Latin", "Low", "SVO"),
    ("de", "German", "Germanic", "Latin", "Medium", "V2/SOV"),
    ("zh", "Chinese", "Sino-Tibetan", "Hanzi", "Low", "SVO"),
    ("ar", "Arabic", "Semitic", "Arabic", "High", "VSO"),
    ("ru", "Russian", "Slavic", "Cyrillic", "High", "Free"),
    ("hi", "Hindi", "Indo-Aryan", "Devanagari", "High", "SOV"),
]


# Error categories used in annotation.
ERROR_CATEGORIES = [
    ("E1", "Lexical Overlap – High word similarity led to wrong Entailment prediction"),
    ("E2", "Negation Failure – Missed negation markers (not, لا, 不, nicht, etc.)"),
    ("E3", "Script/Tokenization – Subword splits disrupted semantic meaning"),
    ("E4", "Morphological – Case endings or inflections caused misinterpretation"),
    ("E5", "Word Order – Non-SVO syntax confused the English-trained model"),
]

# Morphology levels in rising order.
MORPHOLOGY_LEVELS = ["Low", "Medium", "High"]


def literal_frame(spark: SparkSession, rows: Iterable[Sequence], ddl: str) -> DataFrame:
    """A frame of constants. Catalyst sees its exact size, so it is broadcast only while small."""
    schema = T.StructType.fromDDL(ddl)
    columns = list(zip(*rows)) or [()] * len(schema)
    table = pa.table({f.name: pa.array(list(values)) for f, values in zip(schema, columns)})
    frame = spark.createDataFrame(table)
    return frame.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def language_dim(spark: SparkSession, extra: Iterable[Sequence] = ()) -> DataFrame:
    """Language attributes; ``extra`` rows extend the six built-in languages."""
    return literal_frame(spark, [*LANGUAGES, *extra], LANGUAGE_DDL)


def category_dim(spark: SparkSession, extra: Iterable[Sequence] = ()) -> DataFrame:
    return literal_frame(spark, [*ERROR_CATEGORIES, *extra], CATEGORY_DDL)


def label_dim(spark: SparkSession) -> DataFrame:
    rows = [
        (task, i, name)
        for task, names in (("nli", NLI_LABELS), ("paraphrase", PARAPHRASE_LABELS), ("ner", NER_LABELS))
        for i, name in enumerate(names)
    ]
    return literal_frame(spark, rows, LABEL_DDL)
