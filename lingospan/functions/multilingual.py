"""Picking one language out of a multilingual text column.

Three column shapes are accepted and told apart by type when the plan is built: plain STRING (passed
through), MAP<lang, text>, and STRUCT<language ARRAY, translation ARRAY>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POLICIES = ("error", "empty", "first")


def as_language_map(df: DataFrame, column: str) -> Column | None:
    """The column as MAP<lang, text>, or None when it is plain text."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.StringType):
        return None
    if isinstance(dtype, T.MapType):
        return F.col(column)
    if isinstance(dtype, T.StructType) and {"language", "translation"} <= set(dtype.fieldNames()):
        return F.map_from_arrays(F.col(column)["language"], F.col(column)["translation"])
    raise TypeError(f"{column}: expected text, a language map or language/translation arrays, got {dtype}")


def language_text(df: DataFrame, column: str, lang: str | Column, missing: str = "empty") -> Column:
    """Text of ``column`` in ``lang``.

    ``missing`` says what an absent language gives: ``error`` fails the job, ``empty`` gives ``''``,
    ``first`` gives the first text of the map (``''`` for an empty map). NULL text becomes ``''``.
    """
    if missing not in POLICIES:
        raise ValueError(f"missing must be one of {POLICIES}")
    texts = as_language_map(df, column)
    if texts is None:
        return F.coalesce(F.col(column), F.lit(""))
    key = F.lit(lang) if isinstance(lang, str) else lang
    found = F.when(F.map_contains_key(texts, key), F.coalesce(texts[key], F.lit("")))
    if missing == "error":
        message = F.concat(F.lit(f"{column} has no text in language "), key)
        return found.otherwise(F.raise_error(message).cast("string"))
    if missing == "first":
        return found.otherwise(F.coalesce(F.get(F.map_values(texts), F.lit(0)), F.lit("")))
    return found.otherwise(F.lit(""))
