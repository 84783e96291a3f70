"""Sinks for error records, annotation sheets and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from lingospan.schemas import ANNOTATION_COLUMNS


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header, quotes doubled, texts kept to the character."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", "")
        .csv(path)
    )


def write_annotation_sheet(
    errors: DataFrame, path: str, columns: Sequence[str] = tuple(ANNOTATION_COLUMNS), one_file: bool = False
) -> None:
    """The columns an annotator needs, in order; columns the data lacks are left out.

    ``one_file`` is for the few records per language that people annotate.
    """
    sheet = errors.select(*[c for c in columns if c in errors.columns])
    write_csv(sheet.coalesce(1) if one_file else sheet, path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line, UTF-8, NULL fields kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_partitioned(
    df: DataFrame, path: str, by: Sequence[str] = ("lang", "split"), mode: str = "overwrite", rebalance: bool = True
) -> None:
    """Parquet in one folder per language and split.

    Rows are first brought together by folder, so that not every task writes a small file into every
    folder. Spark cuts a large folder into several tasks and joins small ones (``rebalance``), so the
    biggest language is not left to one task.
    """
    if rebalance:
        df = df.hint("rebalance", *by)
    df.write.mode(mode).partitionBy(*by).parquet(path)
