"""Copying datasets into the layout the readers expect, once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingospan.schemas import literal_frame
from lingospan.sources.readers import create_file, path_exists
from lingospan.sources.writers import write_partitioned

STATUS_DDL = "dataset STRING, lang STRING, status STRING, error STRING"


def _copy(spark: SparkSession, source: Callable[[], DataFrame], target: str) -> str:
    """Write unless the target is there. A folder without its success marker is left alone and reported."""
    if path_exists(spark, target):
        return "skipped" if path_exists(spark, f"{target}/_SUCCESS") else "incomplete"
    source().write.mode("errorifexists").parquet(target)
    return "saved"


def ingest_dataset(
    spark: SparkSession, name: str, source: Callable[[], DataFrame], save_dir: str
) -> DataFrame | None:
    """Store a dataset under ``save_dir/name`` and return it, or return None when it was there already."""
    target = f"{save_dir.rstrip('/')}/{name}"
    if _copy(spark, source, target) != "saved":
        return None
    return spark.read.parquet(target)


def ingest_languages(
    spark: SparkSession, name: str, sources: Mapping[str, Callable[[], DataFrame]], save_dir: str
) -> DataFrame:
    """Store each language under ``save_dir/name/lang=<code>`` and return one status row per language.

    A language that fails is reported as ``error`` and does not stop the others.
    """
    rows = []
    for lang, source in sources.items():
        target = f"{save_dir.rstrip('/')}/{name}/lang={lang}"
        try:
            rows.append((name, lang, _copy(spark, source, target), None))
        except Exception as problem:
            rows.append((name, lang, "error", f"{type(problem).__name__}: {problem}".split("\n")[0]))
    return literal_frame(spark, rows, STATUS_DDL)


def ingest_by_language(
    spark: SparkSession, name: str, df: DataFrame, languages: Sequence[str], save_dir: str, lang: str = "lang"
) -> DataFrame:
    """Store the missing languages of one table in a single pass; same folders and status rows.

    The job commits all languages or none, unlike one job per language.
    """
    base = f"{save_dir.rstrip('/')}/{name}"
    folders = {code: f"{base}/lang={code}" for code in languages}
    status = {}
    for code, folder in folders.items():
        if path_exists(spark, folder):
            status[code] = "skipped" if path_exists(spark, f"{folder}/_SUCCESS") else "incomplete"
    missing = [code for code in languages if code not in status]
    if missing:
        rows = df.where(F.col(lang).isin(missing)).withColumnRenamed(lang, "lang")
        write_partitioned(rows, base, ["lang"], "append")
        for code in missing:
            # A language without rows gets no folder.
            if path_exists(spark, folders[code]):
                create_file(spark, f"{folders[code]}/_SUCCESS")
                status[code] = "saved"
            else:
                status[code] = "no rows"
    return literal_frame(spark, [(name, code, status[code], None) for code in languages], STATUS_DDL)
