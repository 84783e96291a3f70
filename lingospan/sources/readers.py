"""Readers for stored corpora, annotation sheets and pairs to score."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingospan.schemas import ANNOTATION_DDL, ERROR_DDL, PAIRS_DDL
from lingospan.sources.split_csv import OPTIONS, read_split_csv


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    files, target = _file_system(spark, path)
    return files.exists(target)


def create_file(spark: SparkSession, path: str) -> None:
    """Create an empty file."""
    files, target = _file_system(spark, path)
    files.createNewFile(target)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    for path in paths:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"none of these paths exists: {list(paths)}")


def load_first_existing(spark: SparkSession, paths: Sequence[str], schema: str | None = None) -> DataFrame:
    """Read the Parquet table at the first path that exists."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(first_existing(spark, paths))


def load_splits(
    spark: SparkSession, paths: Sequence[str], splits: Sequence[str] | None = None, schema: str | None = None
) -> DataFrame:
    """Read a corpus and keep some splits; on a table partitioned by split only those are read."""
    df = load_first_existing(spark, paths, schema)
    return df if splits is None else df.where(F.col("split").isin(list(splits)))


def load_languages(spark: SparkSession, paths: Sequence[str], languages: Sequence[str]) -> DataFrame:
    """Read the requested languages of a table laid out in ``lang=`` folders; absent ones are left out."""
    df = load_first_existing(spark, paths)
    return df.where(F.col("lang").isin(list(languages)))


def attach_ids(df: DataFrame, out: str = "example_id") -> DataFrame:
    """Add a BIGINT id to a frame read from Parquet: the place of the row in the sorted list of files.

    The id is the file's number times 2^40 plus the row's number in the file, so it follows stored order,
    is the same on every run, and costs no sort. How the list of files, which the driver holds anyway to plan
    the scan, is joined is left to Catalyst, which knows its size. The id holds up to 2^23 files, more fail.
    """
    files = sorted(re.sub("^file:/+", "file:/", f) for f in df.inputFiles())
    numbers = df.sparkSession.createDataFrame(
        pa.table({"_file": pa.array(files, pa.string()), "_number": pa.array(range(len(files)), pa.int64())})
    )
    if len(files) > 1 << 23:
        raise ValueError(f"{len(files)} files: ids have room for {1 << 23}")
    path = F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")
    placed = df.select("*", path.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    unknown = F.raise_error(F.concat(F.lit("file not listed: "), F.col("_file"))).cast("bigint")
    return (
        placed.join(numbers, "_file", "left")
        .withColumn(out, F.coalesce("_number", unknown) * F.lit(1 << 40) + F.col("_row"))
        .drop("_file", "_number", "_row")
    )


def read_json_errors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ERROR_DDL).json(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with header and quoted line breaks, read in splits; only an empty field is NULL."""
    return read_split_csv(spark, path, schema)


def read_csv_whole(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The same rows with one task for each file."""
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True)
    return reader.options(**OPTIONS).csv(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """The annotation sheet filled in by people; blank cells are NULL."""
    return read_csv(spark, path, ANNOTATION_DDL)


def read_pairs_csv(spark: SparkSession, path: str, schema: str = PAIRS_DDL) -> DataFrame:
    return read_csv(spark, path, schema)
