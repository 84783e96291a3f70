"""Operators that depend on row order: first N, row numbers, batches, shuffles.

Spark has no row order, so every operator sorts by an explicit BIGINT id. No group is ever numbered by
one task: rows are cut into order-preserving buckets, buckets are counted, and each row's number is its
rank in its bucket plus the sizes of the buckets before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Parts into which a group is cut before its first rows are sought.
SPREAD = 64


def default_buckets(spark: SparkSession) -> int:
    """A power of two, four to eight times the shuffle partitions: as many as the cluster is set up for."""
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(6, wanted.bit_length())


def required_id(df: DataFrame, order: str) -> Column:
    """The id column that rows are ordered by: an integer, and a NULL in it fails the job."""
    kind = df.schema[order].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{order}: rows are ordered by an integer id, got {kind.simpleString()}")
    missing = F.raise_error(F.lit(f"{order} has a NULL: rows cannot be ordered")).cast(kind)
    return F.coalesce(F.col(order), missing)


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, NULL being equal to NULL; the keys appear once."""
    if not keys:
        raise ValueError("no keys to join on")
    renamed = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_same_{k}" for k in keys])


def shuffle_key(order: str, seed: int = 0, epoch: int = 0) -> Column:
    """A repeatable pseudo-random sort key, different for each seed and epoch."""
    return F.xxhash64(F.lit(seed), F.lit(epoch), F.col(order))


def random_order(df: DataFrame, order: str = "example_id", seed: int = 0, epoch: int = 0) -> DataFrame:
    """Rows in a seeded random order (a range sort, so it scales like any sort)."""
    return df.orderBy(shuffle_key(order, seed, epoch), order)


def _with_range_bucket(df: DataFrame, order: str, buckets: int) -> DataFrame:
    """Bucket by quantiles of ``order``: even sizes also when ids are sparse or clustered."""
    values = df.select(F.col(order).cast("double").alias("_order"))
    shares = [i / buckets for i in range(1, buckets)]
    # One number per bucket; the buckets are cut by exact comparison, whatever the estimate.
    cuts = sorted(set(values.stat.approxQuantile("_order", shares, 0.5 / buckets))) or [0.0]
    cutter = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")], inputCol="_order", outputCol="_bucket", handleInvalid="keep"
    )
    return (
        cutter.transform(df.withColumn("_order", F.col(order).cast("double")))
        .withColumn("_bucket", F.col("_bucket").cast("int"))
        .drop("_order")
    )


def _with_hash_bucket(df: DataFrame, key: Column, buckets: int) -> DataFrame:
    """Bucket by the leading bits of a uniform 64-bit key."""
    bits = buckets.bit_length() - 1
    return df.withColumns({"_key": key, "_bucket": F.shiftright(key, 64 - bits).cast("int")})


def number_rows(
    df: DataFrame,
    order: str = "example_id",
    keys: Sequence[str] = (),
    out: str = "row_index",
    shuffle: bool = False,
    seed: int = 0,
    epoch: int = 0,
    buckets: int | None = None,
) -> DataFrame:
    """Row number 0, 1, 2, ... within ``keys`` (over all rows by default), in id or seeded random order.

    ``order`` must be a unique integer id; a NULL in it fails the job. Rows with a NULL key are a group like
    any other. The input is read more than once, so pass a stored table.
    """
    keys = list(keys)
    columns = df.columns
    df = df.withColumn(order, required_id(df, order))
    buckets = buckets or default_buckets(df.sparkSession)
    if shuffle:
        rows, sort = _with_hash_bucket(df, shuffle_key(order, seed, epoch), buckets), ["_key", order]
    else:
        rows, sort = _with_range_bucket(df, order, buckets), [order]
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    if not keys:
        # One row of two numbers per bucket.
        starts = F.broadcast(starts)
    place = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*sort))
    return (
        join_same(rows, starts, [*keys, "_bucket"])
        .withColumn(out, (F.col("_start") + place - 1).cast("bigint"))
        .select(*columns, out)
    )


def first_n_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    n: int,
    out: str = "rank",
) -> DataFrame:
    """The first ``n`` rows of each group by ``order``, numbered from 1.

    ``order`` is a unique integer id; a NULL in it fails the job, a NULL key is a group. Only keys and ids are
    ranked, for every ``n`` in the same way: each group is cut into ``SPREAD`` parts by a hash of the id, the
    first ``n`` of every part are ranked again, and the winners fetch their rows. The input is read twice, the
    first time for keys and ids alone, so pass a stored table.
    """
    keys = list(keys)
    ids = df.select(*keys, required_id(df, order).alias(order))
    spread = ids.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(SPREAD)))
    in_part = Window.partitionBy(*keys, "_part").orderBy(order)
    leading = spread.withColumn("_place", F.row_number().over(in_part)).where(F.col("_place") <= n)
    in_group = Window.partitionBy(*keys).orderBy(order)
    winners = leading.select(*keys, order, F.row_number().over(in_group).alias(out)).where(F.col(out) <= n)
    return join_same(df, winners, [*keys, order]).select(*df.columns, out)


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of the table."""
    return df.orderBy(order).limit(n)


def assign_batches(
    df: DataFrame,
    batch_size: int = 16,
    order: str = "example_id",
    shuffle: bool = False,
    seed: int = 0,
    epoch: int = 0,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``row_index`` and ``batch_id``: batches of ``batch_size`` rows, the last one short."""
    numbered = number_rows(df, order, (), "row_index", shuffle, seed, epoch, buckets)
    return numbered.withColumn("batch_id", F.floor(F.col("row_index") / batch_size).cast("bigint"))
