"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word as the digest contracts define it: a run without space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where none is set, a local one is made in local mode, and the job
    fails on a cluster, whose executors could not reach it."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        base = tempfile.mkdtemp(prefix="llm-")
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into the folder that the cluster shares, so that a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def compact(df: DataFrame, rows: int, per_part: int = 500_000) -> DataFrame:
    """A narrow table of about ``rows`` rows in as few partitions as they need, so that what follows writes few files."""
    return df.coalesce(rows // per_part + 1)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet into the shared folder, and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows of the map of keys, and bits of a row (4 KB).
MAP_ROWS, MAP_BITS = 2048, 32_768


def split_by_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` whose ``on`` may be among those of ``keys``, rows whose ``on`` is not).

    The second need no join, and so no shuffle. A map of hashes with one bit each, 8 MB at most, is broadcast; where
    hashes share a bit the first part has some rows too many. ``keys`` and ``df`` are read twice: pass tables that are
    stored or cheap.
    """
    part, place, bits = fresh(df, "_part", "_place", "_bits")
    hashed = F.pmod(F.xxhash64(*on), F.lit(MAP_ROWS * MAP_BITS))
    spot = F.pmod(F.col(place), F.lit(MAP_BITS))
    marks = (
        keys.select(hashed.alias(place)).groupBy(F.floor(F.col(place) / MAP_BITS).alias(part))
        .agg(F.bitmap_construct_agg(spot).alias(bits))
    )
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(spot, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    known = F.coalesce(F.getbit(byte, F.pmod(spot, F.lit(8)).cast("int")) == 1, F.lit(False))
    marked = df.withColumn(place, hashed).withColumn(part, F.floor(F.col(place) / MAP_BITS)).join(F.broadcast(marks), part, "left")
    return tuple(marked.filter(where).drop(part, place, bits) for where in (known, ~known))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``; without it Spark evaluates a repeated expression every time."""
    return F.transform(F.array(value), body)[0]


def running_start(
    df: DataFrame, group: Sequence[str], order: str, ties: Sequence[str], weight: str, out: str, per_bucket: int = 4096
) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over earlier rows of the group, in the order of the hash ``order``.

    A group may hold most rows, so no window spans one. The leading bits of the hash cut every group into buckets
    of about ``per_bucket`` rows; a bucket's start is a running sum over bucket totals, a row's start is added
    inside its bucket. ``df`` is read twice: pass a narrow, stored table. ``_bucket`` and ``_place`` (the row's
    number in its bucket) stay as columns; with the group they identify a row.
    """
    bits = max(0, (max(1, df.count()) // per_bucket).bit_length())
    bucketed = df.withColumn("_bucket", F.shiftrightunsigned(order, 64 - bits) if bits else F.lit(0).cast("long"))
    totals = bucketed.groupBy(*group, "_bucket").agg(F.sum(weight).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(order, *ties)
    placed = bucketed.withColumn("_place", F.row_number().over(inside)).withColumn(
        "_inside", F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    return (
        placed.join(starts, [*group, "_bucket"])
        .withColumn(out, F.col("_start") + F.col("_inside"))
        .drop("_start", "_inside")
    )


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working names that clash with no column of ``df``, ignoring case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
