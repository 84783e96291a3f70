"""Whitening of embeddings with distributed block matrices.

A vector's entries c become whole numbers ``x = floor(256 * c) + 0``. The fit list holds each distinct x vector once. Its
rows, centred, are indexed into a ``BlockMatrix`` of Spark MLlib; the transpose times the matrix gives the scatter, whose
eigenvectors are found on the driver (dimensions squared, whatever the number of rows). A second multiplication, by the
whitening matrix, projects all rows, copies included: so every row keeps its own index, and no vector that many rows
share is a key of a join.

* Rows whose vector is null, or holds a null, NaN or infinite entry, are left out.
* A vector shorter than the longest one counts as padded with zeros; an empty one is all zeros.
* An entry beyond a long gives the nearest long; a deviation beyond a long is null. All other sums are exact.
* Eigenvalues that are zero to double precision have no component: equal vectors only, or one, give no rows.
* Rows may repeat, ids be null. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lingospan.llm.common import cut

#: Entries of a block (two megabytes), and blocks that one task multiplies.
BLOCK, BLOCKS_A_TASK = 1 << 18, 16
SCHEMA = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
)


def whole_vectors(df: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, x) of the rows whose ``embedding`` is there and finite; x holds floor(scale * entry)."""
    entries = F.col("embedding").cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(entries, lambda c: F.floor(c * scale))
    return df.filter(F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("bigint"), x.alias("x"))


def _numbered(stored: DataFrame) -> DataFrame:
    """Add ``index``: 0, 1, 2, ... over a checkpointed table, whose partitions stay as they are."""
    part, place = F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    sizes = stored.select(part).groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    # One row for each partition of a table whose partitions the driver lists anyway.
    placed = stored.select("*", part, place.alias("_place")).join(F.broadcast(starts), "_part")
    return placed.withColumn("index", F.col("_start") + F.col("_place")).drop("_part", "_start", "_place")


def _padded(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of longs as rows of ``width`` columns, zeros at the end."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), dtype=np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _sums(vectors: DataFrame, width: int) -> list[int]:
    """Exact sums of the columns of ``x``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Upper and lower halves apart, so that no sum of a task overflows.
        high, low = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = _padded(batch.column(0), width)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(high), pa.array(low)], ["d", "high", "low"])

    halves = vectors.select("x").mapInArrow(add, "d bigint, high bigint, low bigint")
    totals = halves.groupBy("d").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    found = {row["d"]: (int(row["high"]) << 32) + int(row["low"]) for row in totals.collect()}  # a row per dimension
    return [found[d] for d in range(width)]


def _centred(indexed: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """Add ``deviation``, the exact sum of (n x - S)^2, and ``centred``, x - S / n; ``x`` goes."""
    width, total = len(sums), np.array(sums, dtype=object)
    columns = [c for c in indexed.columns if c != "x"]
    room = (1 << 63) - 1

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _padded(batch.column(batch.schema.get_field_index("x")), width)
            largest = n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, sums))
            # Whole numbers of Python where those of numpy could overflow: the same results.
            exact = x if largest * largest * width <= room else x.astype(object)
            moved = exact * n - (total if exact.dtype == object else total.astype(np.int64))
            deviation = [int(v) if v <= room else None for v in (moved * moved).sum(axis=1)]
            centred = (moved / n).astype(np.float64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(centred.ravel()))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(deviation, pa.int64()), lists], [*columns, "deviation", "centred"])

    kinds = ", ".join(f"{c} bigint" for c in columns)
    return indexed.select(*columns, "x").mapInArrow(centre, f"{kinds}, deviation bigint, centred array<double>")


def block_matrix(rows: DataFrame, vector: str, count: int, width: int) -> BlockMatrix:
    """The block matrix of (index, vector): all columns of a run of rows in each block."""
    narrow = rows.select("index", array_to_vector(vector).alias("vector"))
    indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(narrow, "vector"), count, width)
    return indexed.toBlockMatrix(max(1, BLOCK // width), width)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix.

    The blocks are multiplied a few to a task, and the products summed. Python's ``multiply`` lacks the number of
    parts of the inner dimension, without which one task would take all blocks; so the method beneath it is called.
    """
    parts = matrix.numRowBlocks // BLOCKS_A_TASK + 1
    turned = matrix.transpose()
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(product, turned.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def _rows_of(matrix: BlockMatrix, out: str) -> DataFrame:
    """(index, out) of a block matrix, without a detour through Python."""
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.toDF("index", "_vector").select("index", vector_to_array("_vector").alias(out))


@dataclass(frozen=True)
class Whitening:
    """What was fitted, and the projected rows: (vec_id, deviation, whitened)."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors in columns
    trace: float
    identity_error: float
    rows: DataFrame


def whiten(df: DataFrame, components: int | None = None, scale: int = 256) -> Whitening | None:
    """Fit on the distinct vectors of ``df`` (vec_id, embedding) and project every row on the first ``components``.

    None without a component: no vector, or all of them equal.
    """
    vectors = cut(whole_vectors(df, scale))
    width = vectors.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return None
    # Vectors that differ by zeros at the end are one.
    padding = F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("x")))
    distinct = cut(vectors.select(padding.alias("x")).distinct())
    n = distinct.count()
    sums = _sums(distinct, width)
    fit = block_matrix(_centred(_numbered(distinct), n, sums), "centred", n, width)
    covariance = scatter(fit) / n
    values, basis = np.linalg.eigh((covariance + covariance.T) / 2)
    values, basis = values[::-1], basis[:, ::-1]
    real = int((values > max(values[0], 0) * width * np.finfo(float).eps).sum())
    taken = min(real, components or real)
    if not taken:
        return None
    weights = basis[:, :taken] / np.sqrt(values[:taken])
    # A row per dimension.
    local = df.sparkSession.createDataFrame([(i, row.tolist()) for i, row in enumerate(weights)], "index bigint, row array<double>")
    whitening = IndexedRowMatrix(
        MLUtils.convertVectorColumnsFromML(local.select("index", array_to_vector("row").alias("vector")), "vector"), width, taken
    ).toBlockMatrix(width, taken)

    seen = _rows_of(fit.multiply(whitening), "whitened")
    means = seen.select(Summarizer.mean(array_to_vector("whitened"))).first()[0].toArray()
    middle = F.array(*[F.lit(float(m)) for m in means])
    centred = seen.select("index", F.zip_with("whitened", middle, lambda a, b: a - b).alias("centred"))
    error = float(np.abs(scatter(block_matrix(centred, "centred", n, taken)) / n - np.eye(taken)).max())

    indexed = _centred(_numbered(vectors), n, sums)
    count = vectors.count()
    projected = _rows_of(block_matrix(indexed, "centred", count, width).multiply(whitening), "whitened")
    rows = indexed.select("index", "vec_id", "deviation").join(projected, "index").drop("index")
    return Whitening(n, sums, values, basis, float(np.trace(covariance)), error, rows)


def op11_block_whitening(df: DataFrame, components: int = 4) -> DataFrame:
    """The digest of the contract: a row for each remaining row of ``df`` and each of the first four components."""
    found = whiten(df, components)
    if found is None:
        return df.sparkSession.createDataFrame([], SCHEMA)
    shares = F.array(*[F.lit(float(v / found.trace)) for v in found.values[:components]])
    return found.rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(found.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(found.identity_error).alias("identity_error"),
    )
