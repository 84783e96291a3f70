"""Document fingerprints from content-defined chunks.

A gear hash over the last 32 bytes decides where a chunk may end. Chunking is normalised: up to the normal length a
hard mask has to match, beyond it an easy one, so lengths gather around the normal one. An edit moves boundaries only
near itself. The fingerprint of a text is its set of distinct chunks, each as 16 hex digits: 14 of a content digest,
2 of its length in bytes. Containment of one fingerprint in another weighs chunks by length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Chunk lengths in bytes; the longest must fit two hex digits.
LEAST, NORMAL, MOST = 8, 32, 160
#: Bits that must be zero in the hash before and after the normal length.
HARD, EASY = 6, 4
WINDOW = 32
#: Bytes of text that are hashed at a time, about.
BATCH_BYTES = 2_000_000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SEEDS = _mix(np.arange(1, 513, dtype=_U) * _U(0x9E3779B97F4A7C15))
#: Gear values per byte. 0xFF is no UTF-8 byte: it separates texts, and counts nothing.
_GEAR = (_SEEDS[:256] >> _U(32)).astype(np.uint32)
_GEAR[0xFF] = 0
_VALUE = _SEEDS[256:]
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64, by doubling."""
    out = np.ones(n + 1, dtype=_U)
    done = 1
    while done <= n:
        step = min(done, n + 1 - done)
        out[done : done + step] = out[:step] * _U(pow(base, done, 2**64))
        done += step
    return out


def _cuts(ends_ok: tuple[np.ndarray, np.ndarray], starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """Chunks (text number, start, end) of all texts at once: each round cuts one chunk off every unfinished text."""
    hard, easy = ends_ok
    which, at = np.arange(len(starts)), starts.copy()
    live = at < stops
    which, at = which[live], at[live]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    far = np.iinfo(np.int64).max
    hard, easy = np.append(hard, far), np.append(easy, far)
    while len(at):
        stop = stops[which]
        end = hard[np.searchsorted(hard, at + LEAST)]
        late = end >= at + NORMAL
        end = np.where(late, easy[np.searchsorted(easy, at + NORMAL)], end)
        end = np.minimum(np.minimum(end, at + MOST), stop)
        out.append((which, at, end))
        live = end < stop
        which, at = which[live], end[live]
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def chunk_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For every text the sorted distinct chunks, as 56 bits of digest over 8 bits of length."""
    joint = (b"\xff" * WINDOW).join([b"", *texts, b""])
    data = np.frombuffer(joint, dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = WINDOW + np.concatenate(([0], np.cumsum(lengths[:-1] + WINDOW))) if len(texts) else lengths
    gear = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):  # the hash of 2, 4, ... 32 bytes from two halves
        gear[shift:] = gear[shift:] + (gear[:-shift] << np.uint32(shift))
    # Position p ends a chunk (exclusive) when the hash of the bytes before it has zero leading bits.
    easy = np.flatnonzero(gear >> np.uint32(32 - EASY) == 0) + 1
    hard = easy[gear[easy - 1] >> np.uint32(32 - HARD) == 0]
    which, begin, end = _cuts((hard, easy), starts, starts + lengths)
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_VALUE[data] * _powers(_BASE, len(data))[:-1], out=sums[1:])
    length = (end - begin).astype(_U)
    digest = _mix((sums[end] - sums[begin]) * _powers(_UNBASE, len(data))[begin] + length)
    chunk = (digest << _U(8)) | length
    order = np.lexsort((chunk, which))
    which, chunk = which[order], chunk[order]
    first = np.ones(len(chunk), dtype=bool)
    first[1:] = (which[1:] != which[:-1]) | (chunk[1:] != chunk[:-1])
    which, chunk = which[first], chunk[first]
    return np.split(chunk, np.searchsorted(which, np.arange(1, len(texts)))) if texts else []


def fingerprint(chunks: np.ndarray) -> str:
    return chunks.byteswap().tobytes().hex()


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of ``a``, by length of distinct chunks, that ``b`` has too. Two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    shared = a[np.isin(a, b, assume_unique=True)]
    return float((shared & _U(0xFF)).sum()) / float((a & _U(0xFF)).sum())


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(id, text, ghost), partitioned and sorted so that the row after each one in its partition is the next document.

    Ids are cut into ranges of about equally many rows. The first document of each range is also sent, as a ghost, to
    the range before it (the first of all to the last range), so that no range needs another one and texts move once.
    Rows that repeat an id stand together in the order of their texts. A null id comes first.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = docs.count()
    wanted = buckets or max(1, min(count // 64, tasks * 8))
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"))
    # Numbers of the driver's bounded plan: one range start per 1/8 of a task.
    bounds = sorted({int(x) for x in ids.approxQuantile("id", [i / wanted for i in range(wanted)], 0.25 / wanted)})
    bounds = np.array(bounds, dtype=np.int64)
    lows = bounds[1:] if len(bounds) else bounds
    n = len(lows) + 1

    def bucket_of(key: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = key.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        return ids, np.searchsorted(lows, ids, side="right").astype(np.int32)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, bucket = bucket_of(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(key)], ["bucket", "id"])

    # The least id of each range, from ids alone; a range may be empty.
    least = {
        r.bucket: r.id
        for r in ids.mapInArrow(number, "bucket int, id bigint").groupBy("bucket").agg(F.min("id").alias("id")).collect()
    }
    filled = sorted(least)
    before = {least[b]: filled[i - 1] for i, b in enumerate(filled)}
    heads = np.array(sorted(before), dtype=np.int64)
    names = ["bucket", "ghost", "id", "text"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, bucket = bucket_of(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.zeros(len(key), bool)), *batch.columns], names)
            pick = np.flatnonzero(np.isin(key, heads))
            if len(pick):
                to = pa.array([before[int(k)] for k in key[pick]], pa.int32())
                sent = batch.take(pa.array(pick))
                yield pa.RecordBatch.from_arrays([to, pa.array(np.ones(len(pick), bool)), *sent.columns], names)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = source.mapInArrow(deal, "bucket int, ghost boolean, id bigint, text string")
    return dealt.repartition(max(1, min(tasks, n)), "bucket").sortWithinPartitions("bucket", "ghost", "id", "text")


_OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, int | None, str]]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition in order: every document with the one after it."""
    rows = _documents(batches)
    held: list[tuple[int, bool, int | None, str]] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[3])
        if size >= BATCH_BYTES:
            yield from _pairs(held)
            held, size = held[-1:], len(row[3])
    yield from _pairs(held)


def _pairs(rows: list[tuple[int, bool, int | None, str]]) -> Iterator[pa.RecordBatch]:
    # A document whose range has no ghost behind it (it was met already) is not last: ghosts sort last in a range.
    pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1] and a[0] == b[0]]
    if not pairs:
        return
    edited = []
    for a, b in pairs:
        k = len(a[3]) // 4
        edited.append((a[3][: len(a[3]) - k] + b[3][:k]).encode())
    sets = chunk_sets([a[3].encode() for a, _ in pairs] + edited + [b[3].encode() for _, b in pairs])
    n = len(pairs)
    own, other, after = sets[:n], sets[n : 2 * n], sets[2 * n :]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([a[2] for a, _ in pairs], pa.int64()),
            pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
            pa.array([fingerprint(x) for x in own], pa.string()),
            pa.array([fingerprint(x) for x in other], pa.string()),
            pa.array([containment(a, b) for a, b in zip(own, other, strict=True)], pa.float64()),
            pa.array([containment(a, b) for a, b in zip(own, after, strict=True)], pa.float64()),
        ],
        _OUT.names,
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``. A null text counts as empty and has an empty fingerprint; other columns stay."""

    @F.pandas_udf("string")
    def of(texts):
        out, held, size = [], [], 0
        for text in texts:
            held.append(text.encode())
            size += len(held[-1])
            if size >= BATCH_BYTES:
                out += [fingerprint(x) for x in chunk_sets(held)]
                held, size = [], 0
        out += [fingerprint(x) for x in chunk_sets(held)]
        import pandas as pd

        return pd.Series(out, index=texts.index, dtype=object)

    return docs.withColumn("fingerprint", of(F.coalesce(F.col(text_col), F.lit(""))))


def op1_chunk_fingerprints(docs: DataFrame) -> DataFrame:
    """The digest of the contract: each text against its edited form and against the next document."""
    return with_next(docs).mapInArrow(_compare, _OUT)
