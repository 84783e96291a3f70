"""Repeated byte strings, by prefix-free parsing.

A text is parsed by a rolling hash: among the 36-byte strings of every 100-byte window the one with the least hash is
the window's trigger, and a run of windows with one trigger is a phrase. Triggers depend on nothing but the window's
bytes, so equal windows lie in phrases with equal triggers, at the same distance from them. The dictionary holds the
distinct phrases, the parse says where they stand.

Whether a window of 100 bytes occurs earlier in the corpus then takes no comparison of texts:
a phrase that occurs earlier brings all its windows with it (the order of the parse settles which one is first), and
windows of different phrases can only be equal if these share their trigger: of such phrases, and of those alone, the
dictionary's suffixes are compared, each by its first 100 bytes. A phrase whose trigger occurs once is done with at
once. Only equality of 100 bytes is asked for, so suffixes are brought together by a hash of these bytes, not sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingospan.llm.common import cut, split_by_keys
from lingospan.llm.shingles import _BASE, _UNBASE, _VALUE, mix, powers

#: Bytes of a repeated string, and of a trigger.
LENGTH, GRAM = 100, 36
#: Bits of a trigger's hash by which phrases are brought together: more only saves comparisons.
ROUTE_BITS = 40
#: Bits of a packed value that hold a position; texts are parsed in stretches that fit.
PLACE_BITS = 21
STRETCH = 1 << 19
#: Bytes of text whose phrases are combined before the shuffle.
CHUNK_BYTES = 16 << 20
#: Phrases up to which their places are broadcast to the texts (24 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_500_000

_U = np.uint64
_ROUTE = _U((1 << ROUTE_BITS) - 1)


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, sums: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(_U))


def _prefix(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_VALUE[data] * powers(_BASE, len(data))[:-1], out=sums[1:])
    return sums


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def parse(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Phrases of all texts: (text number, first window, windows, trigger hash, phrase hash)."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U))
    if len(data) < LENGTH:
        return none
    sums, inverse = _prefix(data), powers(_UNBASE, len(data))
    grams = np.arange(len(data) - GRAM + 1)
    hashed = _hashes(data, grams, grams + GRAM, sums, inverse)
    packed = (hashed >> _U(PLACE_BITS) << _U(PLACE_BITS)) | grams.astype(_U)
    trigger = (_sliding_min(packed, LENGTH - GRAM + 1) & _U((1 << PLACE_BITS) - 1)).astype(np.int64)
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(texts)), lengths)[: len(trigger)]
    inside = np.arange(len(trigger)) + LENGTH <= ends[text]
    new = np.ones(len(trigger), dtype=bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new & inside)
    if not len(first):
        return none
    # A run of valid windows ends at the next start, or where its text has no further window.
    limit = ends[text[first]] - LENGTH + 1
    after = np.append(np.flatnonzero(new), len(trigger))
    stop = np.minimum(after[np.searchsorted(after, first, side="right")], limit)
    phrase = _hashes(data, first, stop - 1 + LENGTH, sums, inverse)
    phrase = mix(phrase * _U(_BASE) + (trigger[first] - first).astype(_U))
    start = first - (ends - lengths)[text[first]]
    return text[first], start, stop - first, hashed[trigger[first]], phrase


def _stretches(text: bytes) -> Iterator[tuple[int, bytes]]:
    """A text in pieces that hold every window once."""
    at = 0
    while True:
        yield at, text[at : at + STRETCH + LENGTH - 1]
        at += STRETCH
        if at + LENGTH > len(text):
            return


def _parsed(ids: Sequence[int], texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(doc id, first window, windows, trigger, phrase) of documents, parsed in pieces of about a stretch."""
    out: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        if held:
            text, start, n, trigger, phrase = parse([x[2] for x in held])
            doc = np.array([x[0] for x in held], dtype=np.int64)[text]
            offset = np.array([x[1] for x in held], dtype=np.int64)[text]
            out.append((doc, start + offset, n, trigger, phrase))
            held.clear()

    for i, t in zip(ids, texts, strict=True):
        for at, piece in _stretches(t):
            if size + len(piece) > 2 * STRETCH - 1 and held:
                flush()
                size = 0
            held.append((i, at, piece))
            size += len(piece)
    flush()
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _spans(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal unions of byte ranges, by document; ranges that touch are one."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    if not len(doc):
        return doc, start, stop
    group = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1])))
    high = stop.max() + 1
    reach = np.maximum.accumulate(stop + group * high) - group * high
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (start[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return doc[at], start[at], reach[np.append(at[1:], len(doc)) - 1]


def _batched(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    ids: list[int] = []
    twins: list[int] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for i, w, t in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            ids.append(i)
            twins.append(w)
            texts.append(t)
            size += len(t)
            if size >= limit:
                yield ids, twins, texts
                ids, twins, texts, size = [], [], [], 0
    if ids:
        yield ids, twins, texts


#: In an order that lets zeros meet, which take no room in a shuffle.
_PHRASE = "phrase bigint, doc_id bigint, at bigint, twin bigint, route bigint"


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parse, with copies inside a chunk set aside: of equal phrases the first stands for all.

    ``at`` is 128 * first window + windows. With 0 windows a row is a range of bytes that repeats an earlier one of
    the chunk: ``at`` gives its first byte, ``phrase`` its length, and ``route`` only spreads such rows. Rows with the
    same doc_id may each have a phrase at the first one's place: none is earlier, each of them stands for itself.
    """

    def rows(route, phrase, doc, at, twin):
        return pa.RecordBatch.from_arrays(
            [pa.array(phrase.view(np.int64)), pa.array(doc), pa.array(at), pa.array(twin), pa.array((route & _ROUTE).view(np.int64))],
            ["phrase", "doc_id", "at", "twin", "route"],
        )

    for ids, twins, texts in _batched(batches, CHUNK_BYTES):
        row, start, n, trigger, phrase = _parsed(range(len(texts)), texts)
        id_of, twin_of = np.array(ids, dtype=np.int64), np.array(twins, dtype=np.int64)
        order = np.lexsort((twin_of[row], start, id_of[row], phrase))
        new = np.ones(len(order), dtype=bool)
        new[1:] = phrase[order][1:] != phrase[order][:-1]
        least = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # the first place of each phrase
        level = (id_of[row[order]] == id_of[row[least]]) & (start[order] == start[least])
        # Equal rows share their key, so that one of them is enough.
        copy = np.zeros(len(order), dtype=bool)
        copy[1:] = level[1:] & ~new[1:] & (twin_of[row[order]][1:] == twin_of[row[order]][:-1])
        first, again = order[level & ~copy], order[~level]
        yield rows(trigger[first], phrase[first], id_of[row[first]], start[first] * 128 + n[first], twin_of[row[first]])
        if len(again):
            r, a, z = _spans(row[again], start[again], start[again] + n[again] - 1 + LENGTH)
            d = id_of[r]
            yield rows(mix(d.view(_U) * _U(_BASE) + a.astype(_U)), (z - a).astype(np.int64), d, a * 128, twin_of[r])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, twin, text, id): a null id as the least number, a null text as empty, ``id`` as it came.

    Equal rows have equal ranges and may share a key. Where an id stands for different texts, ``twin`` is the hash of
    the text; a table without such ids has zeros, which take no room.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
    )
    own = F.xxhash64("text")
    mixed = rows.groupBy("doc_id").agg(F.min(own).alias("a"), F.max(own).alias("z")).filter("a <> z")
    twin = own if mixed.limit(1).count() else F.lit(0).cast("long")
    return rows.select("doc_id", twin.alias("twin"), "text", "id")


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, twin, start, stop): byte ranges covered by strings of LENGTH bytes that start earlier in the corpus
    too, by ascending id, then place; the same place of the same id is not earlier. Ranges of one document may overlap
    or be repeated. Bytes are those of the UTF-8 text; ``twin`` tells rows of one id apart (``_keyed``)."""
    return _ranges(_keyed(docs, id_col, text_col))


def _ranges(keyed: DataFrame) -> DataFrame:
    source = keyed.select("doc_id", "twin", "text")
    parsed = source.mapInArrow(_phrases, _PHRASE)
    occurrence = Window.partitionBy("route", "phrase").orderBy("doc_id", "at")
    trigger = Window.partitionBy("route")
    windows = F.col("at") % 128
    # One shuffle, by trigger: the second window finds the rows where the first has left them.
    known = cut(
        parsed.withColumn("place", F.rank().over(occurrence))
        .withColumn("least", F.min("phrase").over(trigger))
        .withColumn("most", F.max("phrase").over(trigger))
        .filter((windows == 0) | (F.col("place") > 1) | (F.col("least") != F.col("most")))
        .select("phrase", "doc_id", "at", (F.col("place") > 1).alias("again"), "twin")
    )
    start = F.shiftright("at", 7)
    certain = known.filter("again OR at % 128 = 0").select(
        "doc_id", "twin", start.alias("start"),
        F.when(windows == 0, start + F.col("phrase")).otherwise(start + windows - 1 + LENGTH).alias("stop"),
    )
    # First occurrences of phrases that share their trigger with others: their windows are compared.
    open_ones = known.filter("NOT again AND at % 128 > 0").select("doc_id", "twin", "at")
    places = cut(open_ones.groupBy("doc_id", "twin").agg(F.sort_array(F.collect_set("at")).alias("places")))
    total = places.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
    if total <= BROADCAST_ROWS:
        opened = source.join(F.broadcast(places), ["doc_id", "twin"])
    else:
        opened = split_by_keys(source, places, ["doc_id", "twin"])[0].join(places, ["doc_id", "twin"])

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: list[tuple[np.ndarray, ...]] = []
            for doc, twin, text, at in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data = np.frombuffer(text, dtype=np.uint8)
                at = np.array(at, dtype=np.int64)
                n = at & 127
                starts = np.repeat((at >> 7) - (np.cumsum(n) - n), n) + np.arange(n.sum())
                if len(data) and len(starts):
                    hashed = _hashes(data, starts, starts + LENGTH, _prefix(data), powers(_UNBASE, len(data)))
                    seen.append((hashed, np.full(len(starts), doc), starts, np.full(len(starts), twin)))
            if seen:
                hashed, doc, starts, twin = (np.concatenate(x) for x in zip(*seen, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashed.view(np.int64)), pa.array(doc), pa.array(starts), pa.array(twin)],
                    ["suffix", "doc_id", "start", "twin"],
                )

    found = opened.select("doc_id", "twin", "text", "places").mapInArrow(
        suffixes, "suffix bigint, doc_id bigint, start bigint, twin bigint"
    )
    first = Window.partitionBy("suffix").orderBy("doc_id", "start")
    later = found.withColumn("place", F.rank().over(first)).filter("place > 1")
    compared = later.select("doc_id", "twin", "start", (F.col("start") + LENGTH).alias("stop"))
    return certain.unionByName(compared)


_OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
        T.StructField("kept", T.BinaryType()),
    ]
)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row; ``kept`` holds the remaining bytes.

    They may end or begin inside a character, so they are binary; ``texts=False`` leaves them null. A null text counts
    as empty, a text of fewer than LENGTH bytes loses nothing. Every row has its own ranges. Earlier means a smaller id,
    or a smaller place in a row of the same id, so equal rows lose nothing to each other. A null id comes before all
    others; null ids are equal.
    """
    source = _keyed(docs, id_col, text_col)
    by_document = _ranges(source).groupBy("doc_id", "twin").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            edges = [x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten()]
            row, start, stop = _spans(row, *edges)
            offsets = np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], fields=list(_RANGES.value_type))
            merged = pa.ListArray.from_arrays(pa.array(offsets), spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), merged], ["doc_id", "twin", "ranges"])

    spans_of = cut(by_document.mapInArrow(joined, "doc_id bigint, twin bigint, ranges array<struct<start:bigint,stop:bigint>>"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, ranges in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                spans = []
                if ranges:
                    a = np.array([r["start"] for r in ranges], dtype=np.int64)
                    z = np.array([r["stop"] for r in ranges], dtype=np.int64)
                    _, a, z = _spans(np.zeros(len(a), np.int64), a, np.minimum(z, len(text)))
                    spans = list(zip(a.tolist(), z.tolist(), strict=True))
                edges = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)) if spans else text
                out.append(
                    (doc, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if texts else None)
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out, strict=True), _TYPES, strict=True)] if out else [pa.array([], t) for t in _TYPES],
                _OUT.names,
            )

    # Texts that lose nothing need not meet their ranges: they are not shuffled.
    touched, whole = split_by_keys(source, spans_of, ["doc_id", "twin"])
    nothing = F.lit(None).cast(spans_of.schema["ranges"].dataType)
    rows = touched.join(spans_of, ["doc_id", "twin"], "left").select("id", "text", "ranges")
    return rows.unionByName(whole.select("id", "text", nothing.alias("ranges"))).mapInArrow(remove, _OUT)


_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]


def op7_prefix_free_repeats(docs: DataFrame) -> DataFrame:
    """The digest of the contract."""
    return without_repeats(docs, texts=False).drop("kept")
