"""Near-duplicate documents through an LSH forest of MinHash signatures.

A signature is sorted in several orders ("trees"), each reading its values in another sequence. Documents that agree
on the first values of a tree form a region; inside it the order puts those with the longest common prefix side by
side. Candidates are neighbours in that order, nearest first: every round compares each document with its nearest
neighbours of other components, and goes deeper only in regions that still hold several components, until none has a
pair that was not compared. Every link is confirmed on the full shingle sets.

Texts with the same set are one class from the start, so that copies cost one row each. A region of thousands of near
copies becomes one component after a round or two of neighbours; its pairs are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingospan.llm.common import compact, cut, fresh
from lingospan.llm.shingles import mix, pieces, shingle_sets

#: Values of a signature, trees, and values that a region agrees on. A pair with a similarity of 0.8 shares a region
#: with probability 1 - (1 - 0.8^4)^24, that is 0.999997.
VALUES, TREES, REGION = 128, 24, 4
#: Pairs whose signatures agree less than the threshold by this much are not compared: four standard deviations.
SLACK = 0.14
#: Neighbours compared in the first round; later rounds take eight times as many.
NEIGHBOURS = 1
#: Trees at which the passes of the first round end. The first trees link most of a large group of near copies, so that
#: the others need not pair its documents again.
PASSES = (2, 6, TREES)
#: Buckets of a histogram of shingles.
BUCKETS = 128
#: Rows up to which a table of ids is broadcast (16 bytes each).
BROADCAST_ROWS = 1_000_000

_SEEDS = mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A = (_SEEDS[:VALUES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (_SEEDS[VALUES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
#: The sequence in which each tree reads a signature; the trees' first values overlap as little as they can.
_ORDERS = np.stack(
    [
        np.concatenate(
            (
                head := np.random.Generator(np.random.PCG64(1 + t // (VALUES // REGION))).permutation(VALUES)[
                    (t % (VALUES // REGION)) * REGION : (t % (VALUES // REGION) + 1) * REGION
                ],
                np.random.Generator(np.random.PCG64(1000 + t)).permutation(np.setdiff1d(np.arange(VALUES), head)),
            )
        )
        for t in range(TREES)
    ]
)


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash signatures of non-empty sets, one row each."""
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offsets) - 1, VALUES), dtype=np.uint32)
    for j in range(VALUES):
        out[:, j] = np.minimum.reduceat(low * _A[j] + high * _B[j], offsets[:-1])
    return out


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _sets_of(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, digest, signature) of every document; no signature for an empty set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in pieces(batch.column(1).to_pylist()):
                hashes, offsets = shingle_sets(texts, size)
                counts = np.diff(offsets)
                full = np.flatnonzero(counts)
                signed: list[bytes | None] = [None] * len(texts)
                if len(full):
                    heads = np.append(offsets[:-1][full], offsets[-1])
                    for i, row in zip(full, signatures(hashes, heads), strict=True):
                        signed[i] = row.tobytes()
                digests = [_digest(hashes[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(counts), pa.array(digests), pa.array(signed, pa.binary())],
                    ["doc_id", "n", "digest", "signature"],
                )
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        sign, "doc_id bigint, n bigint, digest binary, signature binary"
    )


def _regions(classes: DataFrame) -> DataFrame:
    """(region, rep) of every tree, where a region has more than one class."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            signed = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(-1, VALUES)
            for t in range(TREES):
                region = np.full(len(signed), t + 1, dtype=np.uint64)
                for v in signed[:, _ORDERS[t, :REGION]].T:
                    region = mix(region * np.uint64(0xD1342543DE82EF95) + v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(region.view(np.int64)), batch.column(0), pa.array(np.full(len(signed), t, np.int32))],
                    ["region", "rep", "tree"],
                )

    planted = classes.select("rep", "signature").mapInArrow(plant, "region bigint, rep bigint, tree int")
    # Counted by an aggregate, which combines before the shuffle, however many classes a region has.
    shared = planted.groupBy("region").agg(F.count("*").alias("rows")).filter("rows > 1").select("region")
    return planted.join(shared, "region", "left_semi")


def _histograms(regions: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, n, counts) of each class in a region: its shingles, and how many fall into each of BUCKETS by their hash.

    The intersection of two sets is at most the sum of the smaller counts. So texts of one template that are not alike
    enough need not be compared, and no link is lost.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            bucket = (lists.flatten().to_numpy().view(np.uint64) % np.uint64(BUCKETS)).astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            counts = np.bincount(owner * BUCKETS + bucket, minlength=len(sizes) * BUCKETS).astype(np.uint32)
            rows = [row.tobytes() for row in counts.reshape(-1, BUCKETS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(rows, pa.binary())], ["rep", "n", "counts"])

    inside = sets.join(regions.select("rep").distinct(), "rep", "left_semi")
    return inside.select("rep", "hashes").mapInArrow(count, "rep bigint, n bigint, counts binary")


def _candidates(regions: DataFrame, parts: DataFrame, reach: int, percent: int) -> DataFrame:
    """(a, b): pairs of one region and different components, each document with its ``reach`` next ones in the order
    that belong to another component, where the signatures agree on nearly ``percent`` of their values.

    Beyond the nearest neighbours ``parts`` has histograms, which must leave room for a link, and a pair is taken in the
    first tree that has it in a region, and in no other.
    """
    nearby, least = reach == NEIGHBOURS, percent / 100 - SLACK
    heads, extra = _ORDERS[:, :REGION], [] if nearby else ["n", "counts"]

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            signed = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.uint32).reshape(-1, VALUES)
            path = np.take_along_axis(signed, _ORDERS[batch.column(2).to_numpy()], axis=1).astype(">u4")
            path = [row.tobytes() for row in path[:, REGION : REGION + 16]]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in (0, 1, 3, 2)), pa.array(path, pa.binary()), *batch.columns[4:]],
                ["region", "rep", "part", "tree", "path", "signature", *extra],
            )

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come by region and path. The last row of another component before a row is the one before its run of
        # rows of one component; so a batch needs that row and the last row of the batch before it.
        carried: list[np.ndarray] | None = None
        for batch in batches:
            if not len(batch):
                continue
            rows = [batch.column(i).to_numpy() for i in (0, 1, 2)]
            rows.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), dtype=np.uint32).reshape(-1, VALUES))
            known = 0
            if carried is not None:
                known = len(carried[0])
                rows = [np.concatenate((c, r)) for c, r in zip(carried, rows, strict=True)]
            region, rep, part, signed = rows
            n = len(region)
            new = np.ones(n, dtype=bool)
            new[1:] = (region[1:] != region[:-1]) | (part[1:] != part[:-1])
            before = np.maximum.accumulate(np.where(new, np.arange(n), 0)) - 1
            met = np.flatnonzero((before >= 0) & (region[before] == region))
            met = met[met >= known]
            met = met[(signed[met] == signed[before[met]]).mean(axis=1) >= least]
            pairs = [rep[met], rep[before[met]]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(*pairs)), pa.array(np.maximum(*pairs))], ["a", "b"])
            kept = [n - 1] if before[-1] < 0 or region[before[-1]] != region[-1] else [before[-1], n - 1]
            carried = [r[kept] for r in rows]

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Only the rows that later ones may still be compared with are held.
        last: int | None = None
        held_rep = held_part = held_n = np.zeros(0, np.int64)
        held, held_counts = np.zeros((0, VALUES), np.uint32), np.zeros((0, BUCKETS), np.uint32)
        m = 0
        for batch in batches:
            left: list[np.ndarray] = [np.zeros(0, np.int64)]
            right: list[np.ndarray] = [np.zeros(0, np.int64)]
            signed = np.frombuffer(b"".join(batch.column(5).to_pylist()), dtype=np.uint32).reshape(-1, VALUES)
            rows = zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3, 6)), strict=True)
            counts = np.frombuffer(b"".join(batch.column(7).to_pylist()), dtype=np.uint32).reshape(-1, BUCKETS)
            for i, (region, rep, part, tree, n) in enumerate(rows):
                if region != last:
                    last, m = region, 0
                others = np.flatnonzero(held_part[:m] != part)[-reach:]
                if len(others):
                    same = held[others] == signed[i]
                    alike = np.flatnonzero(same.mean(axis=1) >= least)
                    alike = others[alike[same[alike][:, heads].all(axis=2).argmax(axis=1) == tree]]
                    room = np.minimum(held_counts[alike], counts[i]).sum(axis=1, dtype=np.int64)
                    found = held_rep[alike[100 * room >= percent * (held_n[alike] + n - room)]]
                    left.append(np.minimum(found, rep))
                    right.append(np.maximum(found, rep))
                if m == len(held):
                    grown = (np.concatenate((h, np.zeros(m + 64, np.int64))) for h in (held_rep, held_part, held_n))
                    held_rep, held_part, held_n = grown
                    held, held_counts = (np.concatenate((h, np.zeros((m + 64, h.shape[1]), np.uint32))) for h in (held, held_counts))
                held_rep[m], held_part[m], held_n[m], held[m], held_counts[m] = rep, part, n, signed[i], counts[i]
                m += 1
                # A row leaves once ``reach`` rows of each of two components, or as many others, have come after it.
                if m > 4 * reach + 64:
                    count: dict[int, int] = {}
                    keep = []
                    for back in range(m - 1, -1, -1):
                        own = count.get(held_part[back], 0)
                        if own < reach and (m - 1 - back - own < reach or len(count) < 2):
                            keep.append(back)
                        count[held_part[back]] = own + 1
                    keep.reverse()
                    m = len(keep)
                    for kept in (held_rep, held_part, held_n, held, held_counts):
                        kept[:m] = kept[keep]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    kinds = "" if nearby else ", n bigint, counts binary"
    return (
        regions.select("region", "rep", "tree")
        .join(parts, "rep")
        .select("region", "rep", "tree", "part", "signature", *extra)
        .mapInArrow(order, "region bigint, rep bigint, part bigint, tree int, path binary, signature binary" + kinds)
        .repartition("region")
        .sortWithinPartitions("region", "path", "rep")
        .mapInArrow(nearest if nearby else pair, "a bigint, b bigint")
        .distinct()
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union. Compared in the JVM: sets of long texts, two in a row, would
    make Arrow batches of unknown size."""
    shared = F.size(F.array_intersect("x", "y"))
    linked = 100 * shared >= percent * (F.size("x") + F.size("y") - shared)
    one = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("x"))
    two = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(one, "a").join(two, "b").filter(linked).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, part): the least node that each linked node can be reached from, by alternating large and small stars."""
    edges = cut(links.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").filter("u <> v").distinct())
    before = None
    rows = edges.count()
    while True:
        edges = compact(edges, rows)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = compact(large, rows).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = compact(large.join(small, "u"), rows).select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        )
        edges = cut(compact(linked.select("col.*").filter("u <> v").distinct(), rows))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("part"))
        before, rows = state, state[0]


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text; other columns are not looked at).

    Shingles have ``words`` words; a shorter text is one shingle; a text that is null or has no word has none and is
    linked with nothing. Texts are linked when 100 * intersection >= ``percent`` * union of their sets. A component
    is named by its least doc_id. A null doc_id belongs to the component of its text but never names one.
    """
    rows = cut(_sets_of(docs, words))
    classes = cut(
        rows.filter("n > 0").groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")).filter("rep IS NOT NULL")
    )
    regions = cut(_regions(classes))
    count = regions.count()
    inside = compact(regions.select("rep").distinct(), count)
    members = cut(compact(classes.select("rep", "digest").join(inside, "rep"), count))
    size = members.count()
    wanted = F.broadcast(members) if size <= BROADCAST_ROWS else members
    parts = compact(classes.join(wanted.select("rep"), "rep").select("rep", "signature"), size, 50_000)
    parts = cut(parts.withColumn("part", F.col("rep")))

    def hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in pieces(batch.column(1).to_pylist()):
                hashes, offsets = shingle_sets(texts, words)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes.view(np.int64)))
                # A row that repeats a doc_id with another text has another set than the one that was signed.
                signed = batch.column(2).slice(at, len(texts)).to_pylist()
                own = [_digest(hashes[a:b]) == d for a, b, d in zip(offsets, offsets[1:], signed, strict=False)]
                found = pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), lists], ["rep", "hashes"])
                yield found.filter(pa.array(own))
                at += len(texts)

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted, "rep").select("rep", "text", "digest")
    sets = texts.mapInArrow(hash_sets, "rep bigint, hashes array<bigint>")
    sets = cut(sets.groupBy("rep").agg(F.first("hashes").alias("hashes")))
    reach = NEIGHBOURS
    room = None
    while count:
        if reach > NEIGHBOURS and room is None:
            room = cut(_histograms(regions, sets))
        for first, end in zip((0, *PASSES), PASSES, strict=False) if reach == NEIGHBOURS else [(0, TREES)]:
            some = regions if (first, end) == (0, TREES) else regions.filter(f"tree >= {first} AND tree < {end}")
            known = parts if room is None else parts.join(room, "rep")
            found = cut(_confirmed(_candidates(some, known, reach, percent), sets, percent))
            links = found.count()
            if links:
                found = compact(found, links)
                ends = parts.select("rep", "part")
                joined = found.join(ends.toDF("a", "p"), "a").join(ends.toDF("b", "q"), "b").select("p", "q").toDF("a", "b")
                moved = components(joined).toDF("part", "to")
                parts = parts.join(moved, "part", "left").select("rep", "signature", F.coalesce("to", "part").alias("part"))
                parts = cut(compact(parts, size, 50_000))
        open_regions = (
            regions.join(parts.select("rep", "part"), "rep").groupBy("region")
            .agg(F.count("*").alias("rows"), F.min("part").alias("least"), F.max("part").alias("most"))
            .filter(f"rows > {reach + 1} AND least <> most").select("region")
        )
        regions = cut(compact(regions.join(open_regions, "region", "left_semi"), count))
        count = regions.count()
        reach *= 8
    named = parts.select("rep", "part")
    whole = rows.select("doc_id", F.col("n").alias("n_shingles"), "digest")
    labels = classes.select("digest", "rep").join(named, "rep", "left").select(
        "digest", F.coalesce("part", "rep").alias("component_id")
    )
    return whole.join(labels, "digest", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` of each component, that with the least doc_id, a null one last; all columns stay.

    Rows are told apart by doc_id and text, so a row that shares its doc_id with another text is judged by its own. Of
    rows equal in both one stays. Rows without words are linked with nothing and all stay, equal ones too.
    """
    (key,) = fresh(docs, "_row")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = cut(near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), words, percent))
    ids = keyed.select(F.col(key).alias("doc_id"), F.col("doc_id").cast("long").alias("id")).distinct()
    linked = found.filter("n_shingles > 0").select("doc_id", "component_id").distinct().join(ids, "doc_id")
    least = linked.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")).alias("least"))
    # Rows whose hashes meet by chance both stay if either does.
    marks = found.groupBy("doc_id").agg(F.min("n_shingles").alias("n"), F.count("*").alias("rows")).join(
        least.select(F.col("least.doc_id").alias("doc_id"), F.lit(True).alias("first")).distinct(), "doc_id", "left"
    )
    marks = cut(marks.filter("first OR n = 0").select(F.col("doc_id").alias(key), (F.col("n") > 0).alias(f"{key}_one"), "rows"))
    stay = keyed.join(marks.select(key), key, "left_semi")
    again = marks.filter(f"{key}_one AND rows > 1").select(key)
    if again.isEmpty():
        return stay.drop(key)
    # dropDuplicates combines before the shuffle, so that a text that many rows share comes once from each task.
    repeated = stay.join(again, key, "left_semi").dropDuplicates([key])
    return stay.join(again, key, "left_anti").unionByName(repeated).drop(key)


def op2_forest_components(docs: DataFrame) -> DataFrame:
    """The digest of the contract: shingles of four words."""
    return near_duplicates(docs, words=4).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
