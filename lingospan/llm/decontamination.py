"""Benchmark decontamination with SimHash windows, in DataFrame functions only.

An item is a set of five-word shingles, weighted by rarity among the items. A document is compared through windows of
as many words as an item has. A window whose weighted similarity reaches the threshold shares at least that part of
the item's weight, so windows are only formed where a document's shingles meet that bound: the bound loses nothing.
Windows and items then meet by SimHash: with a radius of r and r + 1 blocks of bits, fingerprints within the radius
agree on a block, so an equality join on blocks finds them all. The similarity itself is exact, on whole shingles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingospan.llm.common import cut

WORDS, THRESHOLD = 5, 0.8
#: At a similarity of 0.8 about 10 of 64 bits differ, with a deviation of 3: the radius lies over four deviations away.
RADIUS = 23
#: Rows up to which shingles of the benchmark, or ids of documents, are broadcast.
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order; none if there are fewer."""
    return F.when(
        F.size(words) >= size,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _bounded(df: DataFrame) -> DataFrame:
    """``df``, which is stored, marked for broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def simhash(weighted: Column) -> Column:
    """64 bits from an array of struct(h, w): each says which way the weights of the hashes with that bit lean."""

    def lean(bit: Column) -> Column:
        return F.aggregate(
            weighted,
            F.lit(0.0),
            lambda s, x: s + F.when(F.getbit(x["h"], bit) == 1, x["w"]).otherwise(-x["w"]),
        )

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("long"),
        lambda a, bit: F.when(
            lean(bit) > 0, a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
        ).otherwise(a),
    )


def blocks(print_: Column, radius: int = RADIUS) -> Column:
    """The fingerprint in ``radius`` + 1 blocks: array of struct(block, bits)."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("block"),
                F.shiftrightunsigned(print_, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).cast("int").alias("bits"),
            )
            for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
        ]
    )


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, size, shingles array of struct(h, w), weight, print): n words, shingles of ``size`` words.

    An item with fewer than five words is one shingle of all its words. Items without words are left out: nothing
    contains them. Equal items stay apart.
    """
    worded = (
        benchmark.select("item_id", tokens(F.coalesce("text", F.lit(""))).alias("words"))
        .withColumn("n", F.size("words"))
        .filter("n > 0")
    )
    size = F.least("n", F.lit(WORDS))
    by_size = F.coalesce(*[F.when(size == k, shingles(F.col("words"), k)) for k in range(1, WORDS + 1)])
    # Whole items, however many: the place of a shingle is not needed beyond this point.
    listed = worded.select("item_id", "n", size.alias("size"), F.array_distinct(by_size).alias("hashes"))
    listed = cut(listed.withColumn("item", F.monotonically_increasing_id()))
    single = listed.select("item", "size", F.explode("hashes").alias("h"))
    count = listed.count()
    weights = single.groupBy("size", "h").agg(F.log(1 + F.lit(count) / F.count("*")).alias("w"))
    weighted = single.join(weights, ["size", "h"]).groupBy("item").agg(
        F.sort_array(F.collect_list(F.struct("h", "w"))).alias("shingles")
    )
    total = F.aggregate("shingles", F.lit(0.0), lambda s, x: s + x["w"])
    return cut(
        listed.drop("hashes").join(weighted, "item")
        .withColumns({"weight": total, "print": simhash(F.col("shingles"))})
    )


def contaminations(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, item_id, similarity): every item that a document contains, with its most similar window.

    Whole texts are searched. A null or empty text contains nothing. A document with fewer words than an item is one
    window. Rows that repeat a doc_id, or have none, are told apart by their text; columns other than doc_id and text are
    not read.
    """
    items = items_of(benchmark)
    keyed = docs.select(
        F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"),
        F.xxhash64("text").alias("text_hash"), tokens(F.coalesce("text", F.lit(""))).alias("words"),
    )
    key = ["doc_id", "no_id", "text_hash"]  # no part is ever null
    places = cut(items.select("item", "n", "size", "weight", F.explode("shingles").alias("s")).select(
        "item", "n", "size", "weight", F.col("s.h").alias("h"), F.col("s.w").alias("w")
    ))
    sizes = [r.size for r in items.select("size").distinct().collect()]  # five at most
    found = None
    for size in sizes:
        known = _bounded(cut(places.filter(F.col("size") == size).select("h").distinct()))
        hits = keyed.select(*key, F.posexplode(shingles(F.col("words"), size)).alias("at", "h")).join(known, "h")
        hits = hits.withColumn("size", F.lit(size))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        none = {"item_id": F.lit(None).cast(benchmark.schema["item_id"].dataType), "similarity": F.lit(None).cast("double")}
        return docs.select("doc_id", F.xxhash64("text").alias("text_hash")).withColumns(none).limit(0)
    found = cut(found)
    # A window shares no more than its document does: what the document has of an item must reach the threshold.
    distinct = found.select(*key, "size", "h").distinct().join(places, ["size", "h"])
    able = (
        distinct.groupBy(*key, "item", "n", "size", "weight")
        .agg(F.sum("w").alias("has"))
        .filter(F.col("has") >= threshold * F.col("weight") - 1e-9)
        .drop("has")
    )
    able = cut(able)
    spots = able.join(places.drop("n", "weight"), ["item", "size"]).join(found, [*key, "size", "h"])
    # Starts of windows that hold a shared shingle, and the shared weight of each start's window.
    reach = F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("n") + F.col("size")), F.col("at"))
    windows = (
        spots.select(*key, "item", "n", "size", "weight", "h", "w", F.explode(reach).alias("start"))
        .groupBy(*key, "item", "n", "size", "weight", "start", "h")
        .agg(F.first("w").alias("w"))
        .groupBy(*key, "item", "n", "size", "weight", "start")
        .agg(F.sum("w").alias("shared"))
        .filter(F.col("shared") >= threshold * F.col("weight") - 1e-9)
        .select(*key, "n", "size", "start")
        .distinct()
    )
    windows = cut(windows)
    ids = _bounded(cut(windows.select(*key).distinct()))
    unknown = F.log(F.lit(1.0 + items.count()))  # the weight of a shingle that one item has
    held = cut(keyed.join(ids, key))
    filled = None
    for size in sizes:
        part = windows.filter(F.col("size") == size).join(held, key).select(
            *key, "n", "size", "start",
            F.array_distinct(shingles(F.slice("words", F.col("start") + 1, F.col("n")), size)).alias("hashes"),
        )
        filled = part if filled is None else filled.unionByName(part)
    one = cut(filled.withColumn("_row", F.monotonically_increasing_id()))
    valued = (
        one.select("_row", "size", F.explode("hashes").alias("h"))
        .join(places.select("size", "h", "w").distinct(), ["size", "h"], "left")
        .groupBy("_row")
        .agg(F.sort_array(F.collect_list(F.struct("h", F.coalesce("w", unknown).alias("w")))).alias("shingles"))
    )
    printed = cut(one.drop("hashes").join(valued, "_row").withColumn("print", simhash(F.col("shingles"))))
    left = printed.select("*", F.inline(blocks(F.col("print"))))
    right = items.select(
        "item_id", "item", "n", "size", F.col("shingles").alias("theirs"), F.col("print").alias("their_print"),
        F.inline(blocks(F.col("print"))),
    )
    near = left.join(right, ["n", "size", "block", "bits"]).filter(
        F.bit_count(F.col("print").bitwiseXOR(F.col("their_print"))) <= RADIUS
    )

    def total(of: Column, keep: Callable[[Column], Column] = lambda x: F.lit(True)) -> Column:
        return F.aggregate(of, F.lit(0.0), lambda s, x: s + F.when(keep(x), x["w"]).otherwise(0.0))

    both = total(F.array_intersect("shingles", "theirs"))
    similar = both / (total(F.col("shingles")) + total(F.col("theirs")) - both)
    return (
        near.dropDuplicates(["_row", "item"])
        .withColumn("similarity", similar)
        .filter(F.col("similarity") >= threshold - 1e-9)
        .groupBy(*key, "item_id")
        .agg(F.max("similarity").alias("similarity"))
        .select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "text_hash", "item_id", "similarity")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no item of the benchmark, with the columns they came with."""
    hit = contaminations(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_text"))
    return docs.join(hit, same, "left_anti")


def op8_simhash_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document with the number and ids of the items it contains, the best similarity (0 if none), and whether
    it is kept."""
    per_document = (
        contaminations(docs, benchmark)
        .groupBy("doc_id", "text_hash")
        .agg(
            F.count("*").alias("n_items"),
            F.concat_ws(",", F.transform(F.sort_array(F.collect_list("item_id")), lambda x: x.cast("string"))).alias("item_ids"),
            F.max("similarity").alias("similarity"),
        )
        .withColumnsRenamed({"doc_id": "_id", "text_hash": "_text"})
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_text"))
    return rows.join(per_document, same, "left").select(
        "doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.lit("")).alias("item_ids"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.col("_text").isNull().alias("kept"),
    )
