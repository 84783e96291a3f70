"""Mixing sources to target weights by a low-discrepancy schedule.

Slot ``k`` of the mix lies at the golden-ratio point ``frac((k + 1) * phi)`` of the line of cumulative weights, which
names its source; the slot's rank within the source names a block of that source's shuffled token line. Blocks of a
source hold equally many tokens, so at every length of the mix each source has close to its share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lingospan.llm.common import WORD, cut, running_start

#: Points are multiples of 2^-40; the golden ratio's fractional part is rounded to an odd one, so none repeats early.
HALF, UNIT = 2**20, 2**40
GOLDEN = int((5**0.5 - 1) / 2 * UNIT) | 1
#: Cells of the unit line on which points and sources meet.
CELLS = 4096
#: Slots that are ranked together.
SPAN = 8192


def source_targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """From one row per source (source, source_size) the ``target`` of each: weights 1, 2, 3, repeating by the code
    points of the source (null last), sharing all sizes, no source above ``cap`` times its own; the excess goes to the
    others by weight until none is above.

    Sources that reach the cap are a prefix in the order of size per weight, so one running sum finds them all.
    The table of sources is the only thing a single task sees.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sizes.withColumn("sid", F.row_number().over(by_name)).withColumn("weight", (F.col("sid") - 1) % 3 + 1)
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "sid")
    everything = Window.partitionBy(F.lit(0))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, 0)
    shares = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("rate", F.col("left") / F.col("open"))
        .withColumn("capped", F.min((F.col("rate") * F.col("weight") >= cap * F.col("source_size")).cast("int")).over(upto))
    )
    # Once one source is below its cap, its rate holds for all that follow; min() only guards against rounding.
    first = F.first(F.when(F.col("capped") == 0, F.col("rate")), ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return shares.withColumn("rate", first).select(
        "source", "sid", "source_size",
        F.when(F.col("capped") == 1, (F.lit(cap) * F.col("source_size")).cast("double"))
        .otherwise(F.col("rate") * F.col("weight")).alias("target"),
    )


def block_plan(targets: DataFrame, block_tokens: int = 2048, least_blocks: int = 64, cap: int = 3) -> DataFrame:
    """Adds, per source: tokens of a block, blocks, tokens to take (the rounded target), slots for that (quota), and
    the source's stretch of the line of cumulative weights.

    A small source gets shorter blocks, so that it too has ``least_blocks`` of them (down to one token).
    """
    size = F.col("source_size")
    planned = (
        targets.withColumn("take", F.least(F.floor(F.col("target") + 0.5).cast("long"), cap * size))
        .withColumn("block", F.least(F.lit(block_tokens), F.ceil(size / least_blocks)).cast("long"))
        .withColumn("block", F.greatest(F.col("block"), F.lit(1)))
        .withColumn("blocks", F.ceil(size / F.col("block")).cast("long"))
        .withColumn("passes", F.when(size > 0, F.floor(F.col("take") / size)).otherwise(0).cast("long"))
        .withColumn("rest", F.col("take") - F.col("passes") * size)
        .withColumn("quota", (F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / F.col("block"))).cast("long"))
    )
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    return (
        planned.withColumn("slots", F.sum("quota").over(Window.partitionBy(F.lit(0))))
        .withColumn("high", F.sum("quota").over(upto))
        .withColumn("low", F.col("high") - F.col("quota"))
        .withColumn("offset", F.col("low"))
        .filter("quota > 0")
        .withColumns({c: (F.col(c) / F.col("slots") * F.lit(float(UNIT))).cast("long") for c in ("low", "high")})
    )


def schedule(plan: DataFrame) -> DataFrame:
    """One row per slot of the mix: (slot, sid, rank, block_no, tokens), tokens being taken from the block's start.

    Points are drawn for a few more slots than the quotas need; a source keeps its first ``quota`` ranks, and where
    the points leave it short the missing ranks follow at the end, so that every quota is met exactly.
    """
    spark = plan.sparkSession
    n = plan.agg(F.max("slots")).first()[0] or 0
    drawn = n + n // 16 + 64 if n else 0
    cell = UNIT // CELLS
    stretches = plan.select(
        "sid", "low", "high", "quota",
        F.explode(F.sequence(F.expr(f"low div {cell}"), F.expr(f"least(high div {cell}, {CELLS - 1})"))).alias("cell"),
    )
    # (k + 1) * GOLDEN modulo UNIT, in two halves so that no product leaves 64 bits.
    high, low = f"((id + 1) % {UNIT}L div {HALF})", f"((id + 1) % {HALF})"
    points = spark.range(drawn).select(
        F.col("id").alias("slot"),
        F.expr(f"((({high} * {GOLDEN}L) & {HALF - 1}L) * {HALF}L + {low} * {GOLDEN}L) & {UNIT - 1}L").alias("point"),
    )
    named = (
        points.withColumn("cell", F.expr(f"point div {cell}"))
        .join(stretches, "cell")
        .filter("point >= low and point < high")
        .select("slot", "sid", "quota", F.expr(f"slot div {SPAN}").alias("span"))
    )
    counts = cut(named.groupBy("sid", "span").agg(F.count("*").alias("n")))
    before = Window.partitionBy("sid").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("sid", "span").orderBy("slot")
    ranked = (
        named.withColumn("place", F.row_number().over(inside))
        .join(starts, ["sid", "span"])
        .select("slot", "sid", (F.col("start") + F.col("place") - 1).alias("rank"), "quota")
        .filter("rank < quota")
        .drop("quota")
    )
    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    missing = (
        plan.join(got, "sid", "left")
        .filter("coalesce(got, 0) < quota")
        .select("sid", "offset", F.explode(F.sequence(F.coalesce("got", F.lit(0)), F.col("quota") - 1)).alias("rank"))
        .select((F.lit(drawn) + F.col("offset") + F.col("rank")).alias("slot"), "sid", "rank")
    )
    block_no = F.expr("rank % blocks")
    whole = F.least(F.col("block"), F.col("source_size") - block_no * F.col("block"))
    last = F.least(whole, F.col("rest") - block_no * F.col("block"))
    return (
        ranked.unionByName(missing)
        .join(plan.select("sid", "block", "blocks", "passes", "rest", "source_size"), "sid")
        .select(
            "slot", "sid", "rank", block_no.alias("block_no"),
            F.when(F.expr("rank div blocks") < F.col("passes"), whole).otherwise(last).alias("tokens"),
        )
    )


def token_line(sized: DataFrame, seed: int = 0) -> DataFrame:
    """Each document's place on the shuffled token line of its source: ``begin``, with ``_bucket`` and ``_place``."""
    hashed = sized.withColumn("_order", F.xxhash64("doc_id", F.lit(seed)))
    return running_start(cut(hashed), ["sid"], "_order", ["doc_id", "size"], "size", "begin")


def mix(docs: DataFrame, block_tokens: int = 2048, cap: int = 3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(documents, schedule). Documents: doc_id, source, size, source_size, target, taken, one row for each input row.

    ``size`` is the number of words (null text: 0), ``taken`` the words the mix takes, repeats counted: at most
    ``cap`` times the size. A null source is a source of its own; a source without words has target 0. Rows that
    repeat a doc_id count on their own. Other columns are not looked at. Empty tables give empty results.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(docs.select("doc_id", "source", words.alias("size")))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), cap)
    plan = cut(block_plan(targets, block_tokens, cap=cap))
    targets = cut(targets)
    ids = targets.select(F.col("source").alias("_source"), "sid")
    line = cut(
        token_line(sized.join(ids, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), seed).drop("_order")
    )
    slots = schedule(plan)
    # One row per block. Stored, as the shares are: the driver's memory follows the exchanges of one plan.
    taken = cut(
        slots.join(plan.select("sid", "block", "source_size"), "sid")
        .withColumn("full", F.least(F.col("block"), F.col("source_size") - F.col("block_no") * F.col("block")))
        .groupBy("sid", "block_no")
        .agg(
            F.sum((F.col("tokens") == F.col("full")).cast("long")).alias("times"),
            F.max(F.when(F.col("tokens") < F.col("full"), F.col("tokens"))).alias("part"),
        )
    )
    pieces = (
        line.filter("size > 0")
        .join(plan.select("sid", "block"), "sid")
        .withColumn("end", F.col("begin") + F.col("size"))
        .withColumn("block_no", F.explode(F.expr("sequence(begin div block, (begin + size - 1) div block)")))
        .withColumn("from", F.greatest("begin", F.col("block_no") * F.col("block")))
        .withColumn("to", F.least("end", (F.col("block_no") + 1) * F.col("block")))
    )
    cut_at = F.col("block_no") * F.col("block") + F.coalesce("part", F.lit(0))
    per_row = (
        pieces.join(taken, ["sid", "block_no"])
        .withColumn(
            "words",
            (F.col("to") - F.col("from")) * F.col("times")
            + F.greatest(F.lit(0), F.least(F.col("to"), cut_at) - F.col("from")),
        )
        .groupBy("sid", "_bucket", "_place")
        .agg(F.sum("words").alias("taken"))
    )
    rows = (
        line.join(per_row, ["sid", "_bucket", "_place"], "left")
        .join(targets.drop("source"), "sid")
        .select(
            "doc_id", "source", "size", "source_size", "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        )
    )
    return rows, slots


def op9_golden_mix(docs: DataFrame) -> DataFrame:
    """The digest of the contract: every document with its size, its source's size and target, and the words taken."""
    return mix(docs)[0].select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, block_tokens: int = 2048, cap: int = 3) -> DataFrame:
    """``docs`` as the mix has them: a document as often as its words are taken, rounded to whole times.

    Documents of sources above their target may be left out, others come up to ``cap`` times. All columns stay.
    """
    taken = mix(docs, block_tokens, cap)[0].groupBy(F.col("doc_id").alias("_id")).agg(F.try_divide(F.sum("taken"), F.sum("size")))
    times = F.when(F.col("_share") > 0, F.floor(F.col("_share") + 0.5)).otherwise(0).cast("int")
    shares = cut(taken.toDF("_id", "_share").select("_id", times.alias("_times")).filter("_times > 0"))
    return (
        docs.join(shares, F.col("doc_id").eqNullSafe(F.col("_id")))
        .withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times"))))
        .drop("_id", "_times")
    )
