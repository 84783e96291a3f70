"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

Rows lie in ``2^k`` source parts (a hash of the id). How many rows of each part go to each shard is drawn first,
exactly as a uniform random permutation of all rows would have it: a multivariate hypergeometric table with the
part sizes and the shard sizes as margins. Each part then permutes its rows and deals them out by its line of the
table, and each shard permutes what it has received. Shard sizes are exact, no global sort is needed, and every
choice is a function of the seed and the rows, so that a recomputed task gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingospan.llm.common import cut, fresh, let, running_start

#: Rows of a source part, about: a part is permuted by one task.
PART_ROWS = 65_536


def _unit(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key only."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") / F.lit(float(2**53))


def _hypergeometric(pool: Column, marked: Column, draws: Column, unit: Column) -> Column:
    """Marked items among ``draws`` from ``pool`` items of which ``marked`` are marked, by inversion at ``unit``.

    Weights relative to the mode follow from the ratio of neighbours, so no factorials are needed: one walk up and
    one down give their total, and a second pair finds where ``unit`` falls. Beyond 12 standard deviations the
    weights are far below what a double resolves.
    """

    def walk(v: Column) -> Column:
        def up(w: Column, k: Column) -> Column:
            return w * (v["marked"] - k) * (v["draws"] - k) / ((k + 1) * (v["all"] - v["marked"] - v["draws"] + k + 1))

        def down(w: Column, k: Column) -> Column:
            return w * k * (v["all"] - v["marked"] - v["draws"] + k) / ((v["marked"] - k + 1) * (v["draws"] - k + 1))

        def values(first: Column, last: Column) -> Column:
            step = F.when(first <= last, 1).otherwise(-1)
            return F.sequence(first.cast("long"), last.cast("long"), step.cast("long"))

        def total(last: Column, ratio) -> Column:
            return F.aggregate(
                values(v["mode"], last),
                F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s")),
                lambda a, k: F.struct(ratio(a["w"], k).alias("w"), (a["s"] + a["w"]).alias("s")),
                lambda a: a["s"],
            )

        def find(last: Column, ratio, t: Column) -> Column:
            # x: the value at which the weights so far pass t; null while they have not.
            return F.aggregate(
                values(v["mode"], last),
                F.struct(F.lit(1.0).alias("w"), t.alias("t"), F.lit(None).cast("double").alias("x")),
                lambda a, k: F.struct(
                    ratio(a["w"], k).alias("w"),
                    (a["t"] - a["w"]).alias("t"),
                    F.coalesce(a["x"], F.when(a["t"] < a["w"], k.cast("double"))).alias("x"),
                ),
                lambda a: a["x"],
            )

        both = F.struct(total(v["hi"], up).alias("up"), total(v["lo"], down).alias("down"))
        return let(
            both,
            lambda s: let(
                (s["up"] + s["down"] - 1.0) * unit,  # the mode is in both walks
                lambda t: F.coalesce(find(v["hi"], up, t), find(v["lo"], down, t - s["up"] + 1.0), v["lo"]),
            ),
        )

    N, K, n = pool.cast("double"), marked.cast("double"), draws.cast("double")
    lo, hi = F.greatest(F.lit(0.0), n - (N - K)), F.least(n, K)
    mode = F.least(hi, F.greatest(lo, F.floor((n + 1) * (K + 1) / (N + 2)).cast("double")))
    spread = F.sqrt(F.greatest(F.lit(0.0), n * K / N * (1 - K / N) * (N - n) / F.greatest(N - 1, F.lit(1.0))))
    reach = F.ceil(spread * 12).cast("double") + 64
    bound = F.struct(
        N.alias("all"), K.alias("marked"), n.alias("draws"), mode.alias("mode"),
        lo.alias("least"), hi.alias("most"), reach.alias("reach"),
    )
    return F.when(pool <= 0, F.lit(0)).otherwise(
        let(
            bound,
            lambda b: let(
                F.struct(
                    b["all"].alias("all"), b["marked"].alias("marked"), b["draws"].alias("draws"),
                    b["mode"].alias("mode"),
                    F.greatest(b["least"], b["mode"] - b["reach"]).alias("lo"),
                    F.least(b["most"], b["mode"] + b["reach"]).alias("hi"),
                ),
                walk,
            ),
        ).cast("long")
    )


#: Rows of a level of the matrix from which on they are drawn in many tasks.
SPREAD_ROWS = 64


def communication_matrix(counts: DataFrame, parts: int, shards: int, seed: int = 0) -> DataFrame:
    """From (part, n) draw (part, to): ``to[j]`` rows of the part go to shard ``j``.

    ``parts`` is a power of two. The table is drawn by halving: a set of parts with known totals per shard is split
    in two, the first half's share of every shard being hypergeometric. Sets of one level are independent rows.
    """
    sizes = F.col("sizes")
    root = (
        counts.agg(
            F.collect_list(F.struct("part", "n")).alias("have"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")
        )
        .withColumn("have", F.map_from_entries("have"))
        .select(
            F.lit(0).cast("long").alias("part"),
            F.transform(
                F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.coalesce(F.col("have")[p.cast("long")], F.lit(0))
            ).alias("sizes"),
            F.transform(
                F.sequence(F.lit(0), F.lit(shards - 1)),
                lambda j: F.floor(F.col("total") / shards) + F.when(j < F.col("total") % shards, 1).otherwise(0),
            ).alias("to"),
        )
    )
    level, width = root, parts
    while width > 1:
        half = width // 2
        first = F.slice(sizes, 1, half)

        def draw(s: Column, j: Column) -> Column:
            unit = _unit(F.col("part"), F.lit(half), j, F.lit(seed))  # noqa: B023
            return let(
                F.struct(
                    s["left"].alias("left"), s["need"].alias("need"), s["pool"].alias("pool"),
                    F.col("to")[j].alias("have"),
                    _hypergeometric(s["pool"], F.col("to")[j], s["need"], unit).alias("x"),
                ),
                lambda v: F.struct(
                    F.concat(v["left"], F.array(v["x"])).alias("left"),
                    (v["need"] - v["x"]).alias("need"),
                    (v["pool"] - v["have"]).alias("pool"),
                ),
            )

        add = lambda a, x: a + x
        zero = F.lit(0).cast("long")
        split = level.withColumn(
            "left",
            F.aggregate(
                F.sequence(F.lit(0), F.lit(shards - 1)),
                F.struct(
                    F.array().cast("array<bigint>").alias("left"),
                    F.aggregate(first, zero, add).alias("need"),
                    F.aggregate(F.col("to"), zero, add).alias("pool"),
                ),
                draw,
                lambda s: s["left"],
            ),
        )
        level = split.select(
            F.inline(
                F.array(
                    F.struct(F.col("part"), first.alias("sizes"), F.col("left").alias("to")),
                    F.struct(
                        (F.col("part") + half).alias("part"),
                        F.slice(sizes, half + 1, half).alias("sizes"),
                        F.zip_with("to", "left", lambda a, b: a - b).alias("to"),
                    ),
                )
            )
        )
        rows = parts // half
        if rows >= SPREAD_ROWS and rows.bit_length() % 3 == SPREAD_ROWS.bit_length() % 3:
            # The rows double with every level; they are dealt out over tasks at first and after each three levels.
            level = level.repartition("part")
        width = half
    return level.select("part", "to")


def shuffle_into_shards(docs: DataFrame, shards: int = 24, seed: int = 0, id_col: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes differ by one row at most. The id says which part a row lies in and how it is permuted; a null id is
    a value like any other, and rows that repeat an id are told apart by their place. Equal rows are interchangeable.
    An empty table gives an empty result; columns named ``shard`` or ``slot`` are replaced.
    """
    docs = docs.drop("shard", "slot")
    part, rank, to, order = fresh(docs, "_part", "_rank", "_to", "_order")
    parts = 1 << max(0, (docs.count() - 1) // PART_ROWS).bit_length()
    parts = max(parts, 16)
    source = docs.withColumn(part, F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(parts)))
    counts = source.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("n"))
    matrix = cut(communication_matrix(counts, parts, shards, seed)).withColumnsRenamed({"part": part, "to": to})
    local = Window.partitionBy(part).orderBy(F.xxhash64(F.col(id_col), F.lit(seed + 1)), *_rest(docs, id_col))
    dealt = (
        source.withColumn(rank, F.row_number().over(local))
        .join(matrix, part)
        .withColumn(
            "shard",
            # The first shard whose running total reaches the rank.
            F.aggregate(
                F.col(to),
                F.struct(F.lit(0).alias("j"), F.lit(0).cast("long").alias("s")),
                lambda a, n: F.struct(
                    (a["j"] + F.when(a["s"] + n < F.col(rank), 1).otherwise(0)).alias("j"), (a["s"] + n).alias("s")
                ),
                lambda a: a["j"],
            ),
        )
        .withColumn(order, F.xxhash64(F.col(part), F.col(rank), F.lit(seed + 2)))
        .drop(to)
    )
    slots = running_start(
        cut(dealt.select("shard", part, rank, order, F.lit(1).alias("_one"))), ["shard"], order, [part, rank], "_one", "slot"
    ).select(F.col(part), F.col(rank), F.col("slot").cast("long").alias("slot"))
    return dealt.join(slots, [part, rank]).drop(part, rank, order)


def _rest(docs: DataFrame, id_col: str) -> list[Column]:
    """What tells rows of one id apart: a hash of the columns that have one."""
    return [F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t])]


def op4_hypergeometric_shards(docs: DataFrame) -> DataFrame:
    """The digest of the contract: 24 shards under the law ``rows``. A null text has no bytes and a checksum of 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return shuffle_into_shards(narrow, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
