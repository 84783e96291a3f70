r"""Conversations as one prefix tree: a turn that several share at their start is emitted once.

A node of the tree is a turn together with all turns before it. The tree is cut into chains: a node belongs to the least
conversation that passes through it, so what a conversation owns is the end of its path, in one piece. Chains in depth
first order put every chain after the one it branches from, and deeper branches before shallower ones; so the emitted
stream is a depth-first walk. Each node tells its place in the stream, the position of its first token in its
conversation, the tokens under the loss mask, and the stretches of the stream that its tokens attend to.

The template is ``<|im_start|>role\ntext<|im_end|>\n``. In a text ``<``, any backslashes and ``|`` get one more backslash,
so that no text holds ``<|``; a role has backslashes doubled and line feeds written ``\n`` besides. Both are undone when
read. Without a tokenizer a token is a code point.

* Turns are ordered by turn, nulls first, then by the MD5 of what the template makes of them before its end mark;
  rows that repeat a turn stay, one node after the other.
* A null text or role is empty. Rows without conv_id are one conversation. Empty texts are turns like any other.
* An empty table gives no rows. Other columns are not looked at.
* A conversation may hold most rows: its turns are hashed in pieces, and read back as a stream. One that repeats others
  owns no node. A row of the result grows with the branchings on a path, not with its turns.
* Nodes are told apart by 127 bits of hash; equal hashes count as equal.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingospan.llm.common import cut, stored

START, END = "<|im_start|>", "<|im_end|>"
#: Stands for a null conv_id among the keys.
NO_ID = -(1 << 63)
#: Nodes that a piece of an interval holds when a conversation is read back.
PIECE = 4096

_PRIME, _BASE = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + r"\n", re.DOTALL)

Tokenizer = Callable[[Column], Column]


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def _turns(conversations: DataFrame, tokenize: Tokenizer | None) -> DataFrame:
    """Formatted turns in order, conversation after conversation, over checkpointed partitions."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    size = (lambda c: F.size(tokenize(c))) if tokenize else F.length
    parts = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
    ).select(
        "*",
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    tail = F.lit(END + "\n")
    rows = parts.select(
        "conv", "turn", "role", "text",
        F.md5(F.concat("head", "body").cast("binary")).alias("digest"),
        size(F.col("head")).cast("long").alias("head"),
        size(F.col("body")).cast("long").alias("body"),
        size(tail).cast("long").alias("tail"),
    )
    # The turn is part of the range, so that a long conversation spreads over partitions.
    order = ["conv", "turn", "digest"]
    rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    return rows.withColumn("part", F.spark_partition_id().cast("long"))


def _paths(turns: DataFrame) -> DataFrame:
    """(conv, k, node, parent, begin, role, text, head, body, tail): the k-th turn of a conversation, the hash of the
    turns up to it and up to the one before, and the number of tokens before it.

    Every partition is summed up in one row, the rows of all partitions give what each starts with, and a second
    pass hashes on from there. The hash is a polynomial, so that pieces of a conversation can be put together.
    """

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = last = None
        h = count = tokens = 0
        for batch in batches:
            for p, conv, digest, *sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != last:
                    h = count = tokens = 0
                    first, part, last = conv if first is None else first, p, conv
                h, count, tokens = (h * _BASE + int(digest, 16)) % _PRIME, count + 1, tokens + sum(sizes)
        if part is not None:
            columns = [[part], [first], [last], [h.to_bytes(16)], [count], [tokens]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "first", "last", "h", "count", "tokens"])

    schema = "part bigint, first bigint, last bigint, h binary, count bigint, tokens bigint"
    narrow = turns.select("part", "conv", "digest", "head", "body", "tail")
    carried: dict[int, tuple[int, int, int, int]] = {}
    at = (None, 1, 0, 0)
    for row in narrow.mapInArrow(sum_up, schema).orderBy("part").collect():  # a row per partition
        carried[row["part"]] = at
        h, count, tokens = int.from_bytes(row["h"]), row["count"], row["tokens"]
        _, h0, count0, tokens0 = at if at[0] == row["first"] == row["last"] else (None, 1, 0, 0)
        at = (row["last"], (h0 * pow(_BASE, count, _PRIME) + h) % _PRIME, count0 + count, tokens0 + tokens)
    shared = turns.sparkSession.sparkContext.broadcast(carried)

    def hash_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            ks, nodes, parents, begins = [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("part", "conv", "digest", "head", "body", "tail"))
            for part, conv, digest, *sizes in zip(*columns, strict=True):
                last, h, k, begin = shared.value[part] if state is None else state
                if conv != last:
                    h, k, begin = 1, 0, 0
                parents.append(h.to_bytes(16))
                begins.append(begin)
                h, k = (h * _BASE + int(digest, 16)) % _PRIME, k + 1
                nodes.append(h.to_bytes(16))
                ks.append(k)
                state = (conv, h, k, begin + sum(sizes))
            kept = {c: batch.column(c) for c in ("conv", "role", "text", "head", "body", "tail")}
            added = {"k": pa.array(ks, pa.int64()), "node": pa.array(nodes, pa.binary()), "parent": pa.array(parents, pa.binary()), "begin": pa.array(begins, pa.int64())}
            yield pa.RecordBatch.from_pydict({**kept, **added})

    return turns.mapInArrow(
        hash_on,
        "conv bigint, role string, text string, head bigint, body bigint, tail bigint, "
        "k bigint, node binary, parent binary, begin bigint",
    )


def _chains(nodes: DataFrame, owners: DataFrame) -> DataFrame:
    """A row per chain: (conv, tree, start, place, first, begin, via).

    ``start`` and ``place`` are its first token and node in the stream, ``first`` and ``begin`` its first turn and
    token in its conversation. ``via`` lists the chains that its path goes through, root first, with the nodes and
    tokens of each that lie on the path.
    """
    chains = nodes.groupBy("conv").agg(
        F.min("k").alias("first"), F.min("begin").alias("begin"), F.count("*").alias("nodes"),
        F.sum(F.col("head") + F.col("body") + F.col("tail")).alias("tokens"), F.min_by("parent", "k").alias("parent"),
    )
    chains = cut(chains)
    above = owners.select(F.col("node").alias("parent"), F.col("conv").alias("up"))
    top = chains.select(F.col("conv").alias("up"), F.col("first").alias("up_first"), F.col("begin").alias("up_begin"))
    step = F.struct(
        F.col("up").alias("chain"), (F.col("first") - F.col("up_first")).alias("nodes"), (F.col("begin") - F.col("up_begin")).alias("tokens")
    )
    branch = F.struct((1 - F.col("first")).alias("back"), F.col("conv"))
    paths = cut(
        chains.join(above, "parent", "left").join(top, "up", "left")
        .select("conv", "up", F.array(branch).alias("key"), F.when(F.col("up").isNotNull(), F.array(step)).otherwise(F.array().cast("array<struct<chain:bigint,nodes:bigint,tokens:bigint>>")).alias("via"))
    )
    # Each round doubles the number of chains that a path has come up: as many rounds as its binary digits.
    while not paths.filter("up IS NOT NULL").isEmpty():
        higher = paths.toDF("up", "next", "up_key", "up_via")
        known = F.col("up_key").isNotNull()
        paths = cut(
            paths.join(higher, "up", "left").select(
                "conv", F.col("next").alias("up"),
                F.when(known, F.concat("up_key", "key")).otherwise(F.col("key")).alias("key"),
                F.when(known, F.concat("up_via", "via")).otherwise(F.col("via")).alias("via"),
            )
        )
    # Depth first: a chain comes after the one it branches from, deeper branches first.
    sorted_ = chains.drop("parent").join(paths, "conv").repartitionByRange("key").sortWithinPartitions("key")
    sorted_ = cut(sorted_.drop("up")).withColumn("part", F.spark_partition_id())
    totals = sorted_.groupBy("part").agg(F.sum("tokens").alias("t"), F.sum("nodes").alias("n")).orderBy("part").collect()
    starts, at = {}, (0, 0)
    for row in totals:  # a row per partition
        starts[row["part"]] = at
        at = (at[0] + row["t"], at[1] + row["n"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for batch in batches:
            if not len(batch):
                continue
            start, node = starts[batch.column(0)[0].as_py()] if done is None else done
            tokens, count = batch.column(2), batch.column(3)
            ends, node_ends = pc.cumulative_sum(tokens, start=start), pc.cumulative_sum(count, start=node)
            done = (ends[-1].as_py(), node_ends[-1].as_py())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pc.subtract(ends, tokens), pc.subtract(node_ends, count)], ["conv", "start", "place"]
            )

    placed = sorted_.select("part", "conv", "tokens", "nodes").mapInArrow(place, "conv bigint, start bigint, place bigint")
    return sorted_.select("conv", F.col("key")[0]["conv"].alias("tree"), "first", "begin", "via").join(placed, "conv")


def _intervals(paths: DataFrame, chains: DataFrame) -> DataFrame:
    """(conv, on): the stretches of the stream on each path of (conv, via), as (start, end, node, node_end)."""
    starts = chains.select(F.col("conv").alias("chain"), "start", "place")
    steps = paths.select("conv", F.posexplode("via").alias("at", "s")).select("conv", "at", "s.*").join(starts, "chain")
    stretch = F.struct(
        "start", (F.col("start") + F.col("tokens")).alias("end"), F.col("place").alias("node"), (F.col("place") + F.col("nodes")).alias("node_end")
    )
    # As many as the path has branchings.
    listed = steps.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", stretch.alias("s")))).alias("on"))
    return listed.select("conv", F.transform("on", lambda o: o["s"]).alias("on"))


def format_conversations(conversations: DataFrame, tokenize: Tokenizer | None = None) -> tuple[DataFrame, DataFrame]:
    """The emitted nodes, and where each conversation lies in them.

    Nodes: (tree, node, start, end, position, role, formatted, loss_start, loss_end, attends). ``node`` numbers the
    stream; tokens start..end have the positions position, position + 1, ...; tokens loss_start..loss_end are learned,
    none if null; ``attends`` lists the stretches before ``start`` that its tokens see, all of them, as well as those
    of the node itself up to their own. With ``tokenize``, a function from text to an array of ids, ``tokens`` are added.

    Conversations: (conv_id, intervals), the stretches of the stream that make it up, as (start, end, node, node_end).
    """
    paths = stored(_paths(_turns(conversations, tokenize)), "chat-paths")
    owners = cut(paths.groupBy("node").agg(F.min("conv").alias("conv")))
    # No hot key: a node occurs once in a conversation.
    nodes = paths.join(owners, ["node", "conv"], "left_semi")
    chains = cut(_chains(nodes, owners))
    on = cut(_intervals(chains, chains))
    none = F.array().cast("array<struct<start:bigint,end:bigint,node:bigint,node_end:bigint>>")
    known = cut(chains.join(on, "conv", "left").select("conv", "tree", "start", "place", "first", "begin", F.coalesce("on", none).alias("on")))

    start = F.col("start") + F.col("begin") - F.col("chain_begin")
    learned = F.col("role") == "assistant"
    head, body, tail = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")), escape(F.col("text")), F.lit(END + "\n")
    before = F.transform("on", lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end")))
    own = F.when(start > F.col("start"), F.array(F.struct(F.col("start").alias("start"), start.alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    emitted = nodes.join(known.withColumnRenamed("begin", "chain_begin"), "conv").select(
        "tree",
        (F.col("place") + F.col("k") - F.col("first")).alias("node"),
        start.alias("start"),
        (start + F.col("head") + F.col("body") + F.col("tail")).alias("end"),
        F.col("begin").alias("position"),
        "role",
        F.concat(head, body, tail).alias("formatted"),
        F.when(learned, start + F.col("head")).alias("loss_start"),
        F.when(learned, start + F.col("head") + F.col("body")).alias("loss_end"),
        F.concat(before, own).alias("attends"),
        *([F.concat(tokenize(head), tokenize(body), tokenize(tail)).alias("tokens")] if tokenize else []),
    )
    ends = paths.groupBy("conv").agg(F.max(F.struct("k", "node", (F.col("begin") + F.col("head") + F.col("body") + F.col("tail")).alias("size"))).alias("e"))
    last = ends.select(F.col("conv").alias("whole"), "e.*").join(owners, "node").join(known, "conv")
    own = F.struct("start", (F.col("start") + F.col("size") - F.col("begin")).alias("end"), F.col("place").alias("node"), (F.col("place") + F.col("k") - F.col("first") + 1).alias("node_end"))
    members = last.select(
        F.when(F.col("whole") != NO_ID, F.col("whole")).alias("conv_id"), F.concat("on", F.array(own)).alias("intervals")
    )
    return emitted, members


def read_back(emitted: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from stored nodes and conversations.

    The nodes of a conversation come as a stream in the stream's order, so that only one node is held at a time.
    Tokens must be code points.
    """
    stretch = members.select("conv_id", F.explode("intervals").alias("s")).select("conv_id", "s.node", "s.node_end")
    low = F.col("piece") * PIECE
    pieces = stretch.select("*", F.explode(F.expr(f"sequence(node div {PIECE}, (node_end - 1) div {PIECE})")).alias("piece"))
    listed = pieces.select("conv_id", F.explode(F.sequence(F.greatest("node", low), F.least("node_end", low + PIECE) - 1)).alias("node"))
    text = emitted.select("node", "formatted", (F.col("loss_start") - F.col("start")).alias("a"), (F.col("loss_end") - F.col("start")).alias("z"))
    key = F.coalesce("conv_id", F.lit(NO_ID))
    rows = listed.join(text, "node").withColumn("conv", key).repartition("conv").sortWithinPartitions("conv", "node")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, done = None, []

        def give() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for conv, formatted, a, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                said = _TURN.fullmatch(formatted)
                now[1] += 1
                now[2].update(f"{unescape_role(said[1])}\n{unescape(said[2])}\n".encode())
                if a is not None:
                    learned = unescape(formatted[a:z])
                    now[3] += len(learned)
                    now[4].update(learned.encode())
                now[5] += len(formatted)
            if done:
                yield give()
                done = []
        if now is not None:
            done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))
            yield give()

    schema = "conv bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    found = rows.select("conv", "formatted", "a", "z").mapInArrow(digest, schema)
    return found.select(F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id"), *found.columns[1:])


def op12_prefix_tree_chat(conversations: DataFrame) -> DataFrame:
    """The digest of the contract: conversation -1 is added, all are formatted, stored and read back."""
    said = END + START + "assistant ok"
    probe = conversations.sparkSession.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    wanted = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    emitted, members = format_conversations(wanted.union(probe))
    return read_back(stored(emitted, "chat-nodes"), stored(members, "chat-members"))
