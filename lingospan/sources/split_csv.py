"""CSV with quoted line breaks, read by many tasks however few the files.

Spark reads such a file whole in one task, because whether a line break ends a record depends on all quotes before it.
Here Spark's text reader cuts the files into splits of lines, and the splits are read twice. What a line does to being
inside quotes or not is found by regular expressions. The first pass puts the lines of each split together: does it end
inside quotes if it starts outside them, and if it starts inside? One after the other, the splits give the state at the
start of each. The second pass then joins the lines of each record; what a split border cuts is put together by the
split in which the record starts. Spark's own CSV parser reads the records.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: As Spark's CSV reader takes them: quotes are doubled inside quotes, only an empty field is NULL.
OPTIONS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

# A quote opens a quoted field only as the field's first character; what follows a closing quote belongs to the field up
# to the next comma. Possessive throughout: one way to match, and no recursion on long texts.
_QUOTED = r'(?:[^"]++|"")*+'
_OPEN = rf'(?:(?:"{_QUOTED}"[^,]*+|(?!")[^,]*+),)*+"{_QUOTED}\z'
OPENS = rf"(?s)\A{_OPEN}"
STAYS_OPEN = rf'(?s)\A{_QUOTED}(?:\z|"[^,]*+,{_OPEN})'

#: What a line does to the state: nothing, turn it round, leave it outside or inside quotes.
SAME, TURN, OUTSIDE, INSIDE = range(4)

_PIECES = "file bigint, owner bigint, split bigint, first boolean, whole boolean, record string"


def line_kind(line: Column) -> Column:
    opens, stays = F.rlike(line, F.lit(OPENS)), F.rlike(line, F.lit(STAYS_OPEN))
    kind = F.when(~F.contains(line, F.lit('"')), SAME).when(opens, F.when(stays, INSIDE).otherwise(TURN))
    return kind.otherwise(F.when(stays, SAME).otherwise(OUTSIDE)).cast("tinyint")


def states_after(kinds: np.ndarray, inside: bool) -> np.ndarray:
    """Whether the end of each line lies inside quotes, given whether the first line starts inside."""
    at = np.maximum.accumulate(np.where(kinds >= OUTSIDE, np.arange(len(kinds)), -1))
    turns = np.concatenate(([0], np.cumsum(kinds == TURN)))
    base = np.where(at < 0, inside, kinds[at] == INSIDE)
    return base ^ ((turns[1:] - np.where(at < 0, 0, turns[at + 1])) % 2 == 1)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
    """(file, split, first row, row after the last) of the successive splits in a batch."""
    files, splits = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    new = np.flatnonzero((files[1:] != files[:-1]) | (splits[1:] != splits[:-1])) + 1
    for a, z in zip([0, *new], [*new, len(files)]):
        if z > a:
            yield int(files[a]), int(splits[a]), a, z


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per split: whether it ends inside quotes from either start, and whether a record starts or ends in it."""
    key: tuple[int, int] | None = None
    outside, within, closes = False, True, False

    def row() -> pa.RecordBatch:
        columns = [[key[0]], [key[1]], [outside], [within], [closes]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["file", "split", "outside", "within", "closes"])

    for batch in batches:
        kinds = batch.column(2).to_numpy()
        for file, split, a, z in _runs(batch):
            if key != (file, split):
                if key is not None:
                    yield row()
                key, outside, within, closes = (file, split), False, True, False
            outside = bool(states_after(kinds[a:z], outside)[-1])
            after = states_after(kinds[a:z], within)
            within, closes = bool(after[-1]), closes or not after.all()
    if key is not None:
        yield row()


class _States:
    """The state at the start of every split, from the splits that hold quotes."""

    def __init__(self, rows: list[tuple[int, int, bool, bool, bool]]):
        self.splits: dict[int, list[int]] = {}
        self.after: dict[int, list[tuple[bool, int]]] = {}
        self.crossing = False
        for file, split, outside, within, closes in sorted(rows):
            if file not in self.splits:
                self.splits[file], self.after[file] = [], []
                inside, owner = False, 0
            if self.splits[file][-1:] == [split]:
                raise ValueError("two files have one hash: rename one of them")
            owner = split if not inside or closes else owner
            inside = within if inside else outside
            self.splits[file].append(split)
            self.after[file].append((inside, owner))
            self.crossing = self.crossing or inside

    def before(self, file: int, split: int) -> tuple[bool, int]:
        """Whether the split starts inside quotes, and the split in which the record that is open there starts."""
        place = bisect_left(self.splits.get(file, []), split)
        inside, owner = self.after[file][place - 1] if place else (False, split)
        return inside, owner if inside else split


def read_split_csv(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True) -> DataFrame:
    """The CSV at ``path`` (UTF-8; a file, folder or glob) with ``schema``, as Spark's ``multiLine`` reader gives it.

    Line breaks are ``\\n`` or ``\\r\\n``; those inside quotes stay as they are. Blank lines between records are left out,
    missing fields and fields of the wrong kind are NULL, and the first record of each file is left out as its
    ``header``. A quote left open takes the rest of its file, but for its last line break, into the field. Reads the
    lines once when called, and once or, where a record crosses a border, twice again when the rows are read. The driver
    gets a few numbers for each split with quotes; it keeps more than that of each split to plan the scan.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        line_kind(F.col("value")).alias("kind"), "value",
    )
    summary = "file bigint, split bigint, outside boolean, within boolean, closes boolean"
    turning = lines.where(F.contains("value", F.lit('"'))).select("file", "split", "kind")
    states = _States([tuple(r) for r in turning.mapInArrow(_summaries, summary).collect()])
    shared = spark.sparkContext.broadcast(states)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[int, int] | None = None
        inside, owner, first, foreign = False, 0, False, False
        held: list[str] = []  # the lines of the record that is open

        for batch in batches:
            kinds, text = batch.column(2).to_numpy(), batch.column(3)
            for file, split, a, z in _runs(batch):
                if key != (file, split):
                    if held:  # open at the border
                        yield _pieces(key, owner, first, False, pa.array(["\n".join(held)]))
                    key = (file, split)
                    inside, owner = shared.value.before(*key)
                    # What is open here started in another split.
                    held, first, foreign = [], split == 0, inside
                after = states_after(kinds[a:z], inside)
                inside = bool(after[-1])
                ends = np.flatnonzero(~after) + 1
                if not len(ends):
                    held += text.slice(a, z - a).to_pylist()
                    continue
                offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
                done = pc.binary_join(pa.ListArray.from_arrays(offsets, text.slice(a, int(ends[-1]))), "\n")
                if pc.any(pc.ends_with(done, "\r")).as_py():
                    done = pc.replace_substring_regex(done, "\r\\z", "")
                if held or foreign or first:
                    yield _pieces(key, owner, first, not foreign, pa.array(["\n".join([*held, done[0].as_py()])]))
                    done = done.slice(1)
                first, foreign, owner = False, False, split
                if len(done):
                    yield _pieces(key, owner, False, True, done)
                held = text.slice(a + int(ends[-1]), z - a - int(ends[-1])).to_pylist()
        if held:
            yield _pieces(key, owner, first, False, pa.array(["\n".join(held)]))

    pieces = lines.mapInArrow(assemble, _PIECES)
    records = pieces.where("whole").select("first", "record")
    if states.crossing:
        # As many parts as the record has splits: it is one row in the end.
        parts = pieces.where("NOT whole").groupBy("file", "owner").agg(
            F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("split", "record"))).alias("parts")
        )
        joined = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
        records = records.unionByName(parts.select("first", joined.alias("record")))
    records = records.where(F.col("record") != "")
    if header:
        records = records.where("NOT first")
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind.fields)
    return records.select(F.from_csv("record", ddl, OPTIONS).alias("r")).select("r.*")


def _pieces(key: tuple[int, int], owner: int, first: bool, whole: bool, records: pa.Array) -> pa.RecordBatch:
    names = ["file", "owner", "split", "first", "whole", "record"]
    values = [pa.scalar(v, pa.int64()) for v in (key[0], owner, key[1])] + [pa.scalar(v) for v in (first, whole)]
    return pa.RecordBatch.from_arrays([*[pa.repeat(v, len(records)) for v in values], records], names)
