"""CSV read in splits against Spark's own reader of whole files."""

import csv
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingospan.sources.readers import read_csv_whole
from lingospan.schemas import literal_frame
from lingospan.sources.split_csv import line_kind, read_split_csv, states_after

DDL = "id BIGINT, a STRING, b STRING, n DOUBLE"
PARTS = ['"', '""', ",", "\n", "\n\n", "x", "é🙂", " ", "'", "\\", "word", '",', ',"', "\t", '"\n"', "  "]


def odd_rows(seed, n):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choices(PARTS, k=rng.randrange(0, 12)))
    return [[i, text(), text(), rng.choice(["1.5", "", "2"])] for i in range(n)]


def write(path, rows, **options):
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator=options.pop("lineterminator", "\n"), **options)
        out.writerow(["id", "a", "b", "n"])
        out.writerows(rows)


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("quoting", [csv.QUOTE_MINIMAL, csv.QUOTE_ALL, csv.QUOTE_NONNUMERIC])
def test_equals_the_whole_reader(spark, tmp_path, small_splits, quoting, end):
    for part in range(3):
        write(tmp_path / f"part{part}.csv", odd_rows(part, 120), quoting=quoting, lineterminator=end)
    got = read_split_csv(spark, str(tmp_path), DDL)
    assert rows_of(got) == rows_of(read_csv_whole(spark, str(tmp_path), DDL))
    assert got.count() == 360


def test_many_tasks_read_one_file(spark, tmp_path, small_splits):
    write(tmp_path / "one.csv", odd_rows(9, 500))
    got = read_split_csv(spark, str(tmp_path / "one.csv"), DDL)
    assert read_csv_whole(spark, str(tmp_path / "one.csv"), DDL).rdd.getNumPartitions() == 1
    assert spark.read.text(str(tmp_path / "one.csv")).rdd.getNumPartitions() > 8
    assert got.rdd.getNumPartitions() > 8 and got.count() == 500


def test_a_record_over_many_splits(spark, tmp_path, small_splits):
    long = "line, with \"\" and\n" * 500
    write(tmp_path / "long.csv", [[1, "before", "x", 1], [2, long, "y\nz", 2], [3, "", "after", 3]])
    got = {r.id: r for r in read_split_csv(spark, str(tmp_path), DDL).collect()}
    assert got[2].a == long and got[2].b == "y\nz" and got[3].a is None and got[1].a == "before"


@pytest.mark.parametrize(
    "text",
    [
        "", "id,a,b,n\n", "id,a,b,n", "id,a,b,n\n\n\n1,x,y,2\n\n", 'id,"a\nb",b,n\n1,x,y,2\n', "id,a,b,n\n1,x\n2,x,y,3,4,5\nbad,x,y,no\n",
        'id,a,b,n\n1,5" pipe,a "quoted" word,2\n2,x,y,3\n', "id,a,b,n\n1, x ,\t y,2\n", 'id,a,b,n\n1,"",,2\n',
    ],
)
def test_odd_files(spark, tmp_path, text):
    (tmp_path / "odd.csv").write_bytes(text.encode())
    assert rows_of(read_split_csv(spark, str(tmp_path), DDL)) == rows_of(read_csv_whole(spark, str(tmp_path), DDL))


def test_a_quote_left_open(spark, tmp_path, small_splits):
    (tmp_path / "open.csv").write_text('id,a,b,n\n1,x,y,2\n2,"open\n3,x,y,3\n')
    (tmp_path / "other.csv").write_text("id,a,b,n\n4,x,y,2\n")
    got = {r.id: r.a for r in read_split_csv(spark, str(tmp_path), DDL).collect()}
    assert got == {1: "x", 2: "open\n3,x,y,3", 4: "x"}


def test_without_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,"x\ny",b,2\n')
    assert [tuple(r) for r in read_split_csv(spark, str(tmp_path), DDL, header=False).collect()] == [(1, "x\ny", "b", 2.0)]


def inside_after(line, inside):
    """Whether a line ends inside quotes, letter by letter."""
    start, doubled = not inside, False
    unquoted = False  # in the rest of a field, where quotes are letters
    for i, c in enumerate(line):
        if doubled:
            doubled = False
        elif inside:
            if c == '"' and line[i + 1 : i + 2] == '"':
                doubled = True
            elif c == '"':
                inside, unquoted = False, True
        elif c == ",":
            start, unquoted = True, False
            continue
        elif c == '"' and start and not unquoted:
            inside = True
        else:
            unquoted = True
        start = False
    return inside


def test_states_of_lines(spark):
    rng = random.Random(1)
    lines = ["a,b", '"a', 'a"b', '"a","b', '""', 'x,"a""', '"' * 5, "", '"a"b"c,"', *["".join(rng.choices('"",ab', k=rng.randrange(12))) for _ in range(3000)]]
    lines += ['"' + 'x""' * 60_000, "x" * 100_000 + ',"a", ' * 20_000 + '"']
    kinds = [r.k for r in literal_frame(spark, [[i, x] for i, x in enumerate(lines)], "i INT, x STRING").orderBy("i").select(line_kind(F.col("x")).alias("k")).collect()]
    for start in (False, True):
        got, state = states_after(np.array(kinds), start), start
        for line, kind, after in zip(lines, kinds, got, strict=True):
            assert states_after(np.array([kind]), state)[0] == inside_after(line, state), line[:50]
            state = inside_after(line, state)
            assert state == after
