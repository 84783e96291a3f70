r"""How far the sources of a language differ in their terms, by partial counts in Arrow and divergences per shard.

A term is a run of letters A-Z, a-z and of characters beyond ASCII; only A-Z are lower-cased. Each task lower-cases,
splits, dictionary-encodes and counts its texts with Arrow's own functions and hands on partial counts. Spark merges
them. The merged counts of a language are dealt into shards by term, each of which holds all sources of its terms as
columns and adds up its part of every divergence; the parts are summed.

All arithmetic is on whole numbers. A group is the (language, source) of a document. In a group with N occurrences of
kept terms, out of V kept terms of the language, a term that occurs ``count`` times weighs
``p = 1 + floor(SCALE * (count + 2) / (N + 2 V))``, the language as a whole likewise. The divergence of two weights is
``floor((p - q)^2 / (p + q))``.

* A null text, language or source is read as ''. Empty texts and groups without terms take part with counts of 0.
* A term is kept in a language when at least ``least`` of its documents hold it; equal rows are documents of their own.
* A language without kept terms gives pairs with the value 0 and no terms.
* Ties are ranked by the item's UTF-8 bytes. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lingospan.llm.common import cut

#: What separates terms once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
#: Bytes of text that are split at a time, and rows of partial counts that a task holds before it hands them on.
SLICE_BYTES, HELD_ROWS = 8 << 20, 400_000
#: Rows of counts of a shard, about, and the cells of a dense block of weights.
SHARD_ROWS, CELLS = 100_000, 1 << 20

_COUNTS = "lang string, source string, term string, count bigint, docs bigint"
_KEYS = ["lang", "source", "term"]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about SLICE_BYTES of text."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(batch):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _count(rows: pa.RecordBatch) -> pa.Table:
    """Occurrences, and documents that hold the term, for each (lang, source, term) of some documents.

    Each group has a row with the term '' besides, so that one without terms is known too.
    """
    words = pc.split_pattern_regex(pc.ascii_lower(rows.column("text")), pattern=SEPARATORS)
    row, word = pc.list_parent_indices(words), pc.list_flatten(words)
    real = pc.not_equal(word, "")
    row, word = row.filter(real), word.filter(real).dictionary_encode()
    per_document = pa.table({"row": row, "word": word.indices}).group_by(["row", "word"]).aggregate([([], "count_all")])
    lang, source = rows.column("lang").dictionary_encode(), rows.column("source").dictionary_encode()
    grouped = pa.table(
        {
            "lang": lang.indices.take(per_document["row"]),
            "source": source.indices.take(per_document["row"]),
            "word": per_document["word"],
            "count": per_document["count_all"],
        }
    ).group_by(["lang", "source", "word"]).aggregate([("count", "sum"), ("count", "count")])
    terms = pa.table(
        {
            "lang": lang.dictionary.take(grouped["lang"].combine_chunks()),
            "source": source.dictionary.take(grouped["source"].combine_chunks()),
            "term": word.dictionary.take(grouped["word"].combine_chunks()),
            "count": grouped["count_sum"],
            "docs": grouped["count_count"],
        }
    )
    groups = pa.table({"lang": rows.column("lang"), "source": rows.column("source")}).group_by(["lang", "source"]).aggregate([])
    none = pa.array(np.zeros(len(groups), np.int64))
    found = groups.append_column("term", pa.array([""] * len(groups), pa.string()))
    return pa.concat_tables([found.append_column("count", none).append_column("docs", none), terms])


def _merged(tables: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(tables).group_by(_KEYS).aggregate([("count", "sum"), ("docs", "sum")])
    return summed.rename_columns({"count_sum": "count", "docs_sum": "docs"}).select([*_KEYS, "count", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) over ``docs`` (text, lang, source), and a row with the term '' per group."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            filled = [pc.fill_null(c, "") for c in batch.columns]
            for piece in _slices(pa.RecordBatch.from_arrays(filled, ["text", "lang", "source"])):
                held.append(_count(piece))
                rows += len(held[-1])
                if rows > HELD_ROWS:
                    held = [_merged(held)]
                    rows = len(held[0])
                    if 2 * rows > HELD_ROWS:
                        yield from held[0].to_batches(max_chunksize=50_000)
                        held, rows = [], 0
        if held:
            yield from _merged(held).to_batches(max_chunksize=50_000)

    texts = docs.select(*[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")])
    return (
        texts.mapInArrow(partial, _COUNTS)
        .groupBy(*_KEYS).agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    )


def _weights(counts: list[int], whole: list[int]) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / whole), exactly, whatever the size of the counts."""
    return np.array([1 + SCALE * (c + 2) // w for c, w in zip(counts, whole, strict=True)], dtype=np.int64)


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    # Weights lie between 1 and about SCALE, so the square fits.
    return (p - q) * (p - q) // (p + q)


def divergences(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) for ``docs`` (text, lang, source).

    Part ``pair``: each other source of the language with the divergence summed over all kept terms. Part ``term``:
    the ``top`` terms by which a source leans away from its language, those that weigh more in it.
    """
    counts = cut(term_counts(docs))
    kept = (
        counts.filter("term <> ''").groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("count").alias("whole")).filter(F.col("docs") >= least)
    )
    used = cut(counts.drop("docs").join(kept.drop("docs"), ["lang", "term"]))
    sizes = used.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    languages = used.groupBy("lang").agg(F.countDistinct("term").alias("v"), F.sum("count").alias("n_lang"), F.count("*").alias("rows"))
    shards = F.floor(F.col("rows") / SHARD_ROWS) + 1
    groups = cut(
        counts.filter("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left")
        .join(languages.select("lang", "v", "n_lang", shards.alias("shards")), "lang", "left").na.fill(0, ["n", "v", "n_lang"])
    )

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Part sums over the terms of a shard: left has its counts, right all sources of the language."""
        names, lang = right["source"].to_pylist(), key[0].as_py()
        if not len(left):  # a language's sources come to each of its shards, to one without terms too
            return _rows(lang, [], "pair", [], [])
        place = {s: i for i, s in enumerate(names)}
        v = right["v"][0].as_py()
        whole = [n + 2 * v for n in right["n"].to_pylist()]
        encoded = left["term"].combine_chunks().dictionary_encode()
        term, terms = encoded.indices.to_numpy(), encoded.dictionary.to_pylist()
        source = np.array([place[s] for s in left["source"].to_pylist()], dtype=np.int64)
        weight = _weights(left["count"].to_pylist(), [whole[s] for s in source])
        overall = _weights(left["whole"].to_pylist(), [right["n_lang"][0].as_py() + 2 * v] * len(left))

        lean = _divergence(weight, overall)
        order = sorted(np.flatnonzero(weight > overall), key=lambda i: (source[i], -lean[i], terms[term[i]].encode()))
        first = np.searchsorted(source[order], np.arange(len(names)))
        best = [i for at, i in enumerate(order) if at - first[source[i]] < top]
        found = [_rows(lang, [names[s] for s in source[best]], "term", [terms[t] for t in term[best]], lean[best])]

        # Blocks of sources against all sources, over blocks of terms: a bounded number of weights at a time.
        order = np.argsort(term, kind="stable")
        term, source, weight = term[order], source[order], weight[order]
        absent = _weights([0] * len(names), whole)
        some = max(1, CELLS // len(names))
        for begin in range(0, len(names), some):
            mine = np.arange(begin, min(begin + some, len(names)))
            sums = np.zeros((len(mine), len(names)), dtype=np.int64)
            for low in range(0, len(terms), some):
                a, z = np.searchsorted(term, [low, low + some])
                dense = np.repeat(absent[None, :], min(some, len(terms) - low), axis=0)
                dense[term[a:z] - low, source[a:z]] = weight[a:z]
                for at, s in enumerate(mine):
                    sums[at] += _divergence(dense[:, s : s + 1], dense).sum(axis=0)
            for at, s in enumerate(mine):
                others = np.flatnonzero(np.arange(len(names)) != s)
                found.append(_rows(lang, [names[s]] * len(others), "pair", [names[o] for o in others], sums[at, others]))
        return pa.concat_tables(found)

    # The number of shards follows the language's rows; terms are dealt into them by a hash.
    dealt = used.join(languages.select("lang", shards.alias("shards")), "lang")
    dealt = dealt.select("lang", F.pmod(F.xxhash64("term"), F.col("shards")), "source", "term", "count", "whole")
    dealt = dealt.toDF("lang", "shard", "source", "term", "count", "whole")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1))
    columns = groups.filter("v > 0").select("lang", every, "source", "n", "v", "n_lang")
    columns = columns.toDF("lang", "shard", "source", "n", "v", "n_lang")
    parts = cut(
        dealt.groupBy("lang", "shard").cogroup(columns.groupBy("lang", "shard"))
        .applyInArrow(compare, "lang string, source string, part string, item string, value bigint")
    )
    sums = parts.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = (
        groups.select("lang", "source").join(others, "lang").filter("source <> item")
        .join(sums, ["lang", "source", "item"], "left").na.fill(0, ["value"]).withColumn("part", F.lit("pair"))
    )
    both = pairs.unionByName(parts.filter("part = 'term'"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return (
        both.withColumn("rank", place.cast("int")).filter(F.col("part").eqNullSafe("pair") | (F.col("rank") <= top))
        .select("lang", "source", "part", "item", "value", "rank")
    )


def _rows(lang: str, source: list[str], part: str, item: list[str], value: np.ndarray | list[int]) -> pa.Table:
    n = len(source)
    columns = [pa.array(c, pa.string()) for c in ([lang] * n, source, [part] * n, item)]
    return pa.table([*columns, pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])


def op13_arrow_divergence(docs: DataFrame) -> DataFrame:
    """The digest of the contract: terms of at least 10 documents of their language, all pairs, ten terms a group."""
    return divergences(docs, least=10, top=10)
