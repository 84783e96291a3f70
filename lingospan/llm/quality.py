"""Quality of documents by hierarchical empirical Bayes.

Two document classifiers (poor quality, toxic) are logistic regressions over words and over binned measures of a text's
form. The share of good documents on each host, and on each path of a host, is estimated from the classifiers' calls on
all documents: a host's share is shrunk toward the global one, a path's toward its host's, each by as much as the
spread between hosts (paths) says. A document's evidence is then combined with its path's posterior as prior odds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingospan.llm.common import cut

#: Labelled documents that teach at most, taken by a hash of the id.
SAMPLE_ROWS = 20_000
#: Features a classifier keeps: those that divide the labels best.
FEATURES = 600
#: Documents with the feature, at least, for it to be considered.
LEAST_DOCUMENTS = 5

_WORD = re.compile(r"[^\W\d_]+")
_SYMBOLS = str.maketrans("", "", "#$%&*!|<>{}[]=~^\\@+/")
_UPPER_OR_DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]|\d")


def _bin(share: float) -> int:
    """Bins of a share that double in width: 0 for none, then up to 1/64, 1/32, ... 1."""
    return 0 if share <= 0 else max(1, 7 + int(np.ceil(np.log2(min(share, 1.0)))))


def features(text: str) -> set[str]:
    """Distinct lower-case words, and one ``=name:bin`` for each measure of form."""
    words = _WORD.findall(text.lower())
    distinct = set(words)
    chars = max(1, len(text))
    count = max(1, len(words))
    lines = text.split("\n")
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    digits = sum(map(text.count, "0123456789"))
    upper = sum(1 for w in text.split() if len(w) > 2 and w.isupper())
    found = {
        f"=upper:{_bin(upper / count)}",
        f"=symbols:{_bin((len(text) - len(text.translate(_SYMBOLS))) / chars)}",
        f"=bars:{_bin(text.count(' | ') / count)}",
        f"=digits:{_bin(digits / chars)}",
        f"=runs:{_bin(runs / count)}",
        f"=distinct:{int(10 * len(distinct) / count)}",
        f"=lines:{_bin(1 - len(set(lines)) / len(lines))}",
        f"=words:{len(words).bit_length()}",
        f"=length:{int(2 * sum(map(len, words)) / count)}",
    }
    return distinct | found


@dataclass
class Head:
    """One classifier: weights by feature, intercept, and the share of positives it was taught with."""

    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0
    share: float = 0.0


def _counted(sample: DataFrame, labels: list[str]) -> DataFrame:
    """(feature, n, one count for each label): documents that have the feature, and those of them with the label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            marks = np.stack([np.ones(len(texts), np.int64)] + [batch.column(i + 1).to_numpy() for i in range(len(labels))])
            totals = [Counter() for _ in marks]
            for i, text in enumerate(texts):
                found = features(text)
                for total, mark in zip(totals, marks[:, i], strict=True):
                    if mark:
                        total.update(found)
            names = list(totals[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string())] + [pa.array([t[x] for x in names], pa.int64()) for t in totals],
                ["feature", "n", *labels],
            )

    schema = ", ".join(["feature string", "n bigint", *(f"{x} bigint" for x in labels)])
    return (
        sample.select("text", *labels)
        .mapInArrow(count, schema)
        .groupBy("feature")
        .agg(*[F.sum(x).alias(x) for x in ["n", *labels]])
        .filter(F.col("n") >= LEAST_DOCUMENTS)
    )


def _divides(n: Column, hits: Column, rows: int, positives: int) -> Column:
    """Twice the log-likelihood ratio of label and feature."""

    def cell(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share = positives / rows
    absent = F.lit(rows) - n
    missed = F.lit(positives) - hits
    return 2 * (
        cell(hits, n * share)
        + cell(n - hits, n * (1 - share))
        + cell(missed, absent * share)
        + cell(absent - missed, absent * (1 - share))
    )


def teach(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, Head]:
    """Classifiers ``poor`` (quality is 0) and ``toxic``, from at most ``SAMPLE_ROWS`` labelled documents.

    A null label teaches neither. Without both classes a classifier has no weights, and calls nothing.
    """
    chosen = (
        labels.select(
            F.col("doc_id").alias("_id"),
            F.coalesce(F.col("quality") == 0, F.lit(False)).cast("long").alias("poor"),
            F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long").alias("toxic"),
        )
        .dropna()
        .orderBy(F.xxhash64("_id"), "_id", "poor", "toxic")
        .limit(SAMPLE_ROWS)
    )
    found = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = cut(found.join(F.broadcast(chosen), "_id"))  # at most SAMPLE_ROWS rows of three numbers
    heads = ["poor", "toxic"]
    totals = sample.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(h), F.lit(0)).alias(h) for h in heads]).first()
    out = {h: Head() for h in heads}
    taught = [h for h in heads if 0 < totals[h] < totals["n"]]
    if not taught:
        return out
    counted = cut(_counted(sample, heads))
    vocabulary: dict[str, list[str]] = {}
    for h in taught:
        best = counted.select("feature", _divides(F.col("n"), F.col(h), totals["n"], totals[h]).alias("gain"))
        vocabulary[h] = [r.feature for r in best.orderBy(F.desc("gain"), "feature").limit(FEATURES).collect()]
    wanted = frozenset(x for v in vocabulary.values() for x in v)

    @F.pandas_udf("array<string>")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(wanted & features(t)) for t in texts], index=texts.index, dtype=object)

    held = cut(sample.select(kept("text").alias("found"), *heads))
    for h in taught:
        vectors = CountVectorizerModel.from_vocabulary(vocabulary[h], "found", "vector").setBinary(True).transform(held)
        model = LogisticRegression(
            featuresCol="vector", labelCol=h, maxIter=40, regParam=2e-4, standardization=False
        ).fit(vectors)
        weights = dict(zip(vocabulary[h], map(float, model.coefficients.toArray()), strict=True))
        out[h] = Head({k: w for k, w in weights.items() if w}, float(model.intercept), totals[h] / totals["n"])
    return out


def called(text: Column, heads: dict[str, Head]) -> Column:
    """struct(poor, toxic): each classifier's probability; 0 from one that was not taught."""
    names = list(heads)

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = {n: frozenset(heads[n].weights) for n in names}
        for texts in batches:
            scores = np.zeros((len(texts), len(names)))
            for i, t in enumerate(texts):
                found = features(t)
                for j, n in enumerate(names):
                    weights = heads[n].weights
                    if weights:
                        z = heads[n].intercept + sum(weights[x] for x in sorted(known[n] & found))
                        scores[i, j] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pd.DataFrame(scores, columns=names)

    return of(F.coalesce(text, F.lit("")))


def _strength(groups: DataFrame, least: float = 1.0, most: float = 1e6) -> float:
    """How many documents the prior of a level counts for, by the method of moments: the spread of group means beyond
    what their sizes explain, against the spread that single documents have."""
    r = groups.agg(
        F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.count("*").alias("k"), F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("prior"), 2)).alias("ss"),
        F.sum(F.col("n") * F.col("prior") * (1 - F.col("prior"))).alias("inner"),
    ).first()
    if not r.n or r.k < 2 or not r.inner:
        return most
    single = r.inner / r.n
    between = (r.ss - r.k * single) / max(r.n - r.nn / r.n, 1e-9)
    return float(min(most, max(least, single / between - 1))) if between > 0 else most


def decide(
    docs: DataFrame,
    labels: DataFrame,
    host: Column | str = "source",
    path: Column | str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, text_hash, p_document, host_posterior, path_posterior, p_good, kept), a row for each row of ``docs``.

    Null hosts and paths are groups of their own. A text that is null or has no word is not kept. Without labels
    nothing else is rejected. Only aggregates reach the driver: two numbers a level, and the classifiers.
    """
    host, path = (F.col(x) if isinstance(x, str) else x for x in (host, path))
    heads = teach(docs, labels, id_col, text_col)
    text = F.col(text_col)
    scored = cut(
        docs.select(
            F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), host.alias("host"), path.alias("path"),
            F.coalesce(F.regexp_like(text, F.lit(r"\w")), F.lit(False)).alias("worded"), called(text, heads).alias("p"),
        ).select("doc_id", "text_hash", "host", "path", "worded", ((1 - F.col("p.poor")) * (1 - F.col("p.toxic"))).alias("p"))
    )
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")))
    whole = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    share = whole.good / whole.n if whole.n else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("prior", F.lit(share))
    by_host = _strength(hosts)
    hosts = hosts.select(
        F.col("host").alias("host_"),
        ((F.col("prior") * by_host + F.col("good")) / (F.col("n") + by_host)).alias("host_posterior"),
    )
    paths = cut(
        paths.join(hosts, F.col("host").eqNullSafe(F.col("host_"))).drop("host_")
        .withColumn("prior", F.col("host_posterior"))
    )
    by_path = _strength(paths)
    paths = paths.select(
        F.col("host").alias("host_"), F.col("path").alias("path_"), "host_posterior",
        ((F.col("prior") * by_path + F.col("good")) / (F.col("n") + by_path)).alias("path_posterior"),
    )

    def odds(p: Column) -> Column:
        p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
        return F.log(p / (1 - p))

    # Evidence: the classifier's odds against the share of good documents it was taught with.
    taught = (1 - heads["poor"].share) * (1 - heads["toxic"].share)
    evidence = odds(F.col("p")) - odds(F.lit(taught))
    prior = odds(F.col("path_posterior"))
    p_good = F.when(F.lit(taught < 1), 1 / (1 + F.exp(-(evidence + prior)))).otherwise(F.lit(1.0))
    return (
        scored.join(paths, F.col("host").eqNullSafe(F.col("host_")) & F.col("path").eqNullSafe(F.col("path_")))
        .withColumn("p_good", p_good)
        .select(
            "doc_id", "text_hash", F.col("p").alias("p_document"), "host_posterior", "path_posterior", "p_good",
            (F.col("worded") & (F.col("p_good") >= 0.5)).alias("kept"),
        )
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns they came with."""
    rejected = decide(docs, labels).filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_text"))
    return docs.join(rejected, same, "left_anti")


def op5_hierarchical_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each document's probability of being good, its source and language serving as host and path, and the decision."""
    return decide(docs, labels).drop("text_hash")
