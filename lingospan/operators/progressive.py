"""Scoring that stops: growing ranges of ids are scored until each language has the errors it needs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingospan.config import ERRORS_PER_LANGUAGE, work_folder
from lingospan.operators.errors import misclassified
from lingospan.operators.ordering import required_id
from lingospan.operators.pairs import nonempty_pairs

#: Each range holds this many times the rows of all ranges before it, about.
GROWTH = 4
#: Shares of a language's rows at which a range may end, smallest first, and the rank error of the estimate.
SHARES = [GROWTH**-k for k in range(8, -1, -1)]
ACCURACY = 100_000
#: Rows that the first range holds at least, for each error that is wanted.
ROWS_PER_ERROR = 8


@dataclass
class Scan:
    """The rows that were scored, and how far each language was followed."""

    scored: DataFrame
    rounds: int = 0
    errors: dict[str | None, int] = field(default_factory=dict)
    exhausted: dict[str | None, bool] = field(default_factory=dict)


def _ends(pairs: DataFrame, order: str, lang: str, rows: int) -> dict[str | None, list[int]]:
    """The ids at which the ranges of each language end, the last one being its largest id.

    One pass over ids and languages; the driver gets a row per language.
    """
    found = pairs.select(lang, required_id(pairs, order).alias("_id")).groupBy(lang).agg(
        F.count("*").alias("n"), F.max("_id").alias("last"), F.percentile_approx("_id", SHARES, ACCURACY).alias("ids")
    )
    ends = {}
    for row in found.collect():
        reached = [i for share, i in zip(SHARES, row["ids"]) if row["n"] * share >= rows]
        ends[row[lang]] = sorted({*reached, row["last"]})
    return ends


def score_until(
    pairs: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    max_errors: int = ERRORS_PER_LANGUAGE,
    order: str = "example_id",
    lang: str = "lang",
    gold: str = "gold_label",
) -> Scan:
    """Score the non-empty pairs of each language in id order until ``max_errors`` (at least one) are misclassified.

    ``score`` adds ``predicted_label``; it is given the ranges of all languages that are still short of errors, one
    frame a round, and never a row twice. Its results are stored, so that counting does not score again, and the
    driver sees counts per language only. A range is scored whole, so rows beyond the last error needed may be
    among the scored ones: ``collect_errors`` and ``rows_checked`` give the same on them as on all rows scored.

    ``order`` is a unique integer id, a NULL in it fails the job; a NULL language is one of its own. The conditions
    on ids and languages reach the scan of a stored table.
    """
    limit = max(max_errors, 1)
    ends = _ends(pairs, order, lang, ROWS_PER_ERROR * limit)
    errors, done = dict.fromkeys(ends, 0), dict.fromkeys(ends, 0)
    spark, path, rounds = pairs.sparkSession, work_folder(pairs.sparkSession, "scan"), 0
    rows = nonempty_pairs(pairs)
    schema = score(rows).schema

    def is_open(code: str | None) -> bool:
        return errors[code] < limit and done[code] < len(ends[code])

    while still := [code for code in ends if is_open(code)]:
        wanted: Column = F.lit(False)
        for code in still:
            of = F.col(lang).isNull() if code is None else F.col(lang) == code
            of = of & (F.col(order) <= ends[code][done[code]])
            if done[code]:
                of = of & (F.col(order) > ends[code][done[code] - 1])
            wanted = wanted | of
            done[code] += 1
        part = f"{path}/round={rounds}"
        score(rows.where(wanted)).write.parquet(part)
        wrong = misclassified(spark.read.schema(schema).parquet(part).withColumnRenamed(gold, "gold_label"))
        for row in wrong.groupBy(lang).agg(F.count("*").alias("n")).collect():
            errors[row[lang]] += row["n"]
        rounds += 1
    if not rounds:
        return Scan(spark.createDataFrame([], schema))
    scored = spark.read.schema(schema).parquet(*[f"{path}/round={r}" for r in range(rounds)])
    return Scan(scored, rounds, errors, {code: done[code] == len(ends[code]) for code in ends})
