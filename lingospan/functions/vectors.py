"""Class-vector expressions: softmax, argmax, confidence.

The number of classes is known when the plan is built, so everything is plain arithmetic on columns and
stays inside generated code; no higher-order functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lingospan.functions.text import col


def class_columns(vector: Column | str, num_classes: int) -> list[Column]:
    """The ``num_classes`` entries of an array column as doubles."""
    return [F.get(col(vector), i).cast("double") for i in range(num_classes)]


def _extreme(columns: Sequence[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def softmax(logits: Sequence[Column]) -> Column:
    """Probabilities as ARRAY<DOUBLE>; the largest logit is subtracted first, so exp cannot overflow."""
    logits = [col(c).cast("double") for c in logits]
    weights = [F.exp(c - _extreme(logits)) for c in logits]
    total = reduce(add, weights)
    return F.array(*[w / total for w in weights])


def argmax(values: Sequence[Column]) -> Column:
    """Index of the largest entry, the first one on ties."""
    values = [col(c) for c in values]
    best = _extreme(values)
    result = F.lit(len(values) - 1)
    for i in reversed(range(len(values) - 1)):
        result = F.when(values[i] == best, F.lit(i)).otherwise(result)
    return result.cast("int")


def confidence(probs: Column | str) -> Column:
    return F.array_max(col(probs))


def has_bad_value(values: Sequence[Column]) -> Column:
    """True when any entry is null or NaN."""
    return reduce(or_, [col(c).isNull() | F.isnan(col(c).cast("double")) for c in values])
