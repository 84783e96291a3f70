"""Class ids to names and back, and display formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lingospan.functions.text import col
from lingospan.schemas import NLI_DISPLAY_LABELS, NLI_EMOJIS, NLI_LABELS


def _names(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def decode_label(c: Column | str, names: Sequence[str] = NLI_LABELS, otherwise: str | None = None) -> Column:
    """Name of a class id. Ids outside the range give ``otherwise`` (NULL by default)."""
    c = col(c).cast("int")
    return F.when(c.between(0, len(names) - 1), F.get(_names(names), c)).otherwise(F.lit(otherwise))


def encode_label(c: Column | str, names: Sequence[str] = NLI_LABELS) -> Column:
    """Class id of a name; NULL for an unknown name."""
    return F.nullif(F.array_position(_names(names), col(c)), F.lit(0)).cast("int") - 1


def decode_paraphrase(c: Column | str) -> Column:
    """1 is a paraphrase, anything else is not."""
    return F.when(col(c) == 1, "Paraphrase").otherwise("Not paraphrase")


def decode_tags(c: Column | str, names: Sequence[str]) -> Column:
    """Names of an array of tag ids; ids outside the range (negative ones too) give NULL."""
    return F.transform(col(c), lambda t: F.when(t >= 0, F.get(_names(names), t)))


def format_prediction(
    label: Column | str,
    confidence: Column | str,
    names: Sequence[str] = NLI_DISPLAY_LABELS,
    emojis: Sequence[str] = NLI_EMOJIS,
) -> Column:
    """Text such as ``✅ **Entailment** (87.5% confidence)``."""
    return F.format_string(
        "%s **%s** (%.1f%% confidence)",
        decode_label(label, emojis),
        decode_label(label, names),
        col(confidence) * 100,
    )


def format_accuracy(c: Column | str) -> Column:
    return F.format_string("%.4f", col(c))


def format_gap(c: Column | str) -> Column:
    return F.format_string("%+.4f", col(c))


def format_percent(c: Column | str) -> Column:
    return F.format_string("%5.1f%%", col(c))
