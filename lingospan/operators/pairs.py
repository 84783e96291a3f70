"""Row selection and reshaping of sentence-pair tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingospan.functions.multilingual import as_language_map, language_text
from lingospan.functions.text import has_text, is_blank, strip_text


def select_language(
    df: DataFrame,
    lang: str | Column,
    missing: str = "empty",
    columns: Sequence[str] = ("premise", "hypothesis"),
) -> DataFrame:
    """Replace multilingual columns by their text in one language."""
    return df.withColumns({c: language_text(df, c, lang, missing) for c in columns})


def unpivot_languages(
    df: DataFrame,
    languages: Sequence[str] | None = None,
    missing: str | None = None,
    premise: str = "premise",
    hypothesis: str = "hypothesis",
    lang: str = "lang",
) -> DataFrame:
    """One row per example and language, in one pass over the table.

    With ``missing`` unset, a row comes out for each language its premise map has (restricted to
    ``languages`` when given). With a policy, every row yields every language of ``languages``.
    """
    if missing is not None:
        if languages is None:
            raise ValueError("a missing-language policy needs the list of languages")
        rows = df.withColumn(lang, F.explode(F.array(*[F.lit(x) for x in languages])))
        return select_language(rows, F.col(lang), missing, (premise, hypothesis))
    texts = as_language_map(df, premise)
    if texts is None:
        raise TypeError(f"{premise} holds one language already")
    others = [c for c in df.columns if c != premise]
    rows = df.select(*others, F.explode(texts).alias(lang, premise))
    if languages is not None:
        rows = rows.where(F.col(lang).isin(list(languages)))
    rows = rows.withColumn(premise, F.coalesce(premise, F.lit("")))
    return rows.withColumn(hypothesis, language_text(rows, hypothesis, F.col(lang), "empty"))


def select_rows(df: DataFrame, split: str | None = None, languages: Sequence[str] | None = None) -> DataFrame:
    """Rows of a split and languages; on a partitioned table both turn into partition filters."""
    if split is not None:
        df = df.where(F.col("split") == split)
    if languages is not None:
        df = df.where(F.col("lang").isin(list(languages)))
    return df


def train_eval_frames(
    df: DataFrame,
    source_lang: str = "en",
    eval_langs: Sequence[str] | None = None,
    train_split: str = "train",
    eval_split: str = "validation",
) -> tuple[DataFrame, DataFrame]:
    """Training rows (source language only) and evaluation rows (all languages, one frame)."""
    return (
        select_rows(df, train_split, [source_lang]),
        select_rows(df, eval_split, eval_langs),
    )


def nonempty_pairs(df: DataFrame, premise: str = "premise", hypothesis: str = "hypothesis") -> DataFrame:
    """Drop pairs with a null or empty side; a side of white space stays."""
    return df.where(has_text(premise) & has_text(hypothesis))


def validate_pairs(
    df: DataFrame,
    premise: str = "premise",
    hypothesis: str | None = "hypothesis",
    status: str = "status",
) -> DataFrame:
    """Strip both texts and add a status; rows are kept. A blank premise is reported before a blank hypothesis."""
    state = F.when(is_blank(premise), "missing_premise")
    stripped = {premise: strip_text(premise)}
    if hypothesis is not None:
        state = state.when(is_blank(hypothesis), "missing_hypothesis")
        stripped[hypothesis] = strip_text(hypothesis)
    return df.withColumns({status: state.otherwise("ok"), **stripped})


def status_message(status: str = "status") -> Column:
    """The text shown to a person for a status."""
    return (
        F.when(F.col(status) == "missing_premise", "Please enter a premise.")
        .when(F.col(status) == "missing_hypothesis", "Please enter a hypothesis.")
        .when(F.col(status) == "error", "Error during prediction.")
    )


def align_languages(
    df: DataFrame, languages: Sequence[str], key: str = "id", text: str = "sentence1", lang: str = "lang"
) -> DataFrame:
    """The same example side by side in each language, one column per language."""
    return (
        df.where(F.col(lang).isin(list(languages)))
        .groupBy(key)
        .pivot(lang, list(languages))
        .agg(F.first(text, ignorenulls=True))
    )


def pairs_from_turns(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    first_role: str = "user",
    second_role: str = "assistant",
) -> DataFrame:
    """A turn and the answer in the turn right after it, as premise and hypothesis.

    An equi-join on (conversation, turn) instead of a window per conversation: one very long
    conversation then spreads over all tasks.
    """
    asked = df.where(F.col(role) == first_role).select(conversation, turn, F.col(text).alias("premise"))
    answered = df.where(F.col(role) == second_role).select(
        conversation, (F.col(turn) - 1).alias(turn), F.col(text).alias("hypothesis")
    )
    return asked.join(answered, [conversation, turn])
