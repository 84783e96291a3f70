"""Train on the source language only, evaluate on all languages, with a Spark ML pipeline."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession

from lingospan.operators.evaluation import zero_shot_eval
from lingospan.operators.pairs import train_eval_frames
from lingospan.operators.scoring import score_pipeline
from lingospan.schemas import NLI_LABELS


@dataclass
class TransferResult:
    """A fitted model, its objective after each iteration, and the accuracy per language."""

    model: PipelineModel
    loss_history: list[float]
    scores: DataFrame
    evaluation: DataFrame


def pair_pipeline(num_features: int = 1 << 14, max_iter: int = 20, reg_param: float = 1e-3) -> Pipeline:
    """Hashed words of both texts, their overlap, and multinomial logistic regression on ``label``.

    Features and classifier are one pipeline, so one directory holds all that scoring needs.
    """
    stages = []
    for side in ("premise", "hypothesis"):
        stages.append(
            RegexTokenizer(
                inputCol=side, outputCol=f"_{side}_words", pattern=r"[\p{L}\p{M}\p{N}]+", gaps=False, toLowercase=False
            )
        )
        stages.append(
            HashingTF(inputCol=f"_{side}_words", outputCol=f"_{side}_tf", numFeatures=num_features, binary=True)
        )
    overlap = SQLTransformer(
        statement=(
            "SELECT *, ln(1 + size(_premise_words)) AS _len_a, ln(1 + size(_hypothesis_words)) AS _len_b, "
            "coalesce(try_divide(size(array_intersect(_premise_words, _hypothesis_words)), "
            "size(array_distinct(_hypothesis_words))), 0D) AS _overlap FROM __THIS__"
        )
    )
    assembler = VectorAssembler(
        inputCols=["_premise_tf", "_hypothesis_tf", "_len_a", "_len_b", "_overlap"], outputCol="features"
    )
    classifier = LogisticRegression(family="multinomial", maxIter=max_iter, regParam=reg_param)
    return Pipeline(stages=[*stages, overlap, assembler, classifier])


def fit_pairs(train: DataFrame, **settings) -> PipelineModel:
    """Fit the pair pipeline. Features are computed once: the classifier passes over them several times."""
    *stages, classifier = pair_pipeline(**settings).getStages()
    encoder = PipelineModel(stages)
    features = encoder.transform(train.select("premise", "hypothesis", "label")).select("features", "label")
    features = features.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return PipelineModel([*stages, classifier.fit(features)])
    finally:
        features.unpersist()


def train_and_evaluate(
    pairs: DataFrame,
    languages: Sequence[str],
    source_lang: str = "en",
    train_split: str = "train",
    eval_split: str = "validation",
    names: Sequence[str] = NLI_LABELS,
    **settings,
) -> TransferResult:
    """Fit on the training rows of the source language; score the evaluation rows of every language."""
    train, test = train_eval_frames(pairs, source_lang, languages, train_split, eval_split)
    model = fit_pairs(train, **settings)
    scored = score_pipeline(test, model, names).withColumnRenamed("label", "gold_label")
    history = list(model.stages[-1].summary.objectiveHistory)
    return TransferResult(model, history, scored, zero_shot_eval(scored, languages, source_lang))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_first_model(spark: SparkSession, paths: Sequence[str]) -> PipelineModel:
    """The first of the given directories that exists, e.g. a tuned model before a baseline."""
    from lingospan.sources.readers import first_existing

    return load_model(first_existing(spark, paths))
