"""Class-weighted tree classifiers, and scoring with them and with outside models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadsieve.operators import boosting, forest

PROB = "prob_pred"


def weigh_positives(df: DataFrame, target: str = "target", name: str = "weight") -> DataFrame:
    """Positives weigh n_negative / n_positive, negatives 1."""
    scale = df.select(
        (F.count_if(F.col(target) == 0) / F.nullif(F.count_if(F.col(target) == 1), F.lit(0))).alias("s")
    ).scalar()
    return df.withColumn(name, F.when(F.col(target) == 1, F.coalesce(scale, F.lit(1.0))).otherwise(1.0))


def train_gbt(
    df: DataFrame, features: str = "features", target: str = "target", validation: str | None = None,
    options: boosting.Options | str | None = None, folder: str | None = None, pause: int | None = None, **changed,
) -> Model:
    """Boosted trees with balanced weights, by ``boosting.boosted``.

    With a boolean ``validation`` column training ends ``patience`` rounds after the best measure on those rows, and the rounds after
    it are left out. ``options`` are values or a preset's name (``auc``, ``average_precision``, ``logloss``), ``changed`` replaces single
    ones. ``folder`` keeps what a training needs to go on, ``pause`` ends a call after that many rounds.
    """
    held = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    scale = df.where(~held).select(
        (F.count_if(F.col(target) == 0) / F.nullif(F.count_if(F.col(target) == 1), F.lit(0))).alias("s")).first()[0]
    weighed = df.withColumn("weight", F.when(F.col(target) == 1, F.lit(float(scale or 1.0))).otherwise(1.0))
    return boosting.boosted(weighed, features, target, "weight", validation, options or boosting.Options(), folder, pause, **changed)


def train_rf_cv(
    df: DataFrame, features: str = "features", target: str = "target",
    trees: tuple[int, ...] = forest.COUNTS, depths: tuple[int, ...] = forest.DEPTHS, folds: int = 5, seed: int = 101,
) -> Model:
    """Balanced random forest chosen by average precision over a grid of tree counts and depths, grown on all rows."""
    return forest.balanced_forest(df, features, target, trees, depths, folds, seed)[0]


def score(model: Model, df: DataFrame, name: str = PROB) -> DataFrame:
    """Probability of class 1 next to the given columns."""
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(name))


def score_in_batches(
    df: DataFrame, factory: Callable[[], Callable[[list[str]], np.ndarray]], text: str, keys: list[str],
    batch_size: int = 128, name: str = PROB,
) -> DataFrame:
    """Score texts with an outside model, in mini-batches, keys carried along.

    ``factory`` runs once per task and returns a function from texts to logits
    (n x 2) or probabilities (n). Texts are ordered by length inside an Arrow
    batch, so a mini-batch holds texts of similar length and needs little
    padding.
    """
    schema = df.select(*keys).schema.add(name, "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in batches:
            texts = pdf[text].fillna("")
            order = np.argsort(texts.str.len().to_numpy(), kind="stable")
            prob = np.zeros(len(pdf))
            for at in range(0, len(order), batch_size):
                rows = order[at:at + batch_size]
                out = np.asarray(model(texts.iloc[rows].tolist()), dtype=float)
                prob[rows] = out if out.ndim == 1 else 1.0 / (1.0 + np.exp(out[:, 0] - out[:, 1]))
            yield pdf[keys].assign(**{name: prob})

    return df.select(*keys, text).mapInPandas(run, schema)
