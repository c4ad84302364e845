"""Fitted reductions and classifiers are row-wise, so the same objects score a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tarnfold.operators.classifiers import MarginModel
from tarnfold.plans.reduction import FittedReduction


def score_stream(stream: DataFrame, fitted: FittedReduction, model: MarginModel, vector: str = "features") -> DataFrame:
    """Angles, decision value and prediction of each arriving row; no state."""
    angles = fitted.to_angles(stream, vector)
    return model.score(angles, "angles")
