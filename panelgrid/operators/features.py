"""Random Fourier features as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelgrid.config import GAMMA
from panelgrid.operators.blocks import TimeAxis, over_time
from panelgrid.operators.kernel import SCALE_FLOOR, draw_weights
from panelgrid.operators.windows import strictly_prior


def rff_weights(spark: SparkSession, seeds: Sequence[int], n_pairs: int, n_predictors: int) -> DataFrame:
    """The weight table ``(seed, pair, predictor, weight)``, drawn where it is needed.

    Each seed is one row of the input and one draw; nothing is drawn on the driver.
    """
    ids = spark.createDataFrame([(int(s),) for s in dict.fromkeys(seeds)], "seed long")

    def draw(batches):
        for batch in batches:
            for seed in batch["seed"]:
                w = draw_weights(n_pairs, n_predictors, int(seed))
                yield pd.DataFrame(
                    {
                        "seed": int(seed),
                        "pair": [i for i in range(n_pairs) for _ in range(n_predictors)],
                        "predictor": list(range(n_predictors)) * n_pairs,
                        "weight": w.reshape(-1),
                    }
                )

    return ids.mapInPandas(draw, "seed long, pair int, predictor int, weight double")


def projection(columns: Sequence[str], weights: Sequence[float], gamma: float = GAMMA) -> Column:
    """gamma times the weighted sum of the predictors, left to code generation."""
    terms = [F.lit(float(w)) * F.lit(float(gamma)) * F.col(c) for w, c in zip(weights, columns, strict=True)]
    out = terms[0]
    for term in terms[1:]:
        out = out + term
    return out


def feature_columns(columns: Sequence[str], seed: int, p: int, gamma: float = GAMMA, prefix: str = "s") -> dict:
    """Native expressions ``s1..sP`` (sin, cos, sin, cos, ...): a few columns; ``rff_features`` gives any number as an array."""
    if p < 2 or p % 2:
        raise ValueError(f"features come in pairs; {p} of them cannot be made")
    out = {}
    for i, w in enumerate(draw_weights(p // 2, len(columns), seed)):
        angle = projection(columns, w, gamma)
        out[f"{prefix}{2 * i + 1}"] = F.sin(angle)
        out[f"{prefix}{2 * i + 2}"] = F.cos(angle)
    return out


def rff_features(panel: DataFrame, x: str, seed: int, p: int, gamma: float = GAMMA, name: str = "features") -> DataFrame:
    """Append the feature array of any even complexity, computed per Arrow batch."""
    import numpy as np

    from panelgrid.operators.kernel import fourier_features

    if p < 2 or p % 2:
        raise ValueError(f"features come in pairs; {p} of them cannot be made")

    @F.pandas_udf("array<double>")
    def expand(values: pd.Series) -> pd.Series:
        if values.empty:
            return pd.Series([], dtype=object)
        rows = np.stack(values.to_numpy())
        return pd.Series(list(fourier_features(rows, draw_weights(p // 2, rows.shape[1], seed), gamma)))

    return panel.withColumn(name, expand(x))


def scale_by_training_window(
    panel: DataFrame,
    features: Sequence[str],
    axis: TimeAxis = TimeAxis(),
    window: int = 12,
    uncentered: bool = False,
    prefix: str = "scale_",
) -> DataFrame:
    """Divide each feature by its volatility over the ``window`` rows before.

    Rows without a full training window are dropped. A flat feature keeps its level.
    The divisor is kept under ``prefix``.
    """
    if window < 2 and not uncentered:
        raise ValueError("one training row has no spread to scale by")

    def scale(c: str):
        def column(w):
            frame = strictly_prior(w, window)
            spread = F.sqrt(F.avg(F.col(c) * F.col(c)).over(frame)) if uncentered else F.stddev_samp(c).over(frame)
            return F.when(
                F.count(c).over(frame) == window,
                F.when(spread > SCALE_FLOOR, spread).otherwise(F.lit(1.0)),
            )

        return column

    scaled = over_time(panel, axis, {f"{prefix}{c}": scale(c) for c in features}, lookback=window)
    scaled = scaled.where(F.col(f"{prefix}{features[0]}").isNotNull())
    return scaled.withColumns({c: F.col(c) / F.col(f"{prefix}{c}") for c in features})
