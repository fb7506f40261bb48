"""The slot for a forecaster: f(target, ...) -> quantiles by step, called on Arrow batches of context windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.operators.score import Z

Forecaster = Callable[[list[np.ndarray], int], np.ndarray]


def gaussian(targets: list[np.ndarray], horizon: int) -> np.ndarray:
    """Windows x steps x levels of a zero-mean normal with each window's standard deviation."""
    sigma = np.array([np.nanstd(t, ddof=1) if np.isfinite(t).sum() > 1 else np.nan for t in targets])
    return np.repeat((sigma[:, None] * np.array(Z))[:, None, :], horizon, axis=1)


def forecast(windows: DataFrame, keys: list[str], context: str, horizon: int, make: Callable[[], Forecaster] = lambda: gaussian) -> DataFrame:
    """keys, horizon, q for each window. `make` runs once a task, so that a model is loaded once."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.select(*keys).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            q = model([np.array(t, float) for t in batch[context]], horizon)
            for h in range(horizon):
                out = batch[keys].copy()
                out["horizon"] = h + 1
                out["q"] = list(q[:, h, :])
                yield out

    return windows.select(*keys, context).mapInPandas(run, f"{schema}, horizon int, q array<double>")

