"""Exponential averages of query telemetry as streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators.calibrate import ALPHA, DRIFT, LEAST_SAMPLES


def smoothed(stream: DataFrame, key: str, value: str, order: str, alpha: float = ALPHA) -> DataFrame:
    """(key, samples, ema, drifted) after each micro-batch. State: samples and average of each key.

    Samples of a batch are taken in order; the average is kept across batches.
    """
    kind = dict(stream.dtypes)[key]

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ema = state.get if state.exists else (0, 0.0)
        last = 0.0
        for x in pd.concat(list(parts)).sort_values(order)[value]:
            last, ema, n = float(x), float(x) if n == 0 else alpha * float(x) + (1 - alpha) * ema, n + 1
        state.update((n, ema))
        yield pd.DataFrame({key: [k[0]], "samples": [n], "ema": [ema], "drifted": [n >= LEAST_SAMPLES and abs(last - ema) > DRIFT]})

    return stream.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, samples long, ema double, drifted boolean", "n long, ema double", "update", GroupStateTimeout.NoTimeout)
