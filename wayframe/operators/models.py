"""Forward passes of trained weights over rows in Arrow batches, and averages over repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mlp(rows: DataFrame, vector: str, layers: list[tuple[np.ndarray, np.ndarray]], out: str = "output") -> DataFrame:
    """rows with the output of a ReLU network of (weights, bias) layers; the weights go to the tasks once, as they are small."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b[vector].tolist(), dtype=np.float64).reshape(len(b), -1)
            for k, (w, bias) in enumerate(layers):
                x = x @ w + bias if len(b) else np.zeros((0, w.shape[1]))
                if k < len(layers) - 1:
                    x = np.maximum(x, 0)
            yield b.assign(**{out: list(x)})

    schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)
    return rows.mapInPandas(run, f"{schema}, `{out}` array<double>")


def repeat_average(rows: DataFrame, sample: str, metric: str) -> DataFrame:
    """(mean, samples): the mean over a sample's repeats, then over samples, so a sample counts once however often it ran."""
    each = rows.groupBy(sample).agg(F.avg(metric).alias("m"))
    return each.agg(F.avg("m").alias("mean"), F.count("m").alias("samples"))
