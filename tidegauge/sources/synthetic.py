"""Seeded tables without a file: a Python data source of candles and of autoregressions, made in parallel by series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def candles(n: int = 600, seed: int = 0, start: float = 50_000.0) -> np.ndarray:
    """(n, 6): time in milliseconds by hours, open, high, low, close and volume; volatility comes in clusters."""
    rng = np.random.default_rng(seed)
    vol, last, steps = 0.01, 0.0, np.zeros(n)
    for t in range(1, n):
        vol = 0.92 * vol + 0.08 * (0.008 + 0.6 * abs(last))
        steps[t] = last = rng.normal(0, vol)
    close = start * np.exp(np.cumsum(steps))
    opened = np.r_[close[0], close[:-1]]
    spread = 1 + np.abs(rng.normal(0, 0.002, (2, n)))
    high, low = np.maximum(opened, close) * spread[0], np.minimum(opened, close) / spread[1]
    return np.column_stack([1.7e12 + 3.6e6 * np.arange(n), opened, high, low, close, 1 + np.abs(rng.normal(100, 30, n))])


def autoregressions(n: int = 480, columns: int = 3, seed: int = 0, phi: float = 0.6) -> np.ndarray:
    """(n, columns): each column follows its last value times phi, and noise."""
    e = np.random.default_rng(seed).standard_normal((n, columns))
    x = np.zeros((n, columns))
    for t in range(1, n):
        x[t] = phi * x[t - 1] + e[t]
    return x


class _Part(InputPartition):
    def __init__(self, value: int):
        self.value = value


class SyntheticSource(DataSource):
    """Options: kind (candles or autoregressions), series, rows, seed, columns. A partition a series."""

    @classmethod
    def name(cls) -> str:
        return "tidegauge_synthetic"

    def schema(self) -> str:
        if self.options.get("kind", "candles") == "candles":
            return "series_id bigint, ts double, open double, high double, low double, close double, volume double"
        return "series_id bigint, t bigint, " + ", ".join(f"x{k} double" for k in range(int(self.options.get("columns", 3))))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [_Part(i) for i in range(int(self.options.get("series", 1)))]

    def read(self, part):
        n, seed = int(self.options.get("rows", 600)), int(self.options.get("seed", 0)) + part.value
        if self.options.get("kind", "candles") == "candles":
            for row in candles(n, seed):
                yield (part.value, *map(float, row))
        else:
            for t, row in enumerate(autoregressions(n, int(self.options.get("columns", 3)), seed)):
                yield (part.value, t, *map(float, row))


def synthetic(spark: SparkSession, kind: str = "candles", **options) -> DataFrame:
    spark.dataSource.register(SyntheticSource)
    reader = spark.read.format("tidegauge_synthetic").option("kind", kind)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()
