"""Encoders of images, sounds and several modalities to sequences of numbers.

An image is a row (source_id, t, width, pixels): one channel row by row, 3 channels by their mean. A clip is a row
(source_id, t, samples). Features are computed where the rows are, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.alignment import as_of

MODALITIES = ("timeseries", "tabular", "text", "image", "audio")


def image_features(a: np.ndarray, bins: int = 8) -> np.ndarray:
    """Mean, deviation, mean step along rows and along columns, and a density of intensities in equal bins."""
    a = np.asarray(a, float)
    a = np.atleast_2d(a.mean(2) if a.ndim == 3 else a)
    low, high = a.min(), a.max() + 1e-9
    count = np.bincount(np.minimum(((a.ravel() - low) / (high - low) * bins).astype(int), bins - 1), minlength=bins)
    steps = [np.abs(np.diff(a, axis=x)).mean() if a.shape[x] > 1 else 0.0 for x in (1, 0)]
    return np.r_[a.mean(), a.std(), steps, count * bins / (a.size * (high - low))]


def audio_features(x: np.ndarray, bands: int = 4) -> np.ndarray:
    """Root mean square, share of sign changes, spectral centroid (cycles a sample), and shares of the spectrum in bands."""
    x = np.asarray(x, float).ravel()
    if x.size < 2:
        return np.zeros(3 + bands)
    s = np.abs(np.fft.rfft(x - x.mean()))
    total = s.sum() + 1e-12
    parts = np.array([p.sum() for p in np.array_split(s, bands)])
    return np.r_[np.sqrt((x * x).mean()), (np.diff(np.sign(x)) != 0).mean(), (np.fft.rfftfreq(x.size) * s).sum() / total, parts / (parts.sum() + 1e-12)]


def _encoded(rows: DataFrame, columns: list[str], features, n: int) -> DataFrame:
    names = [f"x{k}" for k in range(n)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = np.stack([np.nan_to_num(features(*r)) for r in b[columns].itertuples(index=False)])
                yield pd.concat([b[["source_id", "t"]].reset_index(drop=True), pd.DataFrame(v, columns=names)], axis=1)

    return rows.select("source_id", "t", *columns).mapInPandas(run, "source_id string, t double, " + ", ".join(f"{x} double" for x in names))


def encode_images(rows: DataFrame, channels: int = 1, bins: int = 8) -> DataFrame:
    """(source_id, t, x0 ..) of images (source_id, t, width, pixels)."""

    def features(width, pixels):
        a = np.asarray(pixels, float)
        return image_features(a.reshape(-1, int(width), channels) if channels > 1 else a.reshape(-1, int(width)), bins)

    return _encoded(rows.select(F.col("source_id").cast("string"), F.col("t").cast("double"), "width", "pixels"), ["width", "pixels"], features, bins + 4)


def encode_audio(rows: DataFrame, bands: int = 4) -> DataFrame:
    """(source_id, t, x0 ..) of clips (source_id, t, samples)."""
    return _encoded(rows.select(F.col("source_id").cast("string"), F.col("t").cast("double"), "samples"), ["samples"], lambda s: audio_features(s, bands), bands + 3)


def infer_modality(name: str) -> str:
    """The modality that a name holds, else timeseries."""
    return next((m for m in MODALITIES if m in name.lower()), "timeseries")


def fuse(sources: dict[str, DataFrame], step: float = 1.0) -> DataFrame:
    """(t, <source>_x0 ..): encoded sources (t, x0 ..) on one grid, each by its last row at or before the grid's time.

    A single source comes as it is. The grid starts where every source has a row, so nothing is filled in backwards.
    """
    if not sources:
        raise ValueError("no source to fuse")
    columns = {n: [c for c in df.columns if c.startswith("x") and c[1:].isdigit()] for n, df in sources.items()}
    if len(sources) == 1:
        (n, df), = sources.items()
        return df.select(F.col("t").cast("double").alias("t"), *[F.col(c).alias(f"{n}_{c}") for c in columns[n]])
    ends = [df.agg(F.min("t").alias("a"), F.max("t").alias("b")).first() for df in sources.values()]
    start, stop = max(e["a"] for e in ends), max(e["b"] for e in ends)
    when = lambda t: F.timestamp_micros(F.round(t * 1_000_000).cast("long"))
    spark = next(iter(sources.values())).sparkSession
    out = spark.range(int((stop - start) / step) + 1).select((F.lit(float(start)) + F.col("id") * step).alias("t")).withColumn("ts", when(F.col("t")))
    for n, df in sources.items():
        rows = df.select(when(F.col("t").cast("double")).alias("ts"), F.lit(0).cast("long").alias("event_id"), F.struct(*columns[n]).alias("v"))
        held = as_of(out.select("ts"), rows, "v")
        out = out.join(held, "ts").select(*out.columns, *[F.col(f"v.{c}").alias(f"{n}_{c}") for c in columns[n]])
    return out.drop("ts")
