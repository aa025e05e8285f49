"""Spectral measures of short signals, in Arrow batches: there is no FFT among the builtins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def frames_of(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Frames each ``hop``, and one that ends with the signal; a short signal is filled up with zeros."""
    if len(x) < size:
        x = np.pad(x, (0, size - len(x)))
    starts = list(range(0, len(x) - size + 1, hop))
    if starts[-1] != len(x) - size:
        starts.append(len(x) - size)
    return np.stack([x[s : s + size] for s in starts])


def measures(x: np.ndarray, size: int, hop: int, bands: int = 8) -> tuple[float, float, float]:
    """Largest flux between neighbours' normalised spectra, median variance of the log band energies, and largest level above the median."""
    f = frames_of(np.asarray(x, np.float64), size, hop)
    power = np.abs(np.fft.rfft(f * np.hanning(size), axis=1)) ** 2
    shape = power / np.maximum(power.sum(axis=1, keepdims=True), 1e-30)
    flux = float(np.abs(np.diff(shape, axis=0)).sum(axis=1).max() / 2) if len(f) > 1 else 0.0
    edges = np.unique(np.round(np.geomspace(1, power.shape[1], bands + 1)).astype(int))
    energy = np.stack([power[:, a:b].sum(axis=1) for a, b in zip(edges, edges[1:])], axis=1)
    variance = float(np.median(np.var(10 * np.log10(np.maximum(energy, 1e-12)), axis=0)))
    level = 20 * np.log10(np.maximum(np.sqrt((f**2).mean(axis=1)), 1e-12))
    return flux, variance, float(level.max() - np.median(level))


def spectral_udf(size: int, hop: int):
    @F.pandas_udf("struct<flux: double, band_variance: double, burst_db: double>")
    def run(samples: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measures(x, size, hop) for x in samples], columns=["flux", "band_variance", "burst_db"])

    return run
