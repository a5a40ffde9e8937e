"""Digitisation and band budgets: quantise, decimate, restrict, in the order a device would."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.dims import FULL_SCALE


def quantised(x: Column, bits: Column | int, full_scale: float = FULL_SCALE) -> Column:
    """Round half to even on the converter's grid and clip to its range; null bits = untouched."""
    b = bits if isinstance(bits, Column) else F.lit(bits)
    lsb = full_scale / F.pow(F.lit(2.0), b)
    half = full_scale / 2
    return F.when(b.isNull(), x).otherwise(
        F.greatest(F.least(F.rint(x / lsb) * lsb, F.lit(half)), F.lit(-half)))


def converted_rows(x: np.ndarray, bits: int | None, full_scale: float = FULL_SCALE) -> np.ndarray:
    """What a converter of ``bits`` bits returns: the nearest code, saturating at half the codes either way; None = no converter."""
    if bits is None:
        return x
    codes = np.rint(x * (2 ** bits / full_scale))
    top = 2 ** (bits - 1)
    return np.minimum(np.maximum(codes, -top), top) * (full_scale / 2 ** bits)


def decimation_taps(k: int) -> np.ndarray:
    """Anti-alias filter for factor k: Kaiser-windowed sinc (beta 5), 10·k taps a side, unit gain."""
    n = np.arange(-10 * k, 10 * k + 1)
    h = np.sinc(n / k) * np.kaiser(len(n), 5.0)
    return h / h.sum()


def decimation_factor(rate_in: int, rate_out: int) -> int:
    if rate_in % rate_out:
        raise ValueError(f"{rate_in} Hz is not an integer multiple of {rate_out} Hz")
    return rate_in // rate_out


def decimate_rows(x: np.ndarray, k: int) -> np.ndarray:
    """Filter rows of a (rows, samples) array and keep every k-th sample; zeros beyond the ends."""
    if k == 1:
        return x
    h = decimation_taps(k)
    half = len(h) // 2
    n_out = -(-x.shape[1] // k)
    padded = np.pad(x, ((0, 0), (half, half)))
    spans = np.lib.stride_tricks.sliding_window_view(padded, len(h), axis=1)[:, ::k]
    return spans[:, :n_out] @ h[::-1]


def band_gain(f: np.ndarray, rate: float, lo: float, hi: float) -> np.ndarray:
    """Squared magnitude of a fourth-order Butterworth band-pass (bilinear), which is what running
    it forwards and backwards applies; zero at 0 Hz and at Nyquist."""
    w, a, b = (np.tan(np.pi * np.asarray(v, float) / rate) for v in (f, lo, min(hi, 0.99 * rate / 2)))
    inside = (f > 0) & (f < rate / 2)
    w = np.where(inside, w, 1.0)
    return np.where(inside, 1.0 / (1.0 + ((w * w - a * b) / (w * (b - a))) ** 8), 0.0)


def restrict_rows(x: np.ndarray, rate: float, lo: float, hi: float) -> np.ndarray:
    """Zero-phase band restriction of each row, applied to its spectrum."""
    f = np.fft.rfftfreq(x.shape[1], 1.0 / rate)
    return np.fft.irfft(np.fft.rfft(x, axis=1) * band_gain(f, rate, lo, hi), n=x.shape[1], axis=1)


def _by_length(arrays: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row positions and stacked values of equal-length arrays of a batch."""
    lengths = arrays.map(len).to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, np.stack(arrays.iloc[at].to_list())


def decimated(windows: DataFrame, rate_in: int, rate_out: int, x: str = "x") -> DataFrame:
    """Window arrays at the lower rate; an Arrow batch job without a shuffle."""
    k = decimation_factor(rate_in, rate_out)
    if k == 1:
        return windows

    @F.pandas_udf("array<double>")
    def step(col: pd.Series) -> pd.Series:
        out: list = [None] * len(col)
        for at, block in _by_length(col):
            for i, row in zip(at, decimate_rows(block, k)):
                out[i] = row
        return pd.Series(out)

    return windows.withColumn(x, step(F.col(x)))


def restricted(windows: DataFrame, rate: float, lo: float, hi: float, x: str = "x") -> DataFrame:
    @F.pandas_udf("array<double>")
    def step(col: pd.Series) -> pd.Series:
        out: list = [None] * len(col)
        for at, block in _by_length(col):
            for i, row in zip(at, restrict_rows(block, rate, lo, hi)):
                out[i] = row
        return pd.Series(out)

    return windows.withColumn(x, step(F.col(x)))


def with_budget(windows: DataFrame, rate_in: int, rates: list[int], bits: DataFrame,
                full_scale: float = FULL_SCALE, band: tuple | None = None) -> DataFrame:
    """band → rate → bits for a grid: adds ``rate`` and ``bits``, one row per combination.

    One Arrow pass returns every rate of a window; the depths fan out afterwards as an expression.
    """
    factors = [decimation_factor(rate_in, rate) for rate in rates]

    @F.pandas_udf("array<array<double>>")
    def step(col: pd.Series) -> pd.Series:
        out: list = [None] * len(col)
        for at, block in _by_length(col):
            rows = block if band is None else restrict_rows(block, rate_in, *band)
            per = [decimate_rows(rows, k) for k in factors]
            for i, j in enumerate(at):
                out[j] = [p[i] for p in per]
        return pd.Series(out)

    every = F.explode(F.arrays_zip(F.array(*[F.lit(r) for r in rates]).alias("rate"), step(F.col("x")).alias("x")))
    rest = [c for c in windows.columns if c != "x"]
    fan = windows.withColumn("__e", every).select(*rest, F.col("__e.x").alias("x"), F.col("__e.rate").alias("rate")).crossJoin(F.broadcast(bits))
    return fan.withColumn("x", F.transform("x", lambda v: quantised(v, F.col("bits"), full_scale)))
