"""The acquisition sweep: every condition of every recording in one keyed plan.

Samples are read twice: once for the window statistics that choose the windows, once to gather the
chosen windows, one row each. Montage, band, rate and depth are then applied to a batch of windows
in a single Arrow pass that returns spectra keyed by condition; features, channel means and window
medians are expressions and aggregates again.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import dims
from tidemark.operators import degrade as dg
from tidemark.operators import spectral as sp
from tidemark.operators import windows as wn
from tidemark.session import stored

DIGITISED = ("b19", "b4")
CHUNK_SAMPLES = 4_000_000  # samples worked on at once inside a task
SPECTRA = ("cond string, bip boolean, rate int, rec string, win bigint, channel string, "
           "p array<double>, v0 double, v1 double, v2 double")


def by_recording(windows: DataFrame, step: Callable, schema: str) -> DataFrame:
    """``mapInPandas`` in which recordings travel as strings: an unknown one would turn integers into floats."""
    kind = dict(windows.dtypes)["rec"]
    return windows.withColumn("rec", F.col("rec").cast("string")).mapInPandas(step, schema).withColumn("rec", F.col("rec").cast(kind))


def kept_windows(samples: DataFrame, length: int, limit: float, quota: int) -> DataFrame:
    """Windows measured under every condition: chosen once, on the full recording."""
    return wn.sampled(wn.accepted(wn.window_ptp(samples, length), limit, quota), quota)


def conditions(rate: int, rates: Sequence[int], depths: Sequence, raw: bool = False) -> list[tuple]:
    """(montage, preproc, rate, bits): all montages at native settings, two over the digitisation
    grid and the band restriction, and, where there is a raw input, the same two on it."""
    out = [(m, "full", rate, None) for m in dims.MONTAGES]
    out += [(m, "full", r, b) for m in DIGITISED for r in rates for b in depths
            if not (r == rate and b is None)]
    return out + [(m, p, rate, None) for p in ("emgfree", *(["noica"] if raw else [])) for m in DIGITISED]


def mixing(names: Sequence[str], montage: str, lost: str | None = None) -> tuple[np.ndarray, list[str]] | None:
    """Signals of a montage as a signed mixing matrix (signals × channels) with their names; None when a site is missing.

    Without its ``lost`` site the montage is referenced to the sites that are left.
    """
    sites, ref, pairs, _ = dims.MONTAGES[montage]
    sites = [s for s in sites if s != lost]
    place = {c: i for i, c in enumerate(names)}
    if any(s not in place for s in sites):
        return None
    unit = np.eye(len(names))
    if ref == "bipolar":
        return np.stack([unit[place[p]] - unit[place[q]] for p, q in pairs]), ["-".join(p) for p in pairs]
    own = unit[[place[s] for s in sites]]
    return own - (own.mean(axis=0) if ref == "subset_car" else 0), list(sites)


def spectrum_rows(cond: str, montage: str, rate: int, rec: np.ndarray, win: np.ndarray, channel: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    """Spectrum and the three variances of each row of ``y`` in the columns of ``SPECTRA``."""
    d1 = np.diff(y, axis=1)
    return pd.DataFrame({
        "cond": cond, "bip": dims.MONTAGES[montage][1] == "bipolar", "rate": rate, "rec": rec, "win": win, "channel": channel,
        "p": list(sp.welch_rows(y, rate)), "v0": y.var(axis=1), "v1": d1.var(axis=1), "v2": np.diff(d1, axis=1).var(axis=1)})


def recording_cube(spectra: DataFrame, length: int, rate: int, rates: Sequence[int], hot: bool | None = None) -> DataFrame:
    """(cond, rec, n_windows, 17 features): window means of the channels and their medians over the windows of a recording."""
    grids = sp.Grids([sp.Grid(length // (rate // r), r) for r in rates], "rate")
    per = sp.channel_features(spectra, grids)
    win = sp.window_features(per, ["cond", "bip", "rec", "win"], F.col("bip"))
    # A recording keeps at most its quota of windows, so its medians are bounded.
    return sp.recording_features(win, ["cond", "rec"], hot=False if hot is None else hot)


def condition_spectra(windows: DataFrame, conds: list[tuple], rate: int, full_scale: float) -> DataFrame:
    """Spectra of every condition of a batch of windows (rec, win, channels, xs)."""
    order = sorted(conds, key=lambda c: (c[0], c[1], c[2]))

    def spectra_of(g: pd.DataFrame, names: list[str]) -> Iterator[pd.DataFrame]:
        x = np.stack(g["xs"].to_list()).reshape(len(g), len(names), -1)
        for (montage, pre), same in groupby(order, key=lambda c: c[:2]):
            mixed = mixing(names, montage)
            if mixed is None:
                continue
            matrix, signals = mixed
            flat = np.einsum("sc,wct->wst", matrix, x).reshape(-1, x.shape[2])
            if dims.PREPROC_BAND[pre] is not None:
                flat = dg.restrict_rows(flat, rate, *dims.PREPROC_BAND[pre])
            rec, win = (np.repeat(g[c].to_numpy(), len(signals)) for c in ("rec", "win"))
            for _, _, r, bits in same:
                y = dg.converted_rows(dg.decimate_rows(flat, rate // r), bits, full_scale)
                yield spectrum_rows(f"{montage}|{r}|{'f32' if bits is None else bits}|{pre}", montage, r, rec, win,
                                    np.tile(signals, len(g)), y)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for names, g in pdf.groupby(pdf["channels"].map(tuple), sort=False):
                size = max(1, CHUNK_SAMPLES // len(g["xs"].iloc[0]))
                for start in range(0, len(g), size):
                    yield from spectra_of(g.iloc[start:start + size], list(names))

    return by_recording(windows, step, SPECTRA)


def pinned_matrices(raw: DataFrame, offsets: DataFrame, kept: DataFrame, length: int) -> DataFrame:
    """The kept windows cut from another recording of the same session, which starts ``offset`` samples earlier.

    Windows that run past its end are dropped.
    """
    placed = raw.join(offsets, "rec").withColumn("t", F.col("t") - F.col("offset")).filter("t >= 0").drop("offset")
    return wn.matrices(placed, kept, length).filter(F.size("xs") == F.size("channels") * length)


def swept(samples: DataFrame, length: int, rate: int, limit: float, quota: int, rates: Sequence[int],
          depths: Sequence, full_scale: float, hot: bool | None = None, raw: DataFrame | None = None,
          offsets: DataFrame | None = None) -> DataFrame:
    """(cond, rec, n_windows, 17 features) over montage × digitisation × band restriction.

    ``raw`` and ``offsets`` (rec, offset) add the arm on the recordings before artefact removal, on the same windows.
    """
    for r in rates:
        dg.decimation_factor(rate, r)
    kept = kept_windows(samples, length, limit, quota)
    kept = kept if raw is None else stored(kept, "kept")
    every = conditions(rate, rates, depths, raw is not None)
    spectra = condition_spectra(wn.matrices(samples, kept, length), [c for c in every if c[1] != "noica"], rate, full_scale)
    if raw is not None:
        spectra = spectra.unionByName(condition_spectra(
            pinned_matrices(raw, offsets, kept, length), [c for c in every if c[1] == "noica"], rate, full_scale))
    return recording_cube(spectra, length, rate, rates, hot)


def sweep_report(cube_wide: DataFrame) -> DataFrame:
    """Per condition: recordings, usable features and the median number of windows."""
    usable = sum(F.when(F.count(n) == F.count("*"), 1).otherwise(0) for n in dims.FEATURES)
    return cube_wide.groupBy("cond").agg(F.count("*").alias("n_recordings"), usable.alias("n_usable"),
                                         F.percentile("n_windows", F.lit(0.5)).alias("median_windows"))
