"""Spectral and time-domain features of window arrays.

The power spectrum is the one step that leaves the JVM: an Arrow batch job without a shuffle that
turns each window array into its Welch spectrum (and the three variances the Hjorth measures
need). Every feature is then an expression over the small spectrum array.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import dims
from tidemark.functions.scalars import ratio
from tidemark.operators.degrade import _by_length
from tidemark.operators.ordered import group_is_hot, quantiles

SPECTRUM = "struct<p:array<double>,v0:double,v1:double,v2:double>"


def segment_length(n_samples: int, rate: float) -> int:
    return int(min(n_samples, 2 * rate))


def welch_rows(x: np.ndarray, rate: float) -> np.ndarray:
    """Welch density of each row: Hann, half overlap, mean removed per segment, one-sided."""
    n = segment_length(x.shape[1], rate)
    hop = n - n // 2
    seg = np.lib.stride_tricks.sliding_window_view(x, n, axis=1)[:, ::hop]
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    spec = np.fft.rfft((seg - seg.mean(axis=2, keepdims=True)) * win, axis=2)
    p = (spec.real ** 2 + spec.imag ** 2) / (rate * (win ** 2).sum())
    p[..., 1:(-1 if n % 2 == 0 else None)] *= 2
    return p.mean(axis=1)


def spectra(windows: DataFrame, rate: float, x: str = "x") -> DataFrame:
    """Add p (spectrum) and v0, v1, v2 (variances of x and its differences); drops x."""

    @F.pandas_udf(SPECTRUM)
    def step(col: pd.Series) -> pd.DataFrame:
        n = len(col)
        out = {"p": [None] * n, "v0": np.empty(n), "v1": np.empty(n), "v2": np.empty(n)}
        for at, block in _by_length(col):
            rows = welch_rows(block, rate)
            for i, row in zip(at, rows):
                out["p"][i] = row
            d1 = np.diff(block, axis=1)
            out["v0"][at], out["v1"][at] = block.var(axis=1), d1.var(axis=1)
            out["v2"][at] = np.diff(d1, axis=1).var(axis=1)
        return pd.DataFrame(out)

    return windows.withColumn("__s", step(F.col(x))).select(
        *[c for c in windows.columns if c != x], "__s.p", "__s.v0", "__s.v1", "__s.v2")


class Grid:
    """Frequency grid of a spectrum: which bins an interval selects is known before the job runs."""

    def __init__(self, n_samples: int, rate: float):
        self.n, self.rate = segment_length(n_samples, rate), rate
        self.f = np.fft.rfftfreq(self.n, 1.0 / rate)
        self.df, self.nyquist = rate / self.n, rate / 2

    def bins(self, lo: float, hi: float, closed: bool = False) -> tuple[int, int]:
        """(first bin, count) of lo <= f < hi, or <= hi when closed."""
        at = np.flatnonzero((self.f >= lo) & ((self.f <= hi) if closed else (self.f < hi)))
        return (int(at[0]), len(at)) if len(at) else (0, 0)


class Grids:
    """One grid per sampling rate; a constant of a grid becomes an expression over the rate column."""

    def __init__(self, grids: Sequence[Grid], rate: str | None = None):
        self.grids, self.rate = list(grids), rate
        if len(self.grids) > 1 and rate is None:
            raise ValueError("several grids need a rate column")

    def pick(self, fn: Callable) -> Column:
        """``fn(grid)`` as a column; None stays null."""
        if len(self.grids) == 1:
            return self._lit(fn(self.grids[0]))
        out = None
        for g in self.grids:
            cond = F.col(self.rate) == g.rate
            v = self._lit(fn(g))
            out = F.when(cond, v) if out is None else out.when(cond, v)
        return out

    @staticmethod
    def _lit(v) -> Column:
        if isinstance(v, (list, np.ndarray)):
            return F.array(*[F.lit(float(x)) for x in v])
        return F.lit(v)

    def df(self) -> Column:
        return self.pick(lambda g: float(g.df))

    def part(self, p: Column, lo: float, hi: float, closed: bool = False, min_bins: int = 1) -> Column:
        """The bins of an interval; null on a grid with fewer than ``min_bins`` of them."""
        count = self.pick(lambda g: g.bins(lo, hi, closed)[1])
        first = self.pick(lambda g: g.bins(lo, hi, closed)[0] + 1)
        return F.when(count >= min_bins, F.slice(p, first, count))


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, v: a + v)


def band_power(p: Column, g: Grids, lo: float, hi: float) -> Column:
    """Trapezoid over [lo, hi); null above Nyquist or with fewer than two bins."""
    fits = g.pick(lambda x: bool(hi <= x.nyquist and x.bins(lo, hi)[1] >= 2))
    first = g.pick(lambda x: x.bins(lo, hi)[0] + 1)
    last = g.pick(lambda x: max(sum(x.bins(lo, hi)), 1))
    ends = (F.element_at(p, first) + F.element_at(p, last)) / 2
    return F.when(fits, (total(g.part(p, lo, hi, min_bins=2)) - ends) * g.df())


def with_band_powers(df: DataFrame, g: Grids) -> DataFrame:
    return df.withColumns({f"bp_{b}": band_power(F.col("p"), g, *r) for b, r in dims.BANDS.items()})


def spectral_scan(p: Column) -> Column:
    """One pass over the normalised spectrum: 95 % and 50 % crossing bins and the entropy sum."""
    tot = total(p)
    share = lambda a, v: v / a["t"]
    scan = F.aggregate(
        p, F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("k"), F.lit(-1).alias("e"), F.lit(-1).alias("m"),
                    F.lit(0.0).alias("h"), tot.alias("t")),
        lambda a, v: F.struct(
            (a["c"] + share(a, v)).alias("c"), (a["k"] + 1).alias("k"),
            F.when((a["e"] < 0) & (a["c"] + share(a, v) >= 0.95), a["k"]).otherwise(a["e"]).alias("e"),
            F.when((a["m"] < 0) & (a["c"] + share(a, v) >= 0.50), a["k"]).otherwise(a["m"]).alias("m"),
            (a["h"] + F.when(v > 0, share(a, v) * F.log(share(a, v))).otherwise(0.0)).alias("h"),
            a["t"].alias("t")))
    return F.when(tot > 0, scan)


def aperiodic_weights(g: Grid) -> np.ndarray | None:
    """Fixed regression weights of the log-frequency fit; None with fewer than five bins."""
    lo, hi = dims.APERIODIC_FIT
    first, count = g.bins(lo, hi, closed=True)
    if count < 5:
        return None
    lf = np.log10(g.f[first:first + count])
    c = lf - lf.mean()
    return c / (c ** 2).sum()


def aperiodic_exponent(p: Column, g: Grids) -> Column:
    """Negated slope of log10 power on log10 frequency, as a dot product with fixed weights."""
    logs = F.zip_with(g.part(p, *dims.APERIODIC_FIT, closed=True, min_bins=5), g.pick(aperiodic_weights),
                      lambda v, w: F.log10(F.greatest(v, F.lit(1e-30))) * w)
    return -total(logs)


def channel_features(spectrum: DataFrame, g: Grids) -> DataFrame:
    """Per (window, channel) features and the alpha power; spectrum and variances are dropped."""
    keys = [c for c in spectrum.columns if c not in ("p", "v0", "v1", "v2")]
    p = F.col("p")
    parts = {f"bp_{b}": band_power(p, g, *r) for b, r in dims.BANDS.items()}
    parts |= {"__shape": spectral_scan(p), "__pdr": g.part(p, *dims.PDR_BAND, closed=True, min_bins=3)}
    df = spectrum.withColumns(parts)
    bands = [F.col(f"bp_{b}") for b in dims.BANDS]
    present = [F.coalesce(b, F.lit(0.0)) for b in bands]
    whole = present[0] + present[1] + present[2] + present[3] + present[4]
    d, t, a, b = bands[0], bands[1], bands[2], bands[3]
    mob, mob1 = F.sqrt(ratio(F.col("v1"), F.col("v0"))), F.sqrt(ratio(F.col("v2"), F.col("v1")))
    at = lambda k: F.coalesce(F.greatest(F.col(f"__shape.{k}"), F.lit(0)) * g.df(), F.lit(0.0))
    peak = F.array_max("__pdr")
    offset = g.pick(lambda x: x.bins(*dims.PDR_BAND, closed=True)[0] - 1)
    return df.select(
        *keys, *[ratio(F.col(f"bp_{x}"), whole).alias(f"rel_{x}") for x in dims.BANDS],
        ratio(t, a).alias("theta_alpha_ratio"), ratio(d + t, a + b).alias("slowing_ratio"),
        (-F.col("__shape.h") / g.pick(lambda x: float(np.log(len(x.f))))).alias("spectral_entropy"),
        at("e").alias("spectral_edge95"), at("m").alias("spectral_median"),
        ((F.array_position("__pdr", peak) + offset).cast("double") * g.df()).alias("pdr_frequency"),
        ratio(peak, total(F.col("__pdr"))).alias("pdr_prominence"),
        aperiodic_exponent(p, g).alias("aperiodic_exponent"),
        mob.alias("hjorth_mobility"), ratio(mob1, mob).alias("hjorth_complexity"), a.alias("alpha"))


def asymmetry(alpha: Column, pairs: Sequence[tuple[str, str]] = dims.LATERAL_PAIRS) -> Column:
    """Mean |(l − r)/(l + r)| over the site pairs present in the channel → power map."""
    def one(l: str, r: str) -> Column:
        x, y = F.try_element_at(alpha, F.lit(l)), F.try_element_at(alpha, F.lit(r))
        return F.abs(ratio(x - y, x + y))
    vals = F.array_compact(F.array(*[one(l, r) for l, r in pairs]))
    return F.when(F.size(vals) > 0, total(vals) / F.size(vals))


def ap_gradient(alpha: Column, regions: Mapping[str, Sequence[str]] = dims.REGION) -> Column:
    """(posterior − anterior)/(posterior + anterior) of mean site power."""
    def mean(name: str) -> Column:
        vals = F.array_compact(F.array(*[F.try_element_at(alpha, F.lit(s)) for s in regions[name]]))
        return F.when(F.size(vals) > 0, total(vals) / F.size(vals))
    ant, post = mean("frontal"), mean("posterior")
    return ratio(post - ant, post + ant)


def window_features(per_channel: DataFrame, keys: Sequence[str], bipolar: Column | None = None) -> DataFrame:
    """Channel means, null-skipping, plus the two spatial features.

    One shuffle; the group is one window, so the alpha map it gathers is bounded by the montage.
    """
    names = dims.FEATURES[:15]
    alpha = F.map_from_entries(F.collect_list(F.when(F.col("alpha").isNotNull(), F.struct("channel", "alpha"))))
    g = per_channel.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in names], alpha.alias("__alpha"))
    asym, grad = asymmetry(F.col("__alpha")), ap_gradient(F.col("__alpha"))
    if bipolar is not None:
        asym, grad = F.when(~bipolar, asym), F.when(~bipolar, grad)
    return g.select(*keys, *names, asym.alias("asymmetry_alpha"), grad.alias("ap_gradient_alpha"))


def recording_features(windows: DataFrame, keys: Sequence[str], names: Sequence[str] = tuple(dims.FEATURES),
                       hot: bool | None = None) -> DataFrame:
    """Median over windows of every feature, null-skipping, with the number of windows."""
    keys, names = list(keys), list(names)
    if not group_is_hot(windows, keys, hot):
        return windows.groupBy(*keys).agg(F.count("*").alias("n_windows"),
                                          *[F.percentile(n, F.lit(0.5)).alias(n) for n in names])
    from tidemark.tables import to_long
    long = to_long(windows, keys, names)
    med = quantiles(long, [*keys, "feature"], "value", {"value": 0.5}, True)
    wide = med.groupBy(*keys).pivot("feature", names).agg(F.first("value"))
    return windows.groupBy(*keys).agg(F.count("*").alias("n_windows")).join(wide, keys, "left")


def mains(spectrum: DataFrame, keys: Sequence[str], g: Grid, candidates: Sequence[float] = (50.0, 60.0),
          min_ratio: float = 3.0) -> DataFrame:
    """Mains frequency by the peak over the local median of the channel-mean spectrum, or null."""
    mean_p = (spectrum.select(*keys, F.posexplode("p").alias("k", "v"))
              .groupBy(*keys, "k").agg(F.avg("v").alias("v")))
    cand = dims.table(spectrum.sparkSession, [(float(c),) for c in candidates], "f0")
    f = F.col("k") * g.df
    near = mean_p.crossJoin(F.broadcast(cand)).filter(
        (F.col("f0") < g.nyquist - 2) & (f > F.col("f0") - 10) & (f < F.col("f0") + 10))
    inside = (f > F.col("f0") - 2) & (f < F.col("f0") + 2)
    per = near.groupBy(*keys, "f0").agg(
        F.max(F.when(inside, F.col("v"))).alias("peak"), F.percentile("v", F.lit(0.5)).alias("local"),
        F.count("*").alias("n"))
    per = per.filter("peak IS NOT NULL AND n >= 5").withColumn("ratio", F.col("peak") / (F.col("local") + 1e-30))
    best = per.groupBy(*keys).agg(F.max("ratio").alias("ratio"),
                                  F.min_by("f0", F.struct((-F.col("ratio")).alias("r"), "f0")).alias("f0"))
    return best.withColumn("mains_hz", F.when(F.col("ratio") >= min_ratio, F.col("f0"))).drop("f0")
