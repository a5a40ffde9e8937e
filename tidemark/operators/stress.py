"""The stress cube: acquisition faults of every recording under several montages in one keyed plan.

A fault that acts on electrodes is linear, so it is a matrix that is multiplied into the montage's own mixing matrix: a lead that is
lost and left out of the reference, or sites moved part of the way to a neighbour. Which lead or neighbour is a hash of the recording.
Short quotas, lower rates and converters act on what the montage records. Windows are accepted on the montage's own signals, so every
fault has its own choice of windows.

Samples are gathered once into one row a window and written. One Arrow pass returns a peak-to-peak for each window, fault and montage,
a second one the spectra of the windows that a condition has kept.
"""
from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import dims
from tidemark.functions.draws import digest, hash32
from tidemark.operators import degrade as dg
from tidemark.operators import sweep as sw
from tidemark.operators import windows as wn
from tidemark.operators.ordered import same_group
from tidemark.session import stored

PLAIN = "plain"


class Fault(NamedTuple):
    share: float
    drop: bool
    quota: int
    divisor: int
    bits: int | None


def mix_of(name: str, fault: Fault) -> str:
    """Faults that leave the electrodes alone share one mixing, and with it one choice of windows."""
    return name if fault.share or fault.drop else PLAIN


def mixes(faults: Mapping[str, Fault]) -> dict[str, Fault]:
    return {mix_of(n, f): f for n, f in faults.items()}


def checked(faults: Mapping[str, Sequence], montages: Sequence[str], rate: int) -> dict[str, Fault]:
    out = {n: Fault(*f) for n, f in faults.items()}
    for f in out.values():
        dg.decimation_factor(rate, rate // f.divisor)
        if f.drop and any(dims.MONTAGES[m][1] == "bipolar" for m in montages):
            raise ValueError("a bipolar montage has no lead to drop")
    return out


def recording_draws(faults: Mapping[str, Fault], montages: Sequence[str]) -> Column:
    """One draw for each moved mix and site, then one for each montage's lost lead: the same for all windows of a recording.

    Montages share the draws of a site, as the electrode is one.
    """
    moved = [hash32(F.col("rec"), f"{m}|displace", s) for m, f in mixes(faults).items() if f.share for s in dims.CANON]
    return F.array(*moved, *[hash32(F.col("rec"), f"contact|{m}") for m in montages])


def fault_matrix(names: Sequence[str], montage: str, mix: str, faults: Mapping[str, Fault], montages: Sequence[str],
                 draws: Sequence[int]) -> tuple[np.ndarray, list[str]] | None:
    """Signals of a montage under a fault as a matrix over the recording's channels; None when a site is missing.

    A site moves towards one of those of its neighbours that the recording carries, and stays where there is none.
    """
    fault, sites = mixes(faults)[mix], dims.MONTAGES[montage][0]
    moved = [m for m, f in mixes(faults).items() if f.share]
    lost = sites[int(draws[len(moved) * len(dims.CANON) + list(montages).index(montage)]) % len(sites)] if fault.drop else None
    if any(s not in names for s in sites):
        return None
    matrix, signals = sw.mixing(names, montage, lost)
    if fault.share:
        own = np.eye(len(names))
        first = moved.index(mix) * len(dims.CANON)
        for s in sites:
            near = [n for n in dims.NEIGHBOURS[s] if n in names]
            if near:
                at = list(names).index(s)
                own[at] = 0.0
                own[at, at] = 1 - fault.share
                own[at, list(names).index(near[int(draws[first + dims.CANON.index(s)]) % len(near)])] += fault.share
        matrix = matrix @ own
    return matrix, signals


def _choices(names: Sequence[str], montage: str, mix: str, faults: Mapping[str, Fault], montages: Sequence[str]) -> tuple[list[int], list[int]]:
    """Which draws ``fault_matrix`` reads, and modulo what: recordings that agree in these share a matrix."""
    fault, sites = mixes(faults)[mix], dims.MONTAGES[montage][0]
    moved = [m for m, f in mixes(faults).items() if f.share]
    read = [(len(moved) * len(dims.CANON) + list(montages).index(montage), len(sites))] if fault.drop else []
    if fault.share:
        near = {s: sum(n in names for n in dims.NEIGHBOURS[s]) for s in sites}
        read += [(moved.index(mix) * len(dims.CANON) + dims.CANON.index(s), n) for s, n in near.items() if n]
    return [i for i, _ in read], [n for _, n in read]


def _batches(pdf: pd.DataFrame) -> Iterator[tuple[list[str], pd.DataFrame, np.ndarray]]:
    """Windows with the same channels and length, some at a time: names, rows, samples (windows × channels × time)."""
    shape = [pdf["channels"].map(tuple), pdf["xs"].map(len)]
    for (names, size), g in pdf.groupby(shape, sort=False):
        some = max(1, sw.CHUNK_SAMPLES // max(1, size))
        for start in range(0, len(g), some):
            part = g.iloc[start:start + some]
            yield list(names), part, np.stack(part["xs"].to_list()).astype(float).reshape(len(part), len(names), -1)


def _mixed(names: list[str], draws: list, x: np.ndarray, montage: str, mix: str, faults, montages) -> tuple[np.ndarray, np.ndarray] | None:
    """Signals (windows × signals × time) and their names (windows × signals); a matrix is made once for equal choices."""
    made: dict[tuple, tuple | None] = {}
    at, of = _choices(names, montage, mix, faults, montages)
    keys = [tuple(int(d[i]) % n for i, n in zip(at, of)) for d in draws]
    for k, d in zip(keys, draws):
        if k not in made:
            made[k] = fault_matrix(names, montage, mix, faults, montages, d)
    if any(m is None for m in made.values()):
        return None
    return np.einsum("wsc,wct->wst", np.stack([made[k][0] for k in keys]), x), np.array([made[k][1] for k in keys])


def fault_ptp(windows: DataFrame, faults: Mapping[str, Fault], montages: Sequence[str], length: int) -> DataFrame:
    """(mix, montage, rec, win, k, ptp): the worst of the montage's own signals in every complete window; null with an unknown sample."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for names, g, x in _batches(pdf):
                for montage in montages:
                    for mix in mixes(faults):
                        got = _mixed(names, g["draws"].to_list(), x, montage, mix, faults, montages)
                        if got is not None:
                            ptp = (got[0].max(axis=2) - got[0].min(axis=2)).max(axis=1)
                            yield pd.DataFrame({"mix": mix, "montage": montage, "rec": g["rec"].to_numpy(), "win": g["win"].to_numpy(),
                                                "k": len(names), "ptp": pd.Series(ptp).where(~np.isnan(ptp), None)})

    complete = windows.filter(F.size("xs") == F.size("channels") * length)
    return sw.by_recording(complete, step, "mix string, montage string, rec string, win bigint, k int, ptp double")


def chosen(ptp: DataFrame, faults: Mapping[str, Fault], limit: float) -> DataFrame:
    """(cond, rec, win): accepted windows in hash order up to the quota; with none accepted, the quietest.

    One row limit a group, taken inside the tasks before the shuffle. Accepted windows come first, so a group
    has one if the first of its rows is one, and the k-th row serves every quota of k or more.
    """
    ok = F.col("ptp") <= limit
    group = W.partitionBy("mix", "montage", "rec")
    order = F.row_number().over(group.orderBy(~ok, F.when(ok, digest(F.col("rec"), F.col("win"))), "ptp", "win"))
    top = ptp.filter("ptp IS NOT NULL").withColumn("__k", order).filter(F.col("__k") <= max(f.quota for f in faults.values()))
    top = top.withColumn("__any", F.max(ok).over(group)).filter(ok | ~F.col("__any"))
    conds = dims.table(ptp.sparkSession, [(n, mix_of(n, f), f.quota) for n, f in faults.items()], "fault, mix, quota")
    return top.join(F.broadcast(conds), "mix").filter("__k <= quota").select(F.concat_ws("|", "fault", "montage").alias("cond"), "rec", "win")


def fault_spectra(windows: DataFrame, faults: Mapping[str, Fault], montages: Sequence[str], rate: int, full_scale: float) -> DataFrame:
    """Spectra of the conditions listed in ``conds`` of each window."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for names, g, x in _batches(pdf):
                wanted = [set(c) for c in g["conds"]]
                for name, fault in faults.items():
                    for montage in montages:
                        cond = f"{name}|{montage}"
                        at = np.flatnonzero([cond in w for w in wanted])
                        if not len(at):
                            continue
                        some = g.iloc[at]
                        y, signals = _mixed(names, some["draws"].to_list(), x[at], montage, mix_of(name, fault), faults, montages)
                        rec, win = (np.repeat(some[c].to_numpy(), y.shape[1]) for c in ("rec", "win"))
                        y = dg.converted_rows(dg.decimate_rows(y.reshape(-1, y.shape[2]), fault.divisor), fault.bits, full_scale)
                        yield sw.spectrum_rows(cond, montage, rate // fault.divisor, rec, win, signals.ravel(), y)

    return sw.by_recording(windows, step, sw.SPECTRA)


def stressed(samples: DataFrame, length: int, rate: int, limit: float, full_scale: float, montages: Sequence[str] = ("b19", "b4"),
             faults: Mapping[str, Sequence] = dims.STRESS, hot: bool | None = None) -> DataFrame:
    """(cond, rec, n_windows, 17 features) over fault × montage; cond is ``fault|montage``.

    A recording is cut as a whole: a window counts if all channels of the recording are complete in it. Windows with an unknown
    sample are never chosen; recordings without a window, and montages with a missing site, have no row.
    """
    faults = checked(faults, montages, rate)
    windows = stored(wn.matrices(samples, None, length).withColumn("draws", recording_draws(faults, montages)), "windows")
    need = windows.select("rec", F.explode("channels").alias("c")).groupBy("rec").agg(F.count_distinct("c").alias("need"))
    ptp = same_group(fault_ptp(windows, faults, montages, length), need, ["rec"]).filter("k = need")
    kept = chosen(ptp, faults, limit).groupBy("rec", "win").agg(F.collect_set("cond").alias("conds"))
    rates = sorted({rate // f.divisor for f in faults.values()}, reverse=True)
    spectra = fault_spectra(same_group(windows, stored(kept, "kept"), ["rec", "win"]), faults, montages, rate, full_scale)
    return sw.recording_cube(spectra, length, rate, rates, hot)
