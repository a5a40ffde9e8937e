"""Dimension tables: fixed values of the study design, and the grids built from them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Label vocabulary, classes and tags -------------------------------------------
LABELS = {
    "CN": "CN", "CONTROL": "CN", "Healthy": "CN", "healthy": "CN", "normal": "CN", "Normal": "CN",
    "C": "CN", "HC": "CN", "AD": "AD", "A": "AD", "DEM": "AD", "Dementia": "AD", "dementia": "AD",
    "FTD": "FTD", "F": "FTD", "MCI": "MCI", "VAD": "VAD", "TGA": "TGA",
}
IMPAIRED = ["AD", "FTD", "MCI", "VAD"]
SCREENING = ["CN", "AD", "FTD", "MCI", "VAD"]
CONTRASTS = {
    "screening": ["AD", "FTD", "MCI", "VAD"],
    "dementia": ["AD", "FTD", "VAD"],
    "mci": ["MCI"],
}
CONTROL = "CN"
FTD_TAGS = ["ftd", "bvftd", "non_fluent_aphasia", "semantic_aphasia"]
AD_TAGS = ["ad", "load", "eoad"]
NORMAL_TAGS = ["normal", "cb_normal", "hc_normal"]
VASCULAR_TAGS = ["vd", "sivd", "ad_vd_mixed"]
TGA_TAGS = ["tga"]

# Electrode sites and montages -------------------------------------------------
CANON = ["Fp1", "Fp2", "F7", "F3", "Fz", "F4", "F8", "T3", "C3", "Cz", "C4", "T4",
         "T5", "P3", "Pz", "P4", "T6", "O1", "O2"]
SITE_ALIAS = {"FZ": "Fz", "CZ": "Cz", "PZ": "Pz", "T7": "T3", "T8": "T4", "P7": "T5", "P8": "T6"}
REGION = {
    "frontal": ["Fp1", "Fp2", "F7", "F3", "Fz", "F4", "F8"],
    "temporal": ["T3", "T4", "T5", "T6"],
    "central": ["C3", "Cz", "C4"],
    "posterior": ["P3", "Pz", "P4", "O1", "O2"],
}
LATERAL_PAIRS = [("Fp1", "Fp2"), ("F7", "F8"), ("F3", "F4"), ("T3", "T4"),
                 ("C3", "C4"), ("T5", "T6"), ("P3", "P4"), ("O1", "O2")]
NEIGHBOURS = {
    "Fp1": ["Fp2", "F7", "F3"], "Fp2": ["Fp1", "F4", "F8"], "F7": ["Fp1", "F3", "T3"],
    "F3": ["Fp1", "F7", "Fz", "C3"], "Fz": ["F3", "F4", "Cz"], "F4": ["Fp2", "Fz", "F8", "C4"],
    "F8": ["Fp2", "F4", "T4"], "T3": ["F7", "C3", "T5"], "C3": ["F3", "T3", "Cz", "P3"],
    "Cz": ["Fz", "C3", "C4", "Pz"], "C4": ["F4", "Cz", "T4", "P4"], "T4": ["F8", "C4", "T6"],
    "T5": ["T3", "P3", "O1"], "P3": ["C3", "T5", "Pz", "O1"], "Pz": ["Cz", "P3", "P4"],
    "P4": ["C4", "Pz", "T6", "O2"], "T6": ["T4", "P4", "O2"], "O1": ["T5", "P3", "O2"],
    "O2": ["T6", "P4", "O1"],
}
B8 = ["F3", "F4", "C3", "C4", "T5", "T6", "O1", "O2"]
B4 = ["T5", "T6", "O1", "O2"]
# name: (channels, reference, bipolar pairs, family)
MONTAGES = {
    "b19": (CANON, "subset_car", [], "anatomical"),
    "b8": (B8, "subset_car", [], "anatomical"),
    "b4": (B4, "subset_car", [], "anatomical"),
    "b2": (["T5", "T6"], "subset_car", [], "anatomical"),
    "b1": (["T5", "T6"], "bipolar", [("T5", "T6")], "anatomical"),
    "b1_ap": (["Fp1", "O1"], "bipolar", [("Fp1", "O1")], "anatomical"),
    "r_frontal": (REGION["frontal"], "subset_car", [], "anatomical"),
    "r_temporal": (REGION["temporal"], "subset_car", [], "anatomical"),
    "r_central": (REGION["central"], "subset_car", [], "anatomical"),
    "r_posterior": (REGION["posterior"], "subset_car", [], "anatomical"),
    "muse": (["T5", "Fp1", "Fp2", "T6"], "subset_car", [], "commodity"),
    "ganglion": (["Fp1", "Fp2", "T3", "T4"], "subset_car", [], "commodity"),
    "insight": (["Fp1", "Fp2", "T3", "T4", "Pz"], "subset_car", [], "commodity"),
    "frontal1": (["Fp1", "Fp2"], "bipolar", [("Fp1", "Fp2")], "commodity"),
    "b4_inherit": (B4, "inherit", [], "control"),
    "b8_inherit": (B8, "inherit", [], "control"),
}
DEVICE_CHANNELS = ["L1", "L2", "L3", "FH_L1", "FH_L2", "L8", "L9", "L10",
                   "R1", "R2", "R3", "FH_R1", "FH_R2", "R8", "R9", "R10"]
DEVICE_BLOCKS = {"forehead": [3, 4, 11, 12], "ear_left": [0, 1, 2, 5, 6, 7],
                 "ear_right": [8, 9, 10, 13, 14, 15]}
DEVICE_PAIRS = [("L1", "R1"), ("L2", "R2"), ("L3", "R3"), ("L8", "R8"), ("L9", "R9"),
                ("L10", "R10"), ("FH_L1", "FH_R1"), ("FH_L2", "FH_R2")]

# Windowing, digitisation, bands, features -------------------------------------
WINDOW_SAMPLES, QUOTA, NATIVE_RATE, PTP_REJECT = 1024, 24, 256, 200e-6
FULL_SCALE = 400e-6
RATES, DEPTHS = [256, 128, 64], [None, 16, 12, 8]
PREPROC_BAND = {"full": None, "emgfree": (2.0, 20.0), "noica": None}
BANDS = {"delta": (1.0, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0),
         "beta": (13.0, 30.0), "gamma": (30.0, 45.0)}
PDR_BAND, APERIODIC_FIT = (6.0, 13.0), (2.0, 24.0)
FEATURES = ["rel_delta", "rel_theta", "rel_alpha", "rel_beta", "rel_gamma", "theta_alpha_ratio",
            "slowing_ratio", "spectral_entropy", "spectral_edge95", "spectral_median",
            "pdr_frequency", "pdr_prominence", "aperiodic_exponent", "hjorth_mobility",
            "hjorth_complexity", "asymmetry_alpha", "ap_gradient_alpha"]
SLOWING_TRIAD = ["theta_alpha_ratio", "rel_theta", "pdr_frequency"]
SHORT_QUOTAS = {"clean": 24, "short12": 12, "short6": 6, "short3": 3}
# name: (share moved towards a neighbouring site, one lead lost, quota, rate divisor, bits)
STRESS = {
    "clean": (0.0, False, 24, 1, None),
    "contact_drop": (0.0, True, 24, 1, None),
    "displace50": (0.5, False, 24, 1, None), "displace100": (1.0, False, 24, 1, None),
    "short12": (0.0, False, 12, 1, None), "short6": (0.0, False, 6, 1, None), "short3": (0.0, False, 3, 1, None),
    "mix_moderate": (0.5, False, 15, 2, 8), "mix_severe": (1.0, False, 6, 2, 8),
}

# Inference ---------------------------------------------------------------------
PLACEMENT_PAIRS = [("b2", "b19"), ("b4", "b19"), ("r_temporal", "r_frontal"), ("b2", "r_frontal"),
                   ("b2", "frontal1"), ("r_posterior", "r_frontal"), ("b2", "muse"),
                   ("b2", "ganglion"), ("b2", "insight"), ("b4", "b4_inherit")]
PREVALENCES = [0.05, 0.10, 0.20]
DESIGN_DELTAS = [0.02, 0.03, 0.04, 0.05, 0.06, 0.08]
SCALE_EDGES = [-1.0, 18.5, 25.5, 31.0]
MIN_EPV = 10.0


def net_benefit_grid() -> list[float]:
    return [round(0.05 + 0.01 * i, 2) for i in range(46)]


def check_sites(name: str, sites: list[str]) -> None:
    bad = sorted(set(sites) - set(CANON))
    if bad:
        raise ValueError(f"{name}: unknown sites {bad}")


def montage_rows() -> list[tuple]:
    """(montage, ref, family, n_electrodes, n_signals)"""
    rows = []
    for name, (chans, ref, pairs, family) in MONTAGES.items():
        check_sites(name, [*chans, *[c for p in pairs for c in p]])
        rows.append((name, ref, family, len(chans), len(pairs) if ref == "bipolar" else len(chans)))
    return rows


def table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A constant table as a local relation: no Python workers, known size."""
    return spark.sql(f"SELECT * FROM {values_sql(rows)[1:-1]} AS t({columns})")


def montage(spark: SparkSession) -> DataFrame:
    return table(spark, montage_rows(), "montage, ref, family, n_electrodes, n_signals")


def montage_channel(spark: SparkSession) -> DataFrame:
    rows = [(m, spec[1], c) for m, spec in MONTAGES.items() for c in spec[0]]
    return table(spark, rows, "montage, ref, channel")


def montage_pair(spark: SparkSession) -> DataFrame:
    rows = [(m, a, b) for m, spec in MONTAGES.items() for a, b in spec[2]]
    return table(spark, rows, "montage, a, b")


def region_channel(spark: SparkSession) -> DataFrame:
    rows = [(r, c) for r, cs in REGION.items() for c in cs]
    return table(spark, rows, "region, channel")


def lateral_pair(spark: SparkSession) -> DataFrame:
    return table(spark, LATERAL_PAIRS, "l, r")


def neighbour_edge(spark: SparkSession) -> DataFrame:
    rows = [(c, i, n) for c, ns in NEIGHBOURS.items() for i, n in enumerate(ns)]
    return table(spark, rows, "channel, slot, neighbour")


def contrast(spark: SparkSession) -> DataFrame:
    """(contrast, label, y): controls are y = 0 in every contrast."""
    rows = [(t, l, 1) for t, ls in CONTRASTS.items() for l in ls]
    rows += [(t, CONTROL, 0) for t in CONTRASTS]
    return table(spark, rows, "contrast, label, y")


def values_sql(rows: list[tuple]) -> str:
    """SQL VALUES list for the oracle statements."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, float):  # exponent form keeps the literal a double
            return repr(v) if "e" in repr(v) else repr(v) + "e0"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return "(VALUES " + ",".join("(" + ",".join(lit(v) for v in r) + ")" for r in rows) + ")"
