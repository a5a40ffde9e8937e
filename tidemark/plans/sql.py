"""Fragments shared by the DuckDB statements."""
from __future__ import annotations

from tidemark.functions.draws import poisson_bounds


def r(expr: str, digits: int = 6) -> str:
    """Twin of functions.scalars.rounded."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0e0)"


def u(*parts: str) -> str:
    """Twin of functions.draws.uniform; parts are SQL expressions."""
    return f"({h(*parts)} / 4294967296.0e0)"


def digest(*parts: str) -> str:
    return "md5(" + " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"


def h(*parts: str) -> str:
    """Twin of functions.draws.hash32."""
    return f"CAST('0x' || substr({digest(*parts)}, 1, 8) AS BIGINT)"


def midrank(part: str, value: str) -> str:
    """Midrank of ``value`` inside ``part``."""
    return (f"(rank() OVER (PARTITION BY {part} ORDER BY {value})"
            f" + (count(*) OVER (PARTITION BY {part}, {value}) - 1) / 2.0e0)")


def two_sided(z: str) -> str:
    """2·(1 − Φ(|z|)) by the series of the normal integral."""
    a = f"abs({z})"
    term = (f"exp((2 * k + 1) * ln(greatest({a}, 1e-300)) - a2 / 2"
            f" - (ln(2.0e0) * (k + 1) + lgamma(k + 1.5e0) - 0.5e0 * ln(pi())))")
    term = term.replace("a2", f"({a} * {a})")
    return (f"(CASE WHEN {z} IS NULL THEN NULL WHEN {a} > 12 THEN 0.0e0 ELSE greatest(0.0e0, 1 - 2 / sqrt(2 * pi()) * "
            f"list_sum([{term} for k in range(0, 250)])) END)")


def auc_cte(name: str, src: str, keys: str, y: str, s: str) -> str:
    """CTE with (keys, auc, n_pos, n_neg) by the rank-sum formula."""
    return f"""{name} AS (SELECT {keys}, count(*) FILTER (y_ = 1) AS n_pos,
      count(*) FILTER (y_ = 0) AS n_neg,
      CASE WHEN count(*) FILTER (y_ = 1) > 0 AND count(*) FILTER (y_ = 0) > 0 THEN
       (sum(rk) FILTER (y_ = 1) - count(*) FILTER (y_ = 1) * (count(*) FILTER (y_ = 1) + 1) / 2.0e0)
        / (CAST(count(*) FILTER (y_ = 1) AS DOUBLE) * count(*) FILTER (y_ = 0)) END AS auc
      FROM (SELECT {keys}, {y} AS y_, {midrank(keys, s)} AS rk FROM {src} WHERE {s} IS NOT NULL) q_{name}
      GROUP BY {keys})"""


def delong_cte(name: str, src: str, keys: str, y: str, a: str, b: str) -> str:
    """CTE with n, auc_a, auc_b, diff, se, z per group (rows with both scores present)."""
    def v(s):
        return (f"CASE WHEN {y} = 1 THEN ({midrank(keys, s)} - {midrank(keys + ', ' + y, s)}) / n0"
                f" ELSE 1 - ({midrank(keys, s)} - {midrank(keys + ', ' + y, s)}) / n1 END")
    return f"""{name}_src AS (SELECT *, count(*) FILTER ({y} = 1) OVER (PARTITION BY {keys}) AS n1,
        count(*) FILTER ({y} = 0) OVER (PARTITION BY {keys}) AS n0
        FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
      {name}_v AS (SELECT {keys}, {y} AS y_, n1, n0, {v(a)} AS va, {v(b)} AS vb FROM {name}_src
        WHERE n1 > 0 AND n0 > 0 AND n1 + n0 >= 10),
      {name}_e AS (SELECT {keys}, avg(va) FILTER (y_ = 1) AS auc_a, avg(vb) FILTER (y_ = 1) AS auc_b,
        (covar_samp(va, va) FILTER (y_ = 1) + covar_samp(vb, vb) FILTER (y_ = 1)
          - 2 * covar_samp(va, vb) FILTER (y_ = 1)) / max(n1)
        + (covar_samp(va, va) FILTER (y_ = 0) + covar_samp(vb, vb) FILTER (y_ = 0)
          - 2 * covar_samp(va, vb) FILTER (y_ = 0)) / max(n0) AS var_ FROM {name}_v GROUP BY {keys}),
      {name} AS (SELECT * EXCLUDE (var_),
          auc_a - auc_b AS diff, CASE WHEN var_ <= 0 THEN 0.0e0 ELSE sqrt(var_) END AS se,
          CASE WHEN var_ <= 0 THEN 0.0e0 ELSE (auc_a - auc_b) / sqrt(var_) END AS z, var_ <= 0 AS flat
        FROM (SELECT DISTINCT {keys}, n1 + n0 AS n FROM {name}_src) g LEFT JOIN {name}_e USING ({keys}))"""


def p_of(z: str = "z", flat: str = "flat", diff: str = "diff") -> str:
    return (f"CASE WHEN {flat} THEN CASE WHEN abs({diff}) < 1e-12 THEN 1.0e0 ELSE 0.0e0 END"
            f" ELSE {two_sided(z)} END")


def poisson_of(draw: str) -> str:
    bounds = poisson_bounds()
    return "CASE " + " ".join(f"WHEN {draw} < '{b}' THEN {k}" for k, b in enumerate(bounds)) + f" ELSE {len(bounds)} END"


def boot(seed: str, src: str, sid: str, cols: str, n: int, name: str = "w") -> str:
    """CTE that replays bootstrap_weights: (b, w) and the columns ``cols`` of the rows of ``src``."""
    return f"""{name} AS (SELECT {cols}, b, w FROM (SELECT {cols}, block * 4 + j AS b, {poisson_of('substr(d, 1 + 8 * j, 8)')} AS w
    FROM (SELECT *, {digest(f"'{seed}'", 'block', sid)} AS d FROM {src} CROSS JOIN (SELECT unnest(range(0, {(n + 3) // 4})) AS block)) q_{name}
    CROSS JOIN (SELECT unnest(range(0, 4)) AS j)) p_{name} WHERE w > 0 AND b < {n})"""


def band_gain(f: str, rate: float, lo: float, hi: float) -> str:
    """Zero-phase Butterworth band-pass gain at ``f`` (0 < f < Nyquist)."""
    w, a, b = (f"tan(pi() * ({v}) / {float(rate)!r}e0)" for v in (f, repr(float(lo)) + "e0", repr(float(hi)) + "e0"))
    return f"(1 / (1 + pow(({w} * {w} - {a} * {b}) / ({w} * ({b} - {a})), 8)))"
