"""Operating-point tables, curve summaries, subgroup rates, design tables, orderings."""
from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import dims
from tidemark.functions.scalars import Z80_POWER, Z95_FULL, clip, ratio, wilson
from tidemark.operators.ordered import apart, midranks, neighbours, row_numbers, same_group
from tidemark.operators.rankstats import negatives, positives, with_group
from tidemark.session import stored

#: Values looked for in one pass; the longest that is short; characters of texts taken together, and of a text that is long;
#: steps of a trie kept as a plain table.
VALUES_AT_ONCE, SHORT_VALUE, TOGETHER, CHARS_AT_ONCE, TABLE_CELLS = 100_000, 8, 131_072, 1_000_000, 4_000_000


def panel(points: DataFrame, prevalences: DataFrame) -> DataFrame:
    """Predictive values, likelihood ratios and referral load of each operating point."""
    se, sp, pv = F.col("sensitivity"), F.col("specificity"), F.col("prevalence")
    tp, fp, tn, fn = se * pv, (1 - sp) * (1 - pv), sp * (1 - pv), (1 - se) * pv
    out = points.crossJoin(F.broadcast(prevalences)).withColumns({
        "balanced_accuracy": (se + sp) / 2, "lr_positive": ratio(se, 1 - sp),
        "lr_negative": ratio(1 - se, sp), "ppv": ratio(tp, tp + fp), "npv": ratio(tn, tn + fn),
        "flagged_per_1000": 1000 * (tp + fp), "true_per_1000": 1000 * tp,
        "nns": ratio(F.lit(1.0), tp)})
    both = F.col("ppv") + se
    return out.withColumn("f1", F.coalesce(ratio(2 * F.col("ppv") * se, both), F.lit(0.0)))


def brier(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    d = clip(F.col(p), 1e-6, 1 - 1e-6) - F.col(y)
    return df.groupBy(*keys).agg(F.avg(d * d).alias("brier"))


def logit(p) -> F.Column:
    q = clip(p, 1e-6, 1 - 1e-6)
    return F.log(q / (1 - q))


def calibration_intercept(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    """Logit of the observed rate minus the mean predicted logit."""
    g = df.groupBy(*keys).agg(F.avg(F.col(y).cast("double")).alias("__r"), F.avg(logit(F.col(p))).alias("__l"))
    ok = (F.col("__r") > 0) & (F.col("__r") < 1)
    return g.select(*keys, F.when(ok, F.log(F.col("__r") / (1 - F.col("__r"))) - F.col("__l"))
                    .alias("calibration_intercept"))


def curve_summary(curves: DataFrame, keys: Sequence[str], arm: str, base: str, test: str) -> DataFrame:
    """Where ``test`` beats ``base`` and treat-all, and the largest gain per 1000.

    Both curves of a key sit in one small group (two rows a threshold), so they are pivoted by a
    conditional aggregate instead of joined.
    """
    at = curves.groupBy(*keys, "threshold").agg(
        F.max(F.when(F.col(arm) == base, F.col("net_benefit"))).alias("nb_base"),
        F.max(F.when(F.col(arm) == test, F.col("net_benefit"))).alias("nb_test"),
        F.max(F.when(F.col(arm) == base, F.col("treat_all"))).alias("nb_all"))
    d = F.col("nb_test") - F.col("nb_base")
    use = (d > 0) & (F.col("nb_test") > F.col("nb_all")) & (F.col("nb_test") > 0)
    t = F.when(use, F.col("threshold"))
    return at.groupBy(*keys).agg(
        F.min(t).alias("from_threshold"), F.max(t).alias("to_threshold"),
        F.coalesce(F.max(F.when(use, 1000 * d)), F.lit(0.0)).alias("max_gain_per_1000"),
        F.min_by(t, F.when(use, F.struct((-d).alias("d"), F.col("threshold").alias("t")))).alias("threshold_at_max"))


def flag_rates(df: DataFrame, keys: Sequence[str], flag, min_n: int = 5) -> DataFrame:
    """Share flagged with its Wilson interval, for groups of at least ``min_n``."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(flag).alias("flagged")).filter(
        F.col("n") >= min_n)
    lo, hi = wilson(F.col("flagged"), F.col("n"))
    return g.withColumns({"rate": F.col("flagged") / F.col("n"), "ci_lo": lo, "ci_hi": hi})


def regression_metrics(df: DataFrame, keys: Sequence[str], y: str, pred: str) -> DataFrame:
    e = F.col(pred) - F.col(y)
    return df.filter(F.col(y).isNotNull() & F.col(pred).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.corr(pred, y).alias("pcc"))


def spans(df: DataFrame, keys: Sequence[str], item: str, value: str) -> DataFrame:
    """Range of a value over a family and the items at its ends; items without a value are skipped."""
    place = F.when(F.col(value).isNotNull(), F.struct(value, item))
    return df.groupBy(*keys).agg(
        (F.max(value) - F.min(value)).alias("span"),
        F.max_by(item, place).alias("best"), F.min_by(item, place).alias("worst"))


def span_ratio(per: DataFrame, family: str, above: str, below: str) -> DataFrame:
    """How far a value moves over one family against another: ratio of their spans, null without movement below."""
    pick = lambda f: F.max(F.when(F.col(family) == f, F.col("span")))
    return per.agg(pick(above).alias("span_above"), pick(below).alias("span_below")).withColumn(
        "ratio", ratio(F.col("span_above"), F.col("span_below")))


def draw_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Summary over draws; a key's draws are a design constant (tens)."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(v).alias("n_draws"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"),
        F.percentile(v, F.lit(0.1)).alias("p10"), F.percentile(v, F.lit(0.9)).alias("p90"),
        F.avg((v < 0.5).cast("double")).alias("share_below_half"),
        F.avg((v > 0).cast("double")).alias("share_positive"))


def f1_at(df: DataFrame, keys: Sequence[str], y: str, flag) -> DataFrame:
    """Confusion counts and F1 at a carried threshold."""
    f = flag.cast("bigint")
    g = df.groupBy(*keys).agg(F.sum(f * positives(y)).alias("tp"), F.sum(f * negatives(y)).alias("fp"),
                              F.sum((1 - f) * positives(y)).alias("fn"), F.sum((1 - f) * negatives(y)).alias("tn"))
    return g.withColumn("f1", F.coalesce(ratio(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))


def power_design(ref: DataFrame, deltas: DataFrame) -> DataFrame:
    """n needed per target difference, from one measured interval; rounded to tens."""
    se = (F.col("ci_hi") - F.col("ci_lo")) / (2 * Z95_FULL)
    need = F.col("delta") / (Z95_FULL + Z80_POWER)
    return ref.crossJoin(F.broadcast(deltas)).withColumn("se_ref", se).withColumn(
        "n_required", F.rint(F.col("n") * F.pow(se / need, F.lit(2)) / 10) * 10)


def occurrences(texts: DataFrame, keys: Sequence[str], text: str, values: DataFrame, at_once: int = VALUES_AT_ONCE) -> DataFrame:
    """(name, keys, n, n_texts): non-overlapping occurrences of each value, and texts that have it.

    ``values`` has (name, value), values not empty. Each text is read once for at most ``at_once`` values: short ones by a trie that is walked
    from all characters together, else by an automaton; more values take further passes, so what a task holds is bounded whatever their number. A task adds up its counts before they are shuffled.
    """
    keys = list(keys)
    rows = texts.select(*keys, F.col(text).alias("__text")).filter(F.col("__text").isNotNull())
    values = stored(values.select("name", "value"), "values")
    turns = max(1, -(-values.count() // at_once))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(["name " + values.schema["name"].dataType.simpleString(), *[f"`{k}` {types[k]}" for k in keys], "n bigint, n_texts bigint"])
    out = None
    for turn in range(turns):
        some = values if turns == 1 else values.filter(F.pmod(F.xxhash64("name", "value"), F.lit(turns)) == turn)
        chosen = [(r["name"], r["value"]) for r in some.toLocalIterator()]
        part = rows.mapInPandas(_counter(chosen, keys), schema)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("name", *keys).agg(F.sum("n").alias("n"), F.sum("n_texts").alias("n_texts"))


def _overlaps_itself(value: str) -> bool:
    """Whether two occurrences of a value can overlap; long values count as if they could."""
    return len(value) > 64 or any(value.startswith(value[i:]) for i in range(1, len(value)))


class _Short:
    """Short values as a trie in arrays, walked from all characters of many texts at once."""

    def __init__(self, words: Sequence[str]):
        chars = {c: i for i, c in enumerate(sorted({c for w in words for c in w}), 1)}
        # State 0 is the end of a walk, state 1 its start.
        self.width, edges, value = len(chars) + 1, {}, {}
        for v, w in enumerate(words):
            state = 1
            for c in w:
                state = edges.setdefault(state * self.width + chars[c], len(edges) + 2)
            value[state] = v
        self.ids = np.zeros(max(map(ord, chars)) + 2, np.int32)
        self.ids[[ord(c) for c in chars]] = list(chars.values())
        self.value = np.full(len(edges) + 2, -1, np.int32)
        self.value[list(value)] = list(value.values())
        self.keys = np.array(sorted(edges))
        self.next = np.array([edges[k] for k in self.keys.tolist()], np.int32)
        self.table = None
        if len(self.value) * self.width <= TABLE_CELLS:
            self.table = np.zeros(len(self.value) * self.width, np.int32)
            self.table[self.keys] = self.next
        self.first = self.step(np.ones(self.width, np.int32), np.arange(self.width, dtype=np.int32))
        self.size, self.lengths = np.array([len(w) for w in words]), {len(w) for w in words}
        self.overlaps = np.array([_overlaps_itself(w) for w in words])

    def step(self, state: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The next states; 0 where there is none."""
        if self.table is not None:
            return self.table.take(state * np.int32(self.width) + ids)
        live, out = np.flatnonzero(state), np.zeros(len(state), np.int32)
        key = state[live].astype(np.int64) * self.width + ids[live]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        out[live] = np.where(self.keys[at] == key, self.next[at], 0)
        return out

    def count(self, texts: Sequence[str], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(group, value, n, n_texts) over texts with their groups."""
        codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        ids = self.ids.take(codes, mode="clip")
        ids[ends] = 0
        state, found = self.first.take(ids), []
        for depth in range(1, max(self.lengths) + 1):
            if depth > 1:
                # No walk goes beyond the last character, which is the end of a text.
                state = self.step(state[:-1], ids[depth - 1:])
            if depth in self.lengths:
                v = self.value.take(state)
                hit = np.flatnonzero(v >= 0)
                found.append((hit, v[hit]))
            if len(state) < 2:
                break
        pos, v = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
        pair = np.searchsorted(ends, pos) * len(self.size) + v
        drop = self._hidden(pos, pair, v)
        pair, n = np.unique(pair if drop is None else np.delete(pair, drop), return_counts=True)
        code, at = np.unique(group[pair // len(self.size)] * len(self.size) + pair % len(self.size), return_inverse=True)
        return code // len(self.size), code % len(self.size), np.bincount(at, n, len(code)).astype(int), np.bincount(at, minlength=len(code))

    def _hidden(self, pos: np.ndarray, pair: np.ndarray, v: np.ndarray) -> list[int] | None:
        """Occurrences that begin inside the counted one before them."""
        own = np.flatnonzero(self.overlaps[v])
        own = own[np.lexsort((pos[own], pair[own]))]
        near = np.r_[False, (pair[own][1:] == pair[own][:-1]) & (np.diff(pos[own]) < self.size[v[own]][1:])] if len(own) else np.zeros(0, bool)
        if not near.any():
            return None
        out, last = [], -1
        some = np.flatnonzero(near | np.r_[near[1:], False])
        for i, p, close, size in zip(own[some].tolist(), pos[own[some]].tolist(), near[some].tolist(), self.size[v[own[some]]].tolist()):
            if close and p - last < size:
                out.append(i)
            else:
                last = p
        return out


def _counter(values: list[tuple], keys: list[str]):
    def run(batches):
        import ahocorasick
        words: dict[str, list] = {}
        for name, value in values:
            words.setdefault(value, []).append(name)
        if not words:
            return
        named = list(words.values())
        short = _Short(list(words)) if max(map(len, words)) <= SHORT_VALUE else None
        automaton, size = ahocorasick.Automaton(), [len(w) for w in words]
        total: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def stream(text: str, times: Counter, texts: Counter) -> None:
            """A long text, or long values: one automaton, occurrences one by one."""
            if not len(automaton):
                for i, w in enumerate(words):
                    automaton.add_word(w, i)
                automaton.make_automaton()
            last: dict[int, int] = {}
            for end, v in automaton.iter(text):
                if end - size[v] >= last.get(v, -1):
                    times[v] += 1
                    last[v] = end
            texts.update(last.keys())

        def sent():
            rows = [(name, *key, n, texts[v]) for key, (times, texts) in total.items() for v, n in times.items() for name in named[v]]
            return pd.DataFrame(rows, columns=["name", *keys, "n", "n_texts"])

        for pdf in batches:
            of = [tuple(None if pd.isna(v) else v for v in row) for row in pdf[keys].itertuples(index=False, name=None)] if keys else [()] * len(pdf)
            some: list[str] = []
            group: list[int] = []
            places: dict[tuple, int] = {}
            room = 0

            def flush():
                each = list(places)
                for g, v, n, m in zip(*(a.tolist() for a in short.count(some, np.array(group)))):
                    times, texts = total[each[g]]
                    times[v] += n
                    texts[v] += m
                some.clear()
                group.clear()

            for key, text in zip(of, pdf.iloc[:, -1]):
                if short is None or len(text) > CHARS_AT_ONCE:
                    stream(text, *total[key])
                    continue
                if room + len(text) > TOGETHER and some:
                    flush()
                    room = 0
                some.append(text)
                group.append(places.setdefault(key, len(places)))
                room += len(text) + 1
            if some:
                flush()
            if sum(len(t) for t, _ in total.values()) > 200_000:
                yield sent()
                total.clear()
        if total:
            yield sent()

    return run


def rank_fraction(df: DataFrame, keys: Sequence[str], value: str, name: str, hot: bool | None = None) -> DataFrame:
    """Midrank divided by the group size."""
    keys = list(keys)
    hot, df = apart(df, keys, hot)
    if not hot:
        out = midranks(df, keys, value, name, False)
        return out.withColumn(name, F.col(name) / F.count(value).over(W.partitionBy(*keys)))
    df = stored(df, "ranked")
    n = df.groupBy(*keys).agg(F.count(value).alias("__n"))
    out = with_group(midranks(df, keys, value, name, True), n, keys)
    return out.withColumn(name, F.col(name) / F.col("__n")).drop("__n")


def interpolated_ranks(ref: DataFrame, held: DataFrame, keys: Sequence[str], raw: str, s: str,
                       name: str = "placed", hot: bool | None = None) -> DataFrame:
    """Place held-out raw scores into the reference ranking by linear interpolation.

    The reference's raw values and its final scores are sorted independently and paired by
    position; a held-out value is blended between the two reference values around it and clamped
    at the ends.
    """
    keys = list(keys)
    a = row_numbers(ref.select(*keys, raw, "id"), keys, [raw, "id"], "__i", hot)
    b = row_numbers(ref.select(*keys, s, "id"), keys, [s, "id"], "__i", hot).drop("id")
    table = same_group(a, b, [*keys, "__i"]).groupBy(*keys, raw).agg(F.min(s).alias("first"), F.max(s).alias("last"))
    ends = table.groupBy(*keys).agg(F.min("first").alias("__min"), F.max("last").alias("__max"))
    rows = held.select(*keys, "id", raw).withColumn("__ref", F.lit(0)).unionByName(
        table.select(*keys, F.lit(None).cast(held.schema["id"].dataType).alias("id"), raw, F.lit(1).alias("__ref")))
    near = neighbours(rows, keys, raw, "__ref", hot).filter("__ref = 0")
    lo = table.select(*keys, F.col(raw).alias("lo"), F.col("last").alias("__slo"))
    hi = table.select(*keys, F.col(raw).alias("hi"), F.col("first").alias("__shi"))
    j = same_group(same_group(same_group(near, lo, [*keys, "lo"], "left"), hi, [*keys, "hi"], "left"), ends, keys)
    x = F.col(raw)
    blend = F.col("__slo") + (F.col("__shi") - F.col("__slo")) * (x - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return j.select(*keys, "id", raw, F.when(F.col("lo").isNull(), F.col("__min"))
                    .when(F.col("hi").isNull(), F.col("__max"))
                    .when(F.col("lo") == F.col("hi"), F.col("__slo")).otherwise(blend).alias(name))


def differences(samples: DataFrame, keys: Sequence[str], t: str, x: str, block: int = 100_000) -> DataFrame:
    """First and second differences along a dense index.

    A series is cut in blocks of ``block`` samples and every block borrows the last two samples of
    the block before, so a very long series is still spread over tasks.
    """
    b = F.floor(F.col(t) / block)
    own = samples.withColumns({"__b": b, "__ghost": F.lit(False)})
    ghost = samples.filter(F.pmod(F.col(t), F.lit(block)) >= block - 2).withColumns(
        {"__b": b + 1, "__ghost": F.lit(True)})
    w = W.partitionBy(*keys, "__b").orderBy(t)
    p1, p2 = F.lag(x, 1).over(w), F.lag(x, 2).over(w)
    out = own.unionByName(ghost).withColumns({"d1": F.col(x) - p1, "d2": F.col(x) - 2 * p1 + p2})
    return out.filter("NOT __ghost").drop("__b", "__ghost")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, name: str = "k") -> DataFrame:
    """First ``k`` rows per group; the limit is applied inside every task before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)


def prevalence_table(spark) -> DataFrame:
    return dims.table(spark, [(p,) for p in dims.PREVALENCES], "prevalence")


def threshold_table(spark) -> DataFrame:
    return dims.table(spark, [(t,) for t in dims.net_benefit_grid()], "threshold")
