"""Column functions: divergences, similarities, folds over series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 8


def rounded(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, DIGITS)


def plogq(p: Column, q: Column) -> Column:
    """p log2(p/q), 0 for p = 0."""
    return F.when(p > 0, p * F.log2(p / F.when(q > 0, q))).otherwise(F.lit(0.0))


def jsd_term(p: Column, q: Column) -> Column:
    """A topic's part of the Jensen-Shannon divergence (base 2); the parts are not negative and sum to it."""
    m = (p + q) / 2
    return (plogq(p, m) + plogq(q, m)) / 2


def empirical_logit(n: Column, total: Column) -> Column:
    return F.ln((n + 0.5) / (total - n + 0.5))


def logit_variance(n: Column, total: Column) -> Column:
    return F.lit(1.0) / (n + 0.5) + F.lit(1.0) / (total - n + 0.5)


def kalman_fold(series: Column, m0: Column, p0: Column, q: float) -> Column:
    """Local-level filter over series (array of struct(t, y, r), in order): struct(m, p, s, e), where s and e are the last
    one-step variance and error."""
    start = F.struct(m0.cast("double").alias("m"), p0.cast("double").alias("p"), F.lit(0.0).alias("s"), F.lit(0.0).alias("e"))

    def step(a: Column, x: Column) -> Column:
        prior = a["p"] + F.lit(q)
        s = prior + x["r"]
        gain = prior / s
        e = x["y"] - a["m"]
        return F.struct((a["m"] + gain * e).alias("m"), ((F.lit(1.0) - gain) * prior).alias("p"), s.alias("s"), e.alias("e"))

    return F.aggregate(series, start, step)


def bocpd_fold(series: Column, hazard: float, mu0: Column, v0: float, most: int) -> Column:
    """Bayesian online changepoint detection (constant hazard, Gaussian with known variance) over series (array of
    struct(t, y, r)): struct(p, m, v), arrays by run length from 0; the last one, `most`, holds the mass of all runs as long or longer,
    with the means of their m and v by mass."""
    start = F.struct(F.array(F.lit(1.0)).alias("p"), F.array(mu0.cast("double")).alias("m"), F.array(F.lit(v0)).alias("v"))

    def step(a: Column, x: Column) -> Column:
        # Joint mass of each run length and the observation, by its predictive density.
        joint = F.zip_with(
            a["p"], F.arrays_zip(a["m"].alias("m"), a["v"].alias("v")),
            lambda p, mv: p * F.exp(-((x["y"] - mv["m"]) * (x["y"] - mv["m"])) / (2 * (mv["v"] + x["r"]))) / F.sqrt(2 * F.lit(3.141592653589793) * (mv["v"] + x["r"])),
        )
        total = F.aggregate(joint, F.lit(0.0), lambda s, j: s + j)
        grown = F.concat(F.array(F.lit(hazard)), F.transform(joint, lambda j: F.lit(1 - hazard) * j / total))
        means = F.concat(F.array(mu0.cast("double")), F.zip_with(a["m"], a["v"], lambda m, v: (m * x["r"] + x["y"] * v) / (v + x["r"])))
        variances = F.concat(F.array(F.lit(v0)), F.transform(a["v"], lambda v: v * x["r"] / (v + x["r"])))
        return F.element_at(F.transform(F.array(F.struct(grown.alias("p"), means.alias("m"), variances.alias("v"))), held), 1)

    def held(a: Column) -> Column:
        """At most `most` + 1 run lengths: what is over joins the last."""
        one, two = (F.element_at(a["p"], F.lit(k)) for k in (-2, -1))
        mean = lambda x: F.when(one + two > 0, (one * F.element_at(x, -2) + two * F.element_at(x, -1)) / (one + two)).otherwise(F.element_at(x, -2))
        joined = F.struct(*(F.concat(F.slice(a[k], 1, most), F.array(last)).alias(k) for k, last in (("p", one + two), ("m", mean(a["m"])), ("v", mean(a["v"])))))
        return F.when(F.size(a["p"]) > most + 1, joined).otherwise(a)

    return F.aggregate(series, start, step)
