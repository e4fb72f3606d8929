"""Statistics scalar functions (F6, F8-F10, F12, F13) as Column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Effective genome sizes for the short genome codes.
GENOME_SIZES = {"hs": 2.7e9, "mm": 1.87e9, "ce": 9.0e7, "dm": 1.2e8}


def identity_pct(ident: Column, length: Column) -> Column:
    """100 * identities / length, 0 when length is 0."""
    return F.when(length == 0, F.lit(0.0)).otherwise(100.0 * ident / length.cast("double"))


def lgamma(x: Column) -> Column:
    """log Gamma(x) for x >= 1: exact log-sum below 10, Stirling series above."""
    x = x.cast("double")
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(x, F.lit(10.0)).cast("int") - 1, F.lit(1))),
                        F.lit(0.0), lambda acc, i: acc + F.log(i.cast("double")))
    big = ((x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi)
           + 1.0 / (12.0 * x) - 1.0 / (360.0 * F.pow(x, 3)) + 1.0 / (1260.0 * F.pow(x, 5)))
    return F.when(x < 10, small).otherwise(big)


def _logaddexp(a: Column, b: Column) -> Column:
    hi = F.greatest(a, b)
    return hi + F.log1p(F.exp(-F.abs(a - b)))


def _terms(sd: Column) -> Column:
    """How many terms of a tail count, from the one next to the bulk on: the
    rest is below 1e-30 of the first beyond twelve standard deviations."""
    return (F.lit(60) + F.ceil(F.lit(12.0) * sd)).cast("int")


def _tail(log_first: Column, log_ratio, count: Column) -> Column:
    """Log of the sum of ``count`` + 1 terms, the first given and the j-th
    (from 1) the one before times exp(log_ratio(j)); null ratios end it."""
    none = F.lit(float("-inf"))
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
        F.struct(log_first.alias("lt"), log_first.alias("ls")),
        lambda acc, j: (lambda lt: F.struct(lt.alias("lt"), F.when(lt == none, acc["ls"]).otherwise(_logaddexp(acc["ls"], lt)).alias("ls")))(
            acc["lt"] + F.coalesce(log_ratio(j), none)),
        lambda acc: acc["ls"])


def _log1mexp(ls: Column) -> Column:
    """log(1 - exp(ls)), -inf for ls >= 0."""
    return F.when(ls < 0, F.log1p(-F.exp(ls))).otherwise(F.lit(float("-inf")))


def log10_poisson_upper(n: Column, lam: Column) -> Column:
    """log10 P(X >= n), X ~ Poisson(lam), integer n of any size.

    For n > lam the upper tail is summed from n up, else the lower tail from
    n - 1 down and taken from 1, by term ratios in log space; either ends
    after some sqrt(lam) terms."""
    n, lam = n.cast("double"), lam.cast("double")
    loglam, count = F.log(lam), _terms(F.sqrt(lam))

    def log_term(k: Column) -> Column:
        return -lam + k * loglam - lgamma(k + 1)

    upper = _tail(log_term(n), lambda j: loglam - F.log(n + j), count)
    lower = _tail(log_term(n - 1), lambda j: F.when(n - j > 0, F.log(n - j) - loglam), count)
    via_cdf = F.log10(F.greatest(F.lit(0.0), 1.0 - F.exp(lower)))
    return (F.when(n <= 0, F.lit(0.0))
            .when(lam <= 0, F.lit(None).cast("double"))
            .when(n > lam, upper / math.log(10))
            .otherwise(via_cdf))


def poisson_upper(n: Column, lam: Column) -> Column:
    """P(X >= n) for X ~ Poisson(lam); 0 when lam <= 0 and n > 0."""
    lp = log10_poisson_upper(n, lam)
    return F.when(lp.isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(10.0), lp))


def binom_upper(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k), X ~ Binomial(n, p), n of any size: the tail away from the
    mean is summed by term ratios (n-j)/(j+1) * p/(1-p)."""
    k, n, p = k.cast("double"), n.cast("double"), p.cast("double")
    odds = F.log(p) - F.log1p(-p)
    count = _terms(F.sqrt(n * p * (1 - p)))

    def log_term(x: Column) -> Column:
        return lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * F.log(p) + (n - x) * F.log1p(-p)

    upper = _tail(log_term(k), lambda j: F.when(k + j <= n, F.log(n - k - j + 1) - F.log(k + j) + odds), count)
    lower = _tail(log_term(k - 1), lambda j: F.when(k - 1 - j >= 0, F.log(k - j) - F.log(n - k + j + 1) - odds), count)
    tail = F.when(k > n * p, F.exp(upper)).otherwise(F.exp(_log1mexp(lower)))
    return (F.when(k <= 0, F.lit(1.0)).when(k > n, F.lit(0.0))
            .when(p <= 0, F.lit(0.0)).when(p >= 1, F.lit(1.0))
            .otherwise(F.least(F.lit(1.0), tail)))


def hypergeom_upper(k: Column, draws: Column, successes: Column, total: Column) -> Column:
    """P(X >= k), X ~ Hypergeometric(total, successes, draws), of any size.

    t_{j+1}/t_j = (K-j)(n-j) / ((j+1)(N-K-n+j+1)); the tail away from the
    mean is summed as products of these ratios, some standard deviations of
    them, an array a row."""
    def one(k: float, nd: float, ns: float, nt: float) -> float:
        """The tail of one row."""
        if any(x != x for x in (k, nd, ns, nt)) or nt <= 0:
            return math.nan
        lo, hi, share = max(0.0, nd - (nt - ns)), min(nd, ns), ns / nt
        if k <= lo:
            return 1.0
        if k > hi:
            return 0.0

        def lchoose(a: float, b: float) -> float:
            return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

        sd = math.sqrt(max(0.0, nd * share * (1 - share) * (nt - nd) / max(nt - 1, 1.0)))
        count = 60 + math.ceil(12 * sd)
        upper = k > nd * share
        first = k if upper else k - 1
        x = first + np.arange(min(count, hi - first)) if upper else first - 1 - np.arange(min(count, first - lo))
        up = (ns - x) * (nd - x) / ((x + 1) * (nt - ns - nd + x + 1))
        terms = 1 + np.cumprod(up if upper else 1 / up).sum()
        log_first = lchoose(ns, first) + lchoose(nt - ns, nd - first) - lchoose(nt, nd)
        tail = math.exp(min(0.0, log_first + math.log(terms)))
        return tail if upper else 1 - tail

    @F.pandas_udf("double")
    def tails(k: pd.Series, nd: pd.Series, ns: pd.Series, nt: pd.Series) -> pd.Series:
        rows = zip(*(x.astype("float64") for x in (k, nd, ns, nt)), strict=True)
        found = pd.Series([one(*r) for r in rows], dtype="float64")
        return found.astype(object).where(found.notna(), None)

    return tails(*(c.cast("double") for c in (k, draws, successes, total)))


def match_mismatch_parameters(p: float) -> tuple[float, float]:
    """(lambda, K) of ungapped +1 / -1 scores when a chance pair matches with
    probability ``p`` < 1/2: lambda solves p e^l + (1-p) e^-l = 1."""
    return math.log((1 - p) / p), (1 - 2 * p) ** 2 / (1 - p)


def bit_score(raw: Column, lam: float, k: float) -> Column:
    """Karlin-Altschul bit score under the scoring whose lambda and K are given."""
    return (F.lit(lam) * raw - F.lit(math.log(k))) / F.lit(math.log(2.0))


def e_value(raw: Column, m: Column, n: Column, lam: float, k: float) -> Column:
    """E = K m n exp(-lambda S)."""
    return F.lit(k) * m.cast("double") * n.cast("double") * F.exp(-F.lit(lam) * raw)


def copy_number(log2: Column, ploidy: int = 2) -> Column:
    """Integer copy number round(ploidy * 2^log2)."""
    return F.round(F.lit(float(ploidy)) * F.pow(F.lit(2.0), log2)).cast("int")


def effective_genome_size(code: Column) -> Column:
    """'hs' / 'mm' / 'ce' / 'dm' or a number such as '1e9'."""
    out = code.try_cast("double")
    for name, size in GENOME_SIZES.items():
        out = F.when(code == name, F.lit(size)).otherwise(out)
    return out
