"""Scalar rules of scores, bands and baselines, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6
BANDS = (("Critical", 80.0), ("High", 60.0))
MODERATE_ABOVE = 30.0
ALERT_BANDS = ("High", "Critical")
CORROBORATION = 40.0
MIN_SPREAD = 0.10
P99_CAP, P50_CAP_SPREAD = 5.0, 0.25
DRIFT = 0.5


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def normalise(v: Column, p50, p99) -> Column:
    """Where ``v`` lies between the baselines, cut to 0..1; 0 where they don't spread."""
    p50, p99 = _c(p50), _c(p99)
    return F.when(p99 <= p50, 0.0).otherwise(F.least(F.greatest((v - p50) / (p99 - p50 + EPSILON), F.lit(0.0)), F.lit(1.0)))


def normalise_inverted(v: Column, p50, p99) -> Column:
    """1 less ``normalise``; 0 where the baselines don't spread."""
    return F.when(_c(p99) <= _c(p50), 0.0).otherwise(1.0 - normalise(v, p50, p99))


def band(score: Column, bands: Sequence[tuple[str, float]] = BANDS, moderate_above: float = MODERATE_ABOVE) -> Column:
    out = F
    for name, least in bands:
        out = out.when(score >= least, name)
    return out.when(score > moderate_above, "Moderate").otherwise("Informational")


def finalise(raw: Column) -> Column:
    """0..1 to 0..100 with two digits, ties to even."""
    return F.bround(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)) * 100, 2)


def usable(p50: Column, p99: Column, spread: float = MIN_SPREAD) -> Column:
    """Whether a baseline tells anything."""
    return F.when(p50 <= 0, p99 > 0).otherwise((p99 - p50) / p50 >= spread)


def capped(p50: Column, p99: Column, anchor50: Column, anchor99: Column) -> tuple[Column, Column]:
    """A learned baseline held near its anchors, so that poisoned history can't raise it without bound."""
    top = F.least(p99, P99_CAP * anchor99)
    low = F.least(p50, F.least(anchor50 + P50_CAP_SPREAD * (anchor99 - anchor50), top / (1 + MIN_SPREAD)))
    return low, top


def drift(old: Column, new: Column) -> Column:
    return F.abs(new - old) / (F.abs(old) + 1e-9)


def held(old50: Column, new50: Column, old99: Column, new99: Column, both_ways: bool = False) -> Column:
    """Whether a new baseline is held back: it moved much in the direction that hides attacks."""
    p99 = (drift(old99, new99) > DRIFT) & (old99 > 0)
    p50 = drift(old50, new50) > DRIFT
    return (p99 | p50) if both_ways else (p99 & (new99 > old99)) | (p50 & (new50 > old50))


def first_max(scores: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """The largest score and its class; of equal ones the first. Null and negative scores (gate failed) don't count."""
    real = [(n, F.when(c >= 0, c)) for n, c in scores]
    top = F.greatest(*[c for _, c in real]) if len(real) > 1 else real[0][1]
    name = F
    for n, c in real:
        name = name.when(c == top, n)
    return top, name.otherwise(F.lit(None))


def corroborating(scores: Sequence[tuple[str, Column]], least: float = CORROBORATION) -> tuple[Column, Column]:
    """How many classes reach ``least``, and their names sorted and joined by commas."""
    names = F.filter(F.array(*[F.when(c >= least, F.lit(n)) for n, c in scores]), lambda x: x.isNotNull())
    return F.size(names), F.array_join(F.sort_array(names), ",")


def verdict_score(verdict: Column, consensus: Column) -> Column:
    """A clustering verdict as a score."""
    return F.when(verdict == "malicious", F.greatest(F.lit(80.0), consensus * 100)).when(verdict == "anomaly", consensus * 59).otherwise(0.0)


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def cyclical(x: Column, period: int) -> tuple[Column, Column]:
    angle = x * (2 * 3.141592653589793 / period)
    return F.sin(angle), F.cos(angle)


def csv_safe(x: Column) -> Column:
    """A cell that a spreadsheet doesn't take for a formula."""
    return F.when(F.regexp_like(x, F.lit(r"^[=+\-@\t\r]")), F.concat(F.lit("'"), x)).otherwise(x)


def refit(drift: Column, coverage: Column, due: Column) -> Column:
    """Whether a model is fitted anew: never with little coverage, else where it drifts and its last fit is long enough ago."""
    return F.when(coverage < 0.6, "wait").when((drift >= 0.25) & due, "refit").otherwise("keep")
