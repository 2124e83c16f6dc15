"""Column helpers: guarded arithmetic, clipping, decay, bet sizes, normal distribution."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

EULER = 0.5772156649015329


def safe_div(a: Column, b: Column, fill: float = 0.0) -> Column:
    """a / b, or fill where |b| <= 1e-8 or the quotient isn't finite."""
    q = F.try_divide(a, b)
    return F.when(F.abs(b) > 1e-8, F.when(F.isnan(q) | (F.abs(q) == float("inf")), F.lit(fill)).otherwise(q)).otherwise(F.lit(fill))


def clip(x: Column, low: float, high: float) -> Column:
    """x within low..high; null stays null (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def finite(x: Column) -> Column:
    """Null, NaN and infinities as 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def decay(bars_since: Column, scale: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + bars_since / F.lit(scale))


def bet_size(p: Column, method: str = "kelly", b: float = 1.0) -> Column:
    """kelly: p - (1 - p) / b in 0..1; tiered: 1 from .7, .5 from .55, else 0."""
    if method == "kelly":
        return clip(p - (F.lit(1.0) - p) / F.lit(b), 0.0, 1.0)
    if method == "tiered":
        return F.when(p >= 0.7, 1.0).when(p >= 0.55, 0.5).otherwise(0.0)
    raise ValueError("method: kelly or tiered")


def clean_number(x: Column) -> Column:
    """'1,234' as a double; null where it is no number."""
    return F.replace(x, F.lit(","), F.lit("")).try_cast("double")


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution by its power series about 0, whose terms are positive;
    arguments beyond 8 count as 8."""
    t = clip(z.cast("double"), -8.0, 8.0)
    start = F.struct(t.alias("term"), t.alias("total"))
    grow = lambda s, k: F.struct((s["term"] * t * t / (2 * k + 1)).alias("term"), (s["total"] + s["term"] * t * t / (2 * k + 1)).alias("total"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(200)), start, grow, lambda s: s["total"])
    return 0.5 + series * F.exp(-t * t / 2) / math.sqrt(2 * math.pi)


def psr_of(sharpe: Column, t: Column, skew: Column, kurtosis: Column, target: Column | float = 0.0, guard: float | None = None) -> Column:
    """Probabilistic Sharpe ratio of columns (kurtosis: not in excess); where the squared
    spread isn't positive, `guard`."""
    target = target if isinstance(target, Column) else F.lit(target)
    spread = 1 - skew * sharpe + sharpe * sharpe * (kurtosis - 1) / 4
    z = (sharpe - target) * F.sqrt(t - 1) / F.sqrt(F.greatest(spread, F.lit(1e-300)))
    return F.when(spread > 0, normal_cdf(z)).otherwise(F.lit(guard).cast("double"))


def expected_max(n: int) -> float:
    """Expected maximum of n standard normal draws."""
    z = NormalDist().inv_cdf
    return (1 - EULER) * z(1 - 1 / n) + EULER * z(1 - 1 / (n * math.e))


def expected_max_small(n: int) -> float:
    """The same with the quantile of 1 - 1 / (n + 1) below 5 draws, 0 below 2."""
    return 0.0 if n < 2 else NormalDist().inv_cdf(1 - 1 / (n + 1)) if n < 5 else expected_max(n)


def psr(sharpe: float, t: int, skew: float, kurtosis: float, target: float = 0.0) -> float:
    """Probabilistic Sharpe ratio (kurtosis: not in excess)."""
    spread = math.sqrt(1 - skew * sharpe + sharpe**2 * (kurtosis - 1) / 4)
    return NormalDist().cdf((sharpe - target) * math.sqrt(t - 1) / spread)


def dsr(sharpe: float, variance: float, n: int, t: int, skew: float, kurtosis: float) -> float:
    """Deflated Sharpe ratio: PSR against the expected maximum of n trials."""
    return psr(sharpe, t, skew, kurtosis, math.sqrt(variance) * expected_max(n))


def min_track_record(sharpe: float, skew: float, kurtosis: float, target: float = 0.0, alpha: float = 0.05) -> float:
    """Observations until the Sharpe ratio exceeds the target at this level."""
    return 1 + (1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2) * (NormalDist().inv_cdf(1 - alpha) / (sharpe - target)) ** 2


def min_backtest_length(n: int, sharpe: float = 1.0) -> float:
    """Years below which n skill-less trials reach this Sharpe ratio."""
    return (expected_max(n) / sharpe) ** 2
