"""Ranking expressions: payload scorers and the crawl-time boosts of a document (SCR2-SCR13, FN14, CRW11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR = 3_600_000
#: Bounds in hours and boosts of the date scorer (fixed values).
DATE_STEPS = ((1, 100), (2, 60), (12, 40), (24, 30), (48, 20), (168, 10), (720, 5))


def valid_boost(b: Column) -> Column:
    return ~F.isnan(b) & (b > 0) & (b < float("inf"))


def date_boost(ms: Column, now: Column) -> Column:
    gap = F.abs(now - ms)
    out = F.lit(1.0)
    for hours, boost in reversed(DATE_STEPS):
        out = F.when(gap < hours * HOUR, F.lit(float(boost))).otherwise(out)
    return out


def short_date_boost(yyyymmdd: Column, today: Column, weight: float, damp: float) -> Column:
    """1 + weight * damp / (days + damp), days between the payload's date and today."""
    days = F.abs(F.datediff(today, F.to_date(yyyymmdd.cast("string"), "yyyyMMdd"))).cast("double")
    days = F.when(days + damp == 0, days + 0.1).otherwise(days)
    return 1 + weight * damp / (days + damp)


def scalar_boost(v: Column, weight: float, most: float) -> Column:
    return F.lit(1.0) if most <= 0 else 1 + weight * F.least(v.cast("double"), F.lit(float(most))) / most


def damp_steps(weight: float) -> int:
    """Square roots to take: int(10 * (1 - weight)), the difference in single precision."""
    import numpy as np

    return int(10 * float(np.float32(1) - np.float32(weight)))


def damped(v: Column, weight: float) -> Column:
    """Value within [0.01, 15], its square root taken ``damp_steps`` times; ten or more leave 1."""
    k = damp_steps(weight)
    return F.lit(1.0) if k >= 10 else F.pow(F.least(F.greatest(v, F.lit(0.01)), F.lit(15.0)), F.lit(2.0**-k))


def deciles(df: DataFrame, value: Column, name: str) -> DataFrame:
    """One row: the eleven decile bounds of a value, exact."""
    return df.agg(F.percentile(value, F.array(*[F.lit(k / 10) for k in range(11)])).alias(name))


def decile_bucket(v: Column, bounds: Column) -> Column:
    """Bucket 0 to 10 of a value among the bounds, interpolated inside a bucket; 0.1 at least below the last bound."""
    n = F.size(F.filter(bounds, lambda b: b <= v))
    low, high = F.element_at(bounds, F.greatest(n, F.lit(1))), F.element_at(bounds, F.least(n + 1, F.lit(11)))
    inside = F.when(high > low, (v - low) / (high - low)).otherwise(0.0)
    raw = F.greatest(n - 1, F.lit(0)).cast("double") + F.when(n >= 1, inside).otherwise(0.0)
    return F.when(n >= 11, F.lit(10.0)).otherwise(F.greatest(raw, F.lit(0.1)))


def spam_boost(anti: Column, bounds: Column) -> Column:
    flat = F.element_at(bounds, 1) == F.element_at(bounds, 11)
    return F.when(flat, F.lit(1.0)).otherwise(F.greatest((10 - decile_bucket(anti, bounds)) / 10, F.lit(0.01)))


def log_boost(inlinks: Column) -> Column:
    return F.when(inlinks > 1, F.ln(inlinks.cast("double"))).otherwise(0.1)


def freshness_boost(days: Column, w: float = 10.0, d: float = 15.0) -> Column:
    return 1 + w * d / (F.greatest(days, F.lit(1)) + d)


def document_boost(factors: list[Column]) -> Column:
    out = factors[0]
    for f in factors[1:]:
        out = out * f
    return F.greatest(out, F.lit(1e-6))


def time_attributes(ms: Column, prefix: str) -> list[Column]:
    """Day, hour and minute of milliseconds, by whole divisions, and the milliseconds (FN14)."""
    return [F.floor(ms / 86_400_000).alias(f"{prefix}_day"), F.floor(ms / HOUR).alias(f"{prefix}_hour"), F.floor(ms / 60_000).alias(f"{prefix}_minute"), ms.alias(f"{prefix}_long")]


def priority(now: Column, success: Column, change: Column, attempt: Column) -> Column:
    """Recrawl priority (CRW11)."""
    since = now - success
    dead = since - (now - attempt)
    static = F.greatest((now - change) - since, dead)
    return (since - 0.4 * static - 2 * dead) / 10000.0
