"""Rounding, prices, business signals, bucketing and the normal distribution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, places: int = 0) -> Column:
    """Rounded to places, halves towards plus infinity."""
    k = 10.0**places
    return F.floor(value * k + 0.5) / k


def rate(part: Column, whole: Column) -> Column:
    """Per cent to one place; 0 where there is no whole."""
    return F.when(whole > 0, half_up(100.0 * part / whole, 1)).otherwise(0.0)


def effective_price(price: Column, sale: Column) -> Column:
    return F.when(sale > 0, sale).otherwise(price)


def discount_pct(price: Column, sale: Column) -> Column:
    return F.when((sale > 0) & (price > 0) & (sale < price), half_up((price - sale) / price * 100)).otherwise(0.0)


def log_share(value: Column, ceiling: float) -> Column:
    """log(1 + value) as a share of that of the ceiling, within 0..1; 0 for what is not positive."""
    share = F.log1p(F.greatest(value, F.lit(0.0))) / F.log1p(F.lit(float(ceiling)))
    return F.when(value > 0, F.least(share, F.lit(1.0))).otherwise(0.0)


def clamp01(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def recency(added: Column, as_of: Column, half_life_days: float = 180.0) -> Column:
    """1 for what was added now, halved every half_life_days; 0 without a date."""
    days = F.greatest((F.unix_timestamp(as_of) - F.unix_timestamp(added)) / 86400.0, F.lit(0.0))
    return F.when(added.isNull(), 0.0).otherwise(F.pow(F.lit(0.5), days / half_life_days))


MASK = 0xFFFFFFFF


def _times(h: Column, factor: int) -> Column:
    """h * factor modulo 2**32, in halves: the product of 64-bit numbers would overflow."""
    low = h.bitwiseAND(F.lit(0xFFFF)) * F.lit(factor)
    high = F.shiftright(h, 16) * F.lit(factor)
    return (low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(MASK))


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def hash32(key: Column) -> Column:
    """FNV-1a over the characters, then the finaliser of MurmurHash3, as an unsigned 32-bit number. Same arm for a session on every executor and run."""
    chars = F.filter(F.split(key, ""), lambda c: c != "")
    h = F.aggregate(chars, F.lit(0x811C9DC5).cast("long"), lambda s, c: _times(s.bitwiseXOR(F.ascii(c).cast("long")), 0x01000193))
    h = _let(h, lambda x: x.bitwiseXOR(F.shiftright(x, 16)))
    h = _let(h, lambda x: _times(x, 0x85EBCA6B))
    h = _let(h, lambda x: x.bitwiseXOR(F.shiftright(x, 13)))
    h = _let(h, lambda x: _times(x, 0xC2B2AE35))
    return _let(h, lambda x: x.bitwiseXOR(F.shiftright(x, 16)))


def bucket_of(experiment: Column, session: Column) -> Column:
    return hash32(F.concat_ws(":", experiment.cast("string"), session)) % 100


# Coefficients of the polynomial 26.2.17 of Abramowitz and Stegun.
NORMAL = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]


def normal_cdf(z: Column) -> Column:
    t = 1.0 / (1.0 + 0.2316419 * F.abs(z))
    poly = F.lit(0.0)
    for c in reversed(NORMAL):
        poly = t * (F.lit(c) + poly)
    tail = 0.3989422804014327 * F.exp(-z * z / 2) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)
