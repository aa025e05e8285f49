"""Sample, rounding and level expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def timestamp_to_sample(seconds: Column, rate: int, total: Column | int, rounding: str) -> Column:
    """Sample of a time: snapped when within 1e-6 of one, else floor, ceil or nearest (ties to even); clamped to [0, total]."""
    x = seconds * rate
    near = F.rint(x)
    other = {"floor": F.floor(x).cast("double"), "ceil": F.ceil(x).cast("double"), "nearest": near}[rounding]
    at = F.when(F.abs(x - near) <= 1e-6, near).otherwise(other).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(at, total if isinstance(total, Column) else F.lit(total).cast("long")))


def seconds_to_sample(seconds: Column, rate: int, boundary: str) -> Column:
    """Unclamped sample of a time with a 1e-9 guard: floor, ceil or nearest (ties to even)."""
    x = seconds * rate
    return {"floor": F.floor(x + 1e-9), "ceil": F.ceil(x - 1e-9), "nearest": F.rint(x)}[boundary].cast("long")


def frame_to_sample(index: Column, rate: int, round_up: bool) -> Column:
    """Sample of a frame at 100 a second, by whole-number floor or ceiling."""
    scaled = index.cast("long") * rate
    return F.floor((scaled + (99 if round_up else 0)) / 100).cast("long")


def finite_or(value: Column, fallback: float) -> Column:
    """A string as a finite number, or the fallback."""
    x = value.try_cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(fallback)).otherwise(x)


def ratio(value: Column) -> Column:
    """A rate such as 30000/1001 or 25; null if it is not a positive number."""
    parts = F.split(value, "/")
    x = F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).try_cast("double"))
    return F.when(x > 0, x)


def db(amplitude: Column, floor: float) -> Column:
    """Decibels of an amplitude, not below a floor."""
    return 20 * F.log10(F.greatest(amplitude, F.lit(floor)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rms(samples: Column) -> Column:
    n = F.size(samples)
    return F.when(n > 0, F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x) / n))


def linear_gain(n: Column, rising: bool = True) -> Column:
    """``n`` gains from 0 to 1 (or back), both ends included."""
    step = lambda i: F.when(n == 1, F.lit(0.0)).otherwise(i / (n - 1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: step(i) if rising else 1 - step(i))


def equal_power_gain(n: Column, rising: bool = True) -> Column:
    """``n`` gains along a quarter of a sine (or cosine), both ends included."""
    turn = lambda i: F.when(n == 1, F.lit(0.0)).otherwise(i / (n - 1)) * (3.141592653589793 / 2)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.sin(turn(i)) if rising else F.cos(turn(i)))


def softmax(row: Column) -> Column:
    """A row as it is when it already is a distribution, else its softmax."""
    top = F.array_max(row)
    e = F.transform(row, lambda x: F.exp(x - top))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    given = F.forall(row, lambda x: (x >= 0) & (x <= 1)) & (F.abs(total(row) - 1) <= 1e-3)
    return F.when(given, row).otherwise(F.transform(e, lambda x: x / total(e)))


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns as JSON in the order given."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
