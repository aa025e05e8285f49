"""Validators: every rule's violations are rows, so an empty result means valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: dict[str, Column], ident: list[str]) -> DataFrame:
    """(rule, ident) of every broken rule, in one pass; a rule that is null does not hold against a row."""
    broken = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())
    return df.select(*ident, F.explode(broken).alias("rule")).select("rule", *ident)


def exact_keys(doc: Column, keys: list[str]) -> Column:
    """Whether a JSON object has just these keys."""
    return F.array_sort(F.json_object_keys(doc)) == F.array(*[F.lit(k) for k in sorted(keys)])


def unit_interval(row: Column) -> Column:
    """Whether all numbers of an array are finite and in [0, 1]."""
    return F.forall(row, lambda x: (x >= 0) & (x <= 1) & ~F.isnan(x))


def is_current(now: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, is_current): the saved hash exists and equals the present one."""
    return now.join(saved, keys, "left").select(*keys, F.coalesce(F.col("now") == F.col("saved"), F.lit(False)).alias("is_current"))


def require_empty(violations: DataFrame, what: str) -> None:
    """Fail closed: raise with the first violation, if there is one."""
    first = violations.limit(1).collect()
    if first:
        raise ValueError(f"{what}: {first[0].asDict()}")
