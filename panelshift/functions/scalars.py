"""Column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_disease(c: Column | str) -> Column:
    """Upper case, without surrounding blanks, ':' read as '_'; NULL stays NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(F.upper(F.trim(c)), F.lit(":"), F.lit("_"))


def clean_target(c: Column | str) -> Column:
    """Upper case, without surrounding blanks and without a version ('.' and digits at the end)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.upper(F.trim(c)), r"\.[0-9]+$", "")


def is_finite(c: Column) -> Column:
    """False for NULL, NaN and infinities."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def affirmative(c: Column) -> Column:
    """Boolean spelled as text: 'true' in any letter case, or '1'; anything else, NULL too, is not."""
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1"), F.lit(False))


def ratio(numerator: Column, denominator: Column) -> Column:
    """NULL where the denominator is 0 or NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def when_chain(*cases: tuple[Column, object], otherwise: object = None) -> Column:
    chain = None
    for condition, value in cases:
        value = F.lit(value) if not isinstance(value, Column) else value
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))
