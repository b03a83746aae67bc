"""Missing-value rules: what counts as filled, and how comparisons treat null."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_filled(c: Column) -> Column:
    """Neither null nor the empty string."""
    return c.isNotNull() & (c != "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def null_if_shorter(c: Column, n: int) -> Column:
    """Null for values of fewer than ``n`` characters."""
    return F.when(F.char_length(c) >= n, c)


def not_in(c: Column, values: Iterable) -> Column:
    """Outside a literal list; a null is outside it as well."""
    return c.isNull() | ~c.isin(*values)


def in_list(c: Column, values: Iterable) -> Column:
    """Inside a literal list; never null."""
    return F.coalesce(c.isin(*values), F.lit(False))


def if_else(condition: Column, yes, no) -> Column:
    """Two-way choice that stays null where the condition is null."""
    as_column = [v if isinstance(v, Column) else F.lit(v) for v in (yes, no)]
    return F.when(condition, as_column[0]).when(~condition, as_column[1])


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def with_missing(c: Column) -> Column:
    """Text form in which a missing value prints as ``NA``."""
    return F.coalesce(c.cast("string"), F.lit("NA"))


def flag_label(flag: Column, yes: str, no: str) -> Column:
    """Label of a boolean that is never null."""
    return F.when(flag, F.lit(yes)).otherwise(F.lit(no))
