"""Column expressions with the semantics of form values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def checked(value: Column) -> Column:
    """True only for true; false, undetermined and null are false."""
    return value.eqNullSafe(F.lit(True))


def present(value: Column) -> Column:
    """Whether a required text field is filled in."""
    return F.coalesce(value != "", F.lit(False))


def include(*pairs: tuple[Column, Column]) -> Column:
    """The values whose condition holds; those whose condition does not are left out, not null."""
    return F.array_compact(F.array(*[F.when(condition, value) for condition, value in pairs]))
