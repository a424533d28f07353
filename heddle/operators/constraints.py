"""Presence and domain constraints as checks and as filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import present


def violations(rows: DataFrame, required: tuple[str, ...] = (), domains: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Names of the constraints a row breaks; a null value breaks ``required`` but no domain."""
    checks = [F.when(~present(rows[c]), F.lit(f"{c} is required")) for c in required]
    checks += [F.when(~rows[c].isin(*allowed), F.lit(f"{c} is not an option")) for c, allowed in (domains or {}).items()]
    return F.array_compact(F.array(*checks))


def valid(rows: DataFrame, **constraints) -> DataFrame:
    return rows.filter(F.size(violations(rows, **constraints)) == 0)
