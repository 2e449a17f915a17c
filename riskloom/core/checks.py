"""Checks of names and of data that functions make before they plan anything."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def col(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_names(value: str | Sequence[str] | None, label: str, required: bool = False) -> list[str]:
    """One name or several as a list without duplicates."""
    found = [] if value is None else [value] if isinstance(value, str) else list(value)
    if not all(isinstance(x, str) for x in found):
        raise TypeError(f"{label} must be a column name or a sequence of column names")
    if len(set(found)) != len(found):
        raise ValueError(f"{label} has duplicate names")
    if required and not found:
        raise ValueError(f"{label} must have at least one name")
    return found


def require_columns(df: DataFrame, wanted: Iterable[str]) -> None:
    if not isinstance(df, DataFrame):
        raise TypeError("a Spark DataFrame is required")
    if missing := sorted(set(wanted) - set(df.columns)):
        raise KeyError(f"missing columns: {', '.join(missing)}")


def require_tiles(n_tiles: int, least: int = 2) -> None:
    if isinstance(n_tiles, bool) or not isinstance(n_tiles, int):
        raise TypeError("n_tiles must be an integer")
    if n_tiles < least:
        raise ValueError(f"n_tiles must be at least {least}")


def require_numeric(df: DataFrame, columns: Iterable[str]) -> None:
    if wrong := [c for c in columns if not isinstance(df.schema[c].dataType, NumericType)]:
        raise ValueError(f"columns must be numeric: {', '.join(wrong)}")


def present(value: Column) -> Column:
    """Neither null nor NaN."""
    return value.isNotNull() & ~F.isnan(value)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom; null where the bottom is null, NaN or zero (also under ANSI mode)."""
    return top / F.when((bottom != 0) & ~F.isnan(bottom), bottom)


def reject(df: DataFrame, faults: dict[str, Column]) -> None:
    """Raises ValueError with the first message whose condition holds in any row; one job checks all."""
    if not faults:
        return
    seen = df.agg(*[F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(f"f{i}") for i, c in enumerate(faults.values())]).first()
    for message, hit in zip(faults, seen, strict=True):
        if hit:
            raise ValueError(message)


def binary_fault(name: str) -> dict[str, Column]:
    value = col(name).cast("double")
    return {f"target column {name!r} must hold only 0 and 1": present(value) & ~value.isin(0.0, 1.0)}
