"""Named row filters over a catalog of recordings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Preset = Sequence[Column]


def equals(column: str, value: str) -> Column:
    return F.col(column) == value


def one_of(column: str, values: Sequence[str]) -> Column:
    return F.col(column).isin(list(values))


def contains_any(column: str, parts: Sequence[str]) -> Column:
    """Whether any of the parts is in the column; null holds none. The parts are one constant array, however many."""
    text = F.coalesce(F.col(column), F.lit(""))
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(text, p)) if parts else F.lit(False)


def apply_preset(df: DataFrame, presets: Mapping[str, Preset], name: str | None) -> DataFrame:
    """The rows that meet every condition of a preset; all rows without a name. An unknown name is an error."""
    if name is None:
        return df
    if name not in presets:
        raise ValueError(f"no preset {name!r}; there are {', '.join(sorted(presets))}")
    return df.filter(reduce(lambda a, b: a & b, presets[name], F.lit(True)))
