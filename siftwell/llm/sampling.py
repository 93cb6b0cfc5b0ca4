"""Bounded random samples of labelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_crc(id_col: str) -> Column:
    """crc32 of the id as text."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def sample_by_class(rows: DataFrame, class_col: str, id_col: str, per_class: int, seed: int = 1) -> DataFrame:
    """About ``per_class`` rows of each class (all, if there are fewer), chosen by a hash of the id.

    One count by class (partial aggregate), then a filter by a rate for each class: no sort, and no class meets in one task.
    """
    counts = dict(rows.groupBy(class_col).agg(F.count(F.lit(1))).collect())  # one row per class
    if not counts:
        return rows.limit(0)
    rate = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_class / n))))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11).cast("double") / F.lit(float(2**53))
    return rows.filter(unit < F.element_at(rate, F.col(class_col)))
