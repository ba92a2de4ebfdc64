"""Fixpoints by rounds that write only what changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanemesh.lineage import cut

#: Tables of rounds that are read side by side before they are folded into one.
MOST_TABLES = 16


def lowest(start: DataFrame, columns: list[str], value: str, offers: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """columns and the least `value` that start or any round offers for them.

    offers(frontier, state) gives the rows (columns, value) that follow from the rows that fell in the latest round; state may hold a key several times, its least value counts. A round writes the rows that fell, not the whole state; every MOST_TABLES rounds these are folded into one table."""
    least = F.min(value).alias(value)
    frontier = state = cut(start.groupBy(*columns).agg(least))
    tables = 1
    while frontier.first() is not None:
        offered = offers(frontier, state).groupBy(*columns).agg(F.min(value).alias("new_"))
        old = state.join(offered.select(*columns), columns, "left_semi").groupBy(*columns).agg(least)
        fell = offered.join(old, columns, "left").where(F.col(value).isNull() | (F.col("new_") < F.col(value)))
        frontier = cut(fell.select(*columns, F.col("new_").alias(value)))
        state, tables = state.union(frontier), tables + 1
        if tables == MOST_TABLES:
            state, tables = cut(state.groupBy(*columns).agg(least)), 1
    return cut(state.groupBy(*columns).agg(least))
