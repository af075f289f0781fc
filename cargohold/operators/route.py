"""Routing rows to branches and to several outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Branch = Callable[[DataFrame], DataFrame]


def partition(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Two complementary outputs. A NULL predicate counts as false, so no row is lost."""
    test = F.coalesce(predicate, F.lit(False))
    return df.filter(test), df.filter(~test)


def if_then_else(df: DataFrame, predicate: Column, then_branch: Branch, else_branch: Branch) -> DataFrame:
    """Send each row through one of two branches and merge the results. Works on streams as well.

    The input is evaluated once per branch; where the branches differ in columns only, a
    `when/otherwise` projection is cheaper.
    """
    yes, no = partition(df, predicate)
    return then_branch(yes).unionByName(else_branch(no))


def tee(df: DataFrame, sinks: list[Callable[[DataFrame], None]]) -> None:
    """Feed one batch result to several writers, computing it once."""
    shared = df.persist(StorageLevel.DISK_ONLY)
    try:
        for sink in sinks:
            sink(shared)
    finally:
        shared.unpersist()
