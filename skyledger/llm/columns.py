"""Working on a table whose columns may have any names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def on_plain_names(docs: DataFrame, work: Callable[..., DataFrame], *named: str) -> DataFrame:
    """``work(table, *columns)`` over ``docs`` with its columns renamed to what no step uses, and its result with the names of
    ``docs``: no column of the caller's can be taken for one of a step's, or lost to it. ``named`` are columns of ``docs``
    that ``work`` is told the new names of; its result must have all columns of the table.
    """
    plain = [f"column_{k}_of_docs" for k in range(len(docs.columns))]
    found = work(docs.toDF(*plain), *[plain[docs.columns.index(name)] for name in named])
    return found.select(*plain).toDF(*docs.columns)
