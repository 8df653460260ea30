"""Blocks of time, which split the rows of one key so that no task must order all of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def block_of(time: Column, kind: T.DataType, width: int) -> Column:
    """The block of ``time``: of ``width`` days for times and dates, of ``width`` units for numbers; it rises with time."""
    if isinstance(kind, T.NumericType):
        return F.floor(time / width)
    return F.floor(F.unix_date(time.cast("date")) / width)
