"""Column functions whose results do not depend on the order of the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(value: Column, kind: str = "decimal(12,2)") -> Column:
    """The sum of a double that holds decimals of ``kind``, as a double. Nulls are skipped; no rows give null."""
    return F.sum(value.cast(kind)).cast("double")


def population_variance(value: Column) -> Column:
    """The population variance of whole numbers, from exact sums. Nulls are skipped; no rows give null."""
    whole = value.cast("long")
    n, once, twice = F.count(whole), F.sum(whole), F.sum(whole * whole)
    return F.when(n > 0, (n * twice - once * once) / (n * n).cast("double"))


def words(text: Column) -> Column:
    """The words of a text, parted by runs of white space; an empty or null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda w: w != "")


def histogram(values: Column) -> Column:
    """A map from each distinct value of an array to how often it stands there."""
    return F.map_from_entries(F.transform(F.array_distinct(values), lambda v: F.struct(v, F.size(F.filter(values, lambda x: x == v)).alias("n"))))
