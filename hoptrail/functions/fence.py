"""A fence that keeps the optimizer from copying a costly expression upwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fenced(col: Column) -> Column:
    """The same value; filters above are not pushed through its projection.

    ``spark_partition_id`` is never negative, but not deterministic to the optimizer. A pushed filter is rewritten in terms of the columns below, so that nested
    array expressions are copied once for every reference, level by level.
    """
    return F.when(F.spark_partition_id() < 0, None).otherwise(col)
