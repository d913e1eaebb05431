"""Dimension joins with a checked broadcast.

A dimension (sectors, sensors, thresholds) is hinted for broadcast only after
a bounded count proves it holds at most ``DIM_ROW_BOUND`` rows (the count reads
at most bound+1 rows).  Beyond that, the join is left to the planner: a
sort-merge join on the key, which AQE may still turn into a broadcast join at
run time once the real shuffle size is known, and whose skewed partitions AQE
splits (``spark.sql.adaptive.skewJoin.enabled``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ~100 bytes per dimension row -> at most ~50 MB shipped to each executor.
DIM_ROW_BOUND = 500_000


def fits_broadcast(df: DataFrame, max_rows: int = DIM_ROW_BOUND) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def maybe_broadcast(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df
