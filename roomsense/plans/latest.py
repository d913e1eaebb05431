"""Latest-row and last-N-per-key patterns.

``latest`` is an aggregate (``max_by`` of a struct ordered by (ts, id)), so the
map side keeps one candidate per key before the shuffle; a key holding a
third of all rows costs no more than any other.  ``last_n`` is a
``row_number() <= n`` filter, which Spark plans with a partial
``WindowGroupLimit`` below the shuffle for the same reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def order_key(ts: str = "ts", tie: str = "id"):
    return F.struct(F.col(ts), F.col(tie))


def latest(df: DataFrame, keys: Sequence[str], values: Sequence[str], ts: str = "ts", tie: str = "id",
           name: str = "r") -> DataFrame:
    row = F.struct(*[F.col(v) for v in values])
    if keys:
        return df.groupBy(*keys).agg(F.max_by(row, order_key(ts, tie)).alias(name))
    return df.agg(F.max_by(row, order_key(ts, tie)).alias(name))


def last_n(df: DataFrame, keys: Sequence[str], n: int, ts: str = "ts", tie: str = "id",
           rank: str = "recency", newest_first: bool = True) -> DataFrame:
    order = [F.col(ts).desc(), F.col(tie).desc()] if newest_first else [F.col(ts).asc(), F.col(tie).asc()]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
