"""roomsense — indoor-environment and occupancy analytics on Spark.

Every report is a lazy function ``f(tables, *, as_of=None, ...) -> DataFrame``
built from built-in Spark operators only; see README.md for the map from
report ids (Q01..Q22, I01..I12) to functions.
"""

from roomsense.tables import Tables

__all__ = ["Tables"]
