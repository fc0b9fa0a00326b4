"""Column expressions shared by the operators. All are built-in Spark SQL functions."""

from ratewright.functions.hashing import order_hash, row_hash
from ratewright.functions.metrics import ratio, rmse

__all__ = ["order_hash", "ratio", "rmse", "row_hash"]
