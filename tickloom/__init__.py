"""Market features and trading signals as Spark DataFrame transformations."""

from tickloom.operators.series import Series, SeriesLayout, plan_series

__all__ = ["Series", "SeriesLayout", "plan_series"]
