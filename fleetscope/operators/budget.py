"""Monthly spend against a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope import fixed_values as fv


def budget_alerts(costs: DataFrame, limit_usd: str = fv.BUDGET_LIMIT_USD) -> DataFrame:
    """Spend and forecast per month, with both alerts (strictly above their share).

    ``costs``: ts, amount DECIMAL(18,2). The forecast is the run rate of the
    month up to its last day with costs, times the days of the month.
    """
    limit = F.lit(limit_usd).cast("decimal(18,2)").cast("double")
    monthly = costs.groupBy(F.trunc("ts", "MM").alias("month")).agg(
        F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("actual"),
        F.dayofmonth(F.max("ts")).alias("_days"),
    )
    forecast = F.col("actual") / F.col("_days") * F.dayofmonth(F.last_day("month"))
    return monthly.select(
        "month",
        "actual",
        forecast.alias("forecast"),
        (F.col("actual") > limit * fv.BUDGET_ACTUAL_PERCENT / 100).alias("actual_alert"),
        (forecast > limit * fv.BUDGET_FORECAST_PERCENT / 100).alias("forecast_alert"),
    )
