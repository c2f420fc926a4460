"""Date columns: the 14-day grid, forecast dates, seasons and calendar features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.functions.columns import col
from phenogrid.schema import FORECAST_HORIZON, GRID_EPOCH, LEAD, STEP_DAYS


def snap_to_grid(d, epoch: str = GRID_EPOCH) -> Column:
    """Latest grid date at or before ``d`` (also for dates before the epoch)."""
    offset = F.pmod(F.datediff(col(d), F.lit(epoch).cast("date")), F.lit(STEP_DAYS))
    return F.date_sub(col(d), offset.cast("int"))


def resolve_forecast_dates(df: DataFrame, date_str: str, today: str, lead: int = LEAD,
                           epoch: str = GRID_EPOCH) -> DataFrame:
    """Add ``as_of``, ``anchor``, ``target`` and ``date_status`` for a text date.

    A missing date means today; a text that is no date or lies in the future keeps its row
    with a status and NULL dates.
    """
    text = F.col(date_str)
    today_d = F.lit(today).cast("date")
    parsed = F.when(text.isNull() | (text == ""), today_d).otherwise(
        F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("date")))
    df = df.withColumn("_d", parsed)
    status = F.when(F.col("_d").isNull(), "INVALID_DATE").when(F.col("_d") > today_d, "FUTURE_DATE").otherwise("OK")
    df = df.withColumn("date_status", status).withColumn("as_of", F.when(F.col("date_status") == "OK", F.col("_d")))
    df = df.withColumn("anchor", snap_to_grid("as_of", epoch))
    return df.withColumn("target", F.date_add("anchor", lead * STEP_DAYS)).drop("_d")


def quarter_label(d) -> Column:
    return F.concat(F.lit("Q"), F.quarter(col(d)).cast("string"))


def quarter_bounds(d) -> tuple[Column, Column]:
    """[start, end) of the quarter of ``d``."""
    start = F.trunc(col(d), "quarter")
    return start, F.add_months(start, 3)


def half_year_label(d) -> Column:
    return F.when(F.month(col(d)) <= 6, "H1").otherwise("H2")


def period_label(d, mode: str) -> Column:
    return {"annual": F.lit("ANNUAL"), "halfyear": half_year_label(d), "quarterly": quarter_label(d)}[mode]


def calendar_features(df: DataFrame, d: str = "date") -> DataFrame:
    m = F.month(d)
    return df.withColumns({
        "year": F.year(d), "month": m, "day_of_year": F.dayofyear(d), "quarter": F.quarter(d),
        "season": F.when(m.isin(12, 1, 2), 1).when(m.isin(3, 4, 5), 2).when(m.isin(6, 7, 8), 3).otherwise(4),
    })


def cyclic_features(df: DataFrame) -> DataFrame:
    tau = 2 * F.pi()
    return df.withColumns({
        "month_sin": F.sin(tau * F.col("month") / 12), "month_cos": F.cos(tau * F.col("month") / 12),
        "doy_sin": F.sin(tau * F.col("day_of_year") / 365), "doy_cos": F.cos(tau * F.col("day_of_year") / 365),
    })


def days_since_start(df: DataFrame, d: str = "date") -> DataFrame:
    """Days since the earliest date of the whole frame (one-row aggregate, broadcast)."""
    start = df.agg(F.min(d).alias("_start"))
    return df.crossJoin(F.broadcast(start)).withColumn("days_since_start", F.datediff(d, "_start")).drop("_start")


def add_time_features(df: DataFrame, d: str = "date") -> DataFrame:
    return days_since_start(cyclic_features(calendar_features(df, d)), d)


def fetch_plan(df: DataFrame, target: str, today: str, years: int = 10, lead: int = LEAD) -> DataFrame:
    """Days ahead, mode, cutoff, anchor and number of steps to read for a target date."""
    today_d = F.lit(today).cast("date")
    total = years * 26 + FORECAST_HORIZON
    df = df.withColumn("days_ahead", F.datediff(F.col(target), today_d))
    ahead = F.col("days_ahead")
    return df.withColumns({
        "mode": F.when(ahead <= 0, "historical").when(ahead <= 98, "near_future").otherwise("far_future"),
        "data_cutoff": F.date_sub(F.col(target), lead * STEP_DAYS),
        "fetch_anchor": F.when(ahead <= 0, F.col(target)).otherwise(today_d),
        "fetch_steps": F.when(ahead <= 0, total).otherwise(
            F.greatest(total - F.floor(ahead / STEP_DAYS), F.lit(1))).cast("int"),
    })
