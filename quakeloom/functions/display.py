"""Display text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quakeloom.fixed_values import DASH, NO_DATE


def fixed_decimals(column: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", column.cast("double"))


def format_date_pt(column: Column, include_time: bool = False) -> Column:
    pattern = "dd/MM/yyyy HH:mm 'UTC'" if include_time else "dd/MM/yyyy"
    return F.coalesce(F.date_format(column, pattern), F.lit(DASH))


def format_percentage(column: Column, decimals: int = 1) -> Column:
    value = column.try_cast("double")
    return F.when(value.isNull(), F.lit(DASH)).otherwise(
        F.concat(fixed_decimals(value * 100, decimals), F.lit("%"))
    )


def format_number(column: Column, decimals: int = 1, suffix: str = "") -> Column:
    value = column.try_cast("double")
    return F.when(value.isNull(), F.lit(DASH)).otherwise(
        F.concat(fixed_decimals(value, decimals), F.lit(suffix))
    )


def format_boolean_pt(column: Column) -> Column:
    return F.when(column.isNull(), F.lit(DASH)).when(column, "Sim").otherwise("Não")


def format_datetime(column: Column) -> Column:
    return F.coalesce(F.date_format(column, "yyyy-MM-dd HH:mm:ss 'UTC'"), F.lit(NO_DATE))


def format_month(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM")


def format_depth(column: Column) -> Column:
    return format_number(column, 1, " km")


def timestamp_slug(column: Column) -> Column:
    return F.date_format(column, "yyyyMMdd'T'HHmmss'Z'")


def response_preview(column: Column, limit: int) -> Column:
    collapsed = F.regexp_replace(F.trim(column), r"\s+", " ")
    return F.substring(F.trim(collapsed), 1, limit)


def interval_id(prefix: str, start: Column, end: Column) -> Column:
    return F.concat(
        F.lit(f"{prefix}-"),
        F.date_format(start, "yyyyMMdd"),
        F.lit("-"),
        F.date_format(end, "yyyyMMdd"),
    )


def episode_id(end: Column) -> Column:
    return F.concat(F.lit("EPI-"), F.date_format(end, "yyyyMMdd"))
