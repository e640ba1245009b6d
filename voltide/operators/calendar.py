"""Weekends-only business calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def is_business_day(day: Column) -> Column:
    return F.weekday(day) < 5


def following(day: Column) -> Column:
    """The day itself, or the Monday after a weekend."""
    return F.when(F.weekday(day) < 5, day).otherwise(F.date_add(day, (7 - F.weekday(day)).cast("int"))).cast("date")


def previous(day: Column) -> Column:
    """The business day before."""
    back = F.when(F.weekday(day) == 0, 3).when(F.weekday(day) == 6, 2).otherwise(1)
    return F.date_sub(day, back)


def plus_business_days(day: Column, n: int) -> Column:
    """``n`` business days after a business day."""
    left = F.weekday(day) + F.lit(n % 5)
    return F.date_add(day, (F.lit(n // 5 * 7 + n % 5) + F.when(left >= 5, 2).otherwise(0)).cast("int"))


def business_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """All business days from start to end, both included."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("date"))
    return days.where(is_business_day(F.col("date")))


def with_previous(df: DataFrame, entity: str, date: str, out: str = "previous_date") -> DataFrame:
    """Each row's predecessor date within its entity."""
    return df.withColumn(out, F.lag(date).over(Window.partitionBy(entity).orderBy(date)))
