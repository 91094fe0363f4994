"""Flows by month and year, with gaps filled where a chart needs them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def month(date: str | Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def _mid(kind: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("type") == kind, F.col("amount.midpoint"))), F.lit(0.0))


def monthly_flow(tx: DataFrame) -> DataFrame:
    return tx.groupBy(month("date").alias("month")).agg(_mid("Purchase").alias("purchase_midpoint"), _mid("Sale").alias("sale_midpoint"), F.count("*").alias("transaction_count"))


def monthly_activity(tx: DataFrame) -> DataFrame:
    rows = tx.groupBy(month("date").alias("month")).agg(
        F.count_if(F.col("type") == "Purchase").alias("purchases"), F.count_if(F.col("type") == "Sale").alias("sales"), F.count_if("late").alias("late"), F.count("*").alias("n")
    )
    share = F.col("late") / F.col("n")
    tone = F.when(share >= 0.9, "severe").when(share >= 0.7, "high").when(share >= 0.35, "medium").otherwise("low")
    return rows.select("month", "purchases", "sales", "late", "n", F.round(share, 6).alias("late_share"), tone.alias("tone"))


def month_spine(bounds: DataFrame, low: str, high: str) -> DataFrame:
    """Every month from the first to the last of a one-row frame of bounds."""
    months = F.sequence(F.trunc(F.col(low), "month"), F.trunc(F.col(high), "month"), F.expr("interval 1 month"))
    return bounds.select(F.explode(months).alias("d")).select(month("d").alias("month"))


def gap_filled_flow(tx: DataFrame) -> DataFrame:
    """Monthly flow over all months; a month without rows has null, not zero."""
    spine = month_spine(tx.agg(F.min("date").alias("low"), F.max("date").alias("high")), "low", "high")
    return spine.join(monthly_flow(tx), "month", "left")


def year_spine(tx: DataFrame) -> DataFrame:
    bounds = tx.agg(F.year(F.min("date")).alias("low"), F.year(F.max("date")).alias("high"))
    return bounds.select(F.explode(F.sequence(F.col("low") - 1, F.col("high") + 1)).alias("year"))


def yearly_exposure(tx: DataFrame, assets: DataFrame) -> DataFrame:
    """Years of a dense spine with flows and assets, assets of none as zero."""
    flows = tx.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("transaction_count"), _mid("Purchase").alias("purchase_midpoint"), _mid("Sale").alias("sale_midpoint"))
    joined = year_spine(tx).join(flows, "year", "left").join(assets, "year", "left")
    zero, none = F.lit(0.0), F.lit(0).cast("long")
    return joined.select(
        "year", F.coalesce("transaction_count", none).alias("transaction_count"), F.coalesce("purchase_midpoint", zero).alias("purchase_midpoint"),
        F.coalesce("sale_midpoint", zero).alias("sale_midpoint"), F.coalesce(F.nullif("asset_value", zero), F.coalesce("purchase_midpoint", zero)).alias("exposure"),
    )


def two_year_rows(df: DataFrame, first: str, second: str) -> DataFrame:
    """A row once for each different year it names."""
    return df.withColumn("year", F.explode(F.array_distinct(F.array_compact(F.array(first, second)))))


def density(events: DataFrame) -> DataFrame:
    """Events by category and month, the busiest cell marked."""
    cells = events.groupBy("category", month("date").alias("month")).agg(F.count("*").alias("n"))
    top = cells.agg(F.max_by(F.struct("category", "month"), F.struct("n", "category", "month")).alias("busiest"))
    busiest = F.struct("category", "month") == F.col("busiest")
    return cells.crossJoin(F.broadcast(top)).select("category", "month", "n", busiest.alias("is_busiest"))


def pins(events: DataFrame) -> DataFrame:
    """The best event of each category and month."""
    order = Window.partitionBy("category", "month").orderBy(F.col("importance").desc(), F.col("date").desc(), "title")
    return events.withColumn("month", month("date")).withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def stacked(points: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Running index of points that fall on one place."""
    window = Window.partitionBy(*key).orderBy(*order)
    return points.withColumn("stacked_index", F.row_number().over(window) - 1)
