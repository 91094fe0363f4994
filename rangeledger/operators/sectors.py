"""Sector, stock and market summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeledger.functions import money, order
from rangeledger.functions.text import security_key, stock_key


def sector_summary(tx: DataFrame) -> DataFrame:
    """Grouping sets (sector) and (asset type, sector): ranges, counts, net."""
    buy, sale = "type = 'Purchase'", "type = 'Sale'"
    part = lambda when, f: F.expr(f"coalesce(sum(case when {when} then amount.{f} end), 0.0D)")
    sets = tx.groupingSets([["sector"], ["asset_type", "sector"]], "asset_type", "sector")
    sums = sets.agg(
        F.grouping("asset_type").alias("g"), *(part(w, f).alias(f"{p}_{f}") for p, w in (("purchase", buy), ("sale", sale)) for f in ("min", "max", "midpoint")),
        F.count("*").alias("transaction_count"), F.expr(f"count_if({buy})").alias("purchase_count"), F.expr(f"count_if({sale})").alias("sale_count"),
        F.expr("count_if(late)").alias("late_count"), F.countDistinct("ticker").alias("company_count"),
        F.expr("count(ticker)").alias("enriched_count"), F.expr("round(avg(confidence), 6)").alias("confidence"),
    )
    return sums.select(
        F.when(F.col("g") == 1, "All").otherwise(F.col("asset_type")).alias("asset_type"), "sector", "transaction_count", "purchase_count", "sale_count", "late_count", "company_count", "enriched_count", "confidence",
        "purchase_midpoint", "sale_midpoint", (F.col("purchase_min") - F.col("sale_max")).alias("net_min"), (F.col("purchase_max") - F.col("sale_min")).alias("net_max"),
        (F.col("purchase_midpoint") - F.col("sale_midpoint")).alias("net_midpoint"),
    )


def sector_order(summary: DataFrame) -> DataFrame:
    """'All' rows first, then by size of the net."""
    return summary.orderBy(*order.sector_order())


def kpis(tx: DataFrame) -> DataFrame:
    return tx.agg(
        F.count("*").alias("transaction_count"), F.count_if(F.col("type") == "Purchase").alias("purchase_count"), F.count_if(F.col("type") == "Sale").alias("sale_count"),
        F.count_if("late").alias("late_count"), F.sum("amount.min").alias("volume_min"), F.sum("amount.max").alias("volume_max"), F.sum("amount.midpoint").alias("volume_midpoint"),
        F.max("date").alias("latest_date"), F.countDistinct(F.coalesce(F.nullif("ticker", F.lit("")), security_key(F.col("description")))).alias("unique_securities"),
    )


def stock_summary(tx: DataFrame) -> DataFrame:
    """Stocks that were bought at least once: ranges, dates and direction."""
    buy, sale = F.col("type") == "Purchase", F.col("type") == "Sale"
    rows = tx.withColumn("stock", stock_key(F.col("description"))).groupBy("stock").agg(
        money.sum_range("amount", buy).alias("p"), money.sum_range("amount", sale).alias("s"), F.count("*").alias("transaction_count"),
        F.count_if(buy).alias("purchase_count"), F.count_if(sale).alias("sale_count"), F.count_if("late").alias("late_count"),
        F.min(F.when(buy, F.col("date"))).alias("first_purchase"), F.max(F.when(buy, F.col("date"))).alias("last_purchase"), F.max("date").alias("last_date"),
    )
    rows = rows.where("purchase_count > 0").withColumn("net", money.net_range(F.col("p"), F.col("s")))
    basis = "Based on disclosed-range midpoint"
    note = F.when(F.col("sale_count") == 0, f"{basis}; no sales in visible rows").when((F.col("net.min") < 0) & (F.col("net.max") > 0), f"{basis}; range crosses zero").otherwise(basis)
    return rows.select(
        "stock", "transaction_count", "purchase_count", "sale_count", "late_count", F.col("p.midpoint").alias("purchase_midpoint"), F.col("s.midpoint").alias("sale_midpoint"),
        F.col("net.min").alias("net_min"), F.col("net.max").alias("net_max"), F.col("net.midpoint").alias("net_midpoint"),
        money.net_direction(F.col("net.midpoint")).alias("direction"), note.alias("note"), "first_purchase", "last_purchase", "last_date",
    )


def stock_order(stocks: DataFrame, n: int = 160) -> DataFrame:
    """The most bought first, at most ``n``."""
    return stocks.orderBy(*order.stock_order()).limit(n)


def page_totals(tx: DataFrame) -> DataFrame:
    """One row: what was bought and sold, in midpoints and in rows."""
    mid = lambda kind: F.coalesce(F.sum(F.when(F.col("type") == kind, F.col("amount.midpoint"))), F.lit(0.0))
    return tx.agg(mid("Purchase").alias("purchases"), mid("Sale").alias("sales"), F.count_if(F.col("type") == "Purchase").alias("purchase_count"), F.count_if(F.col("type") == "Sale").alias("sale_count"))


def market_values(holdings: DataFrame, quotes: DataFrame) -> DataFrame:
    """Holdings with quotes by ticker: shares from the previous close; what has no
    quote keeps its cost."""
    joined = holdings.join(quotes, "ticker", "left")
    shares = F.try_divide(F.col("cost"), F.nullif(F.col("previous_close"), F.lit(0.0)))
    value = F.coalesce(shares * F.col("price"), F.col("cost"))
    return joined.withColumns({"shares": shares, "market_value": value}).withColumn("gain", F.col("market_value") - F.col("cost"))


def portfolio_totals(valued: DataFrame) -> DataFrame:
    totals = valued.agg(F.sum("market_value").alias("market_value"), F.sum("cost").alias("cost"), F.count("price").alias("quoted"))
    gain = F.col("market_value") - F.col("cost")
    return totals.select("market_value", "cost", "quoted", gain.alias("gain"), F.when(F.col("cost") != 0, gain / F.col("cost") * 100).alias("gain_pct"))


def sector_tiles(summary: DataFrame, n: int = 18) -> DataFrame:
    value = F.greatest(F.col("purchase_midpoint") + F.col("sale_midpoint"), F.abs("net_midpoint"), F.lit(1.0))
    return summary.where("asset_type = 'All'").withColumn("tile", value).orderBy(F.col("tile").desc(), "sector").limit(n).select("sector", "tile", "net_midpoint")


def fresh_quotes(quotes: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """Of each ticker the quote fetched last, if it is not older than ``minutes``."""
    recent = quotes.where(F.col("fetched_at") >= now - F.expr(f"interval {minutes} minutes"))
    return recent.groupBy("ticker").agg(F.max_by("price", F.struct("fetched_at", "event_id")).alias("price"))


def strongest(summary: DataFrame, first: int = 12, n: int = 4) -> DataFrame:
    """Of the first 'All' sectors by size those most bought and most sold, ``n`` each."""
    shown = summary.where("asset_type = 'All'").orderBy(F.abs("net_midpoint").desc(), "sector").limit(first)
    side = lambda when, bought: shown.where(when).orderBy(F.abs("net_midpoint").desc(), "sector").limit(n).select("sector", "net_midpoint", F.lit(bought).alias("bought"))
    return side("net_midpoint > 0", True).unionByName(side("net_midpoint < 0", False))


def display_ratios(rows: DataFrame, value: str, activity: str) -> DataFrame:
    """Share of the largest, log height and square-root width of each row."""
    top = rows.agg(F.max(value).alias("_top"))  # one row
    scaled = rows.crossJoin(F.broadcast(top))
    return scaled.withColumns({"share": F.try_divide(F.col(value), F.col("_top")), "height": F.log10(F.col(value) + 1), "width": F.sqrt(activity)}).drop("_top")
