"""Orders of what is shown: names as a reader sorts them.

Text is compared by the root collation (case and accents after letters), which
Spark sorts by without a function of ours; the text itself settles what that holds
equal, and an id what has the same text, so that every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible(name: str | Column, down: bool = False) -> list[Column]:
    """Keys of a reader's order of a text column."""
    column = F.col(name) if isinstance(name, str) else name
    keys = [F.collate(column, "UNICODE"), column]
    return [k.desc() if down else k.asc() for k in keys]


def holding_order() -> list[Column]:
    return [F.col("current.midpoint").desc(), F.col("transaction_count").desc(), *visible("description"), F.col("security_key").asc()]


def sector_order() -> list[Column]:
    return [(F.col("asset_type") != "All").asc(), F.abs("net_midpoint").desc(), *visible("sector"), *visible("asset_type")]


def index_order(name: str = "description") -> list[Column]:
    return [F.col("score").desc(), F.col("current_mid").desc(), *visible(name), F.col("security_key").asc()]


def rollup_order() -> list[Column]:
    return [F.col("current_mid").desc(), *visible("key"), F.col("kind").asc()]


def stock_order() -> list[Column]:
    return [F.col("purchase_midpoint").desc(), F.col("transaction_count").desc(), *visible("stock")]


def event_order() -> list[Column]:
    return [F.col("date").asc(), F.col("importance").desc(), *visible("title"), F.col("event_id").asc()]


def identity_order() -> list[Column]:
    return [F.col("priority").desc(), F.col("score").desc(), F.col("current_mid").desc(), *visible("display"), F.col("key").asc()]


#: Rows that a screen shows of a kind (fixed values).
SHOWN = {"leaders": 8, "index": 120, "cloud": 80, "holdings": 120, "holdings_with_baseline": 100, "transactions": 250, "stocks": 160, "review": 120, "conflicts": 50, "gaps": 8, "rollups": 8, "marker_sectors": 5}


def shown(kind: str, df: DataFrame, keys: list[Column]) -> DataFrame:
    """The first rows of a kind in the order given, as many as a screen shows."""
    return df.orderBy(*keys).limit(SHOWN[kind])


def lookup_order() -> list[Column]:
    return [F.col("midpoint").desc(), F.col("transaction_count").desc(), *visible("description"), F.col("security_key").asc()]
