"""Disclosure-shaped views over star-schema tables.

Order lines stand for reported transactions, parts for securities, parts and
suppliers (as accounts, which are never traded) for baseline holdings, suppliers
for source filings.  The views are lazy: a query reads only the
columns it uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeledger.functions import fixed
from rangeledger.functions.money import bracket_number, bracket_of, numbered_range


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every table by name, also as a temporary view; none is read before it is used."""
    found = {name: table(spark, sf_dir, name) for name in NAMES}
    for name, df in found.items():
        df.createOrReplaceTempView(name)
    return found


def filing_url(key: str) -> Column:
    return F.concat(F.lit("https://filings.example/"), F.col(key))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ord, description, ticker, asset_type, sector, type, date, amount, late, confidence, flags, p_size, p_partkey, url.

    Lines that share their order and number stand as in the file (place), as the
    original takes its rows in the order given; in a table of several files, by the
    place that each has in its own."""
    line, orders, part = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    supplier, nation, region = (table(spark, sf_dir, n) for n in ("supplier", "nation", "region"))
    # Nation and region have a fixed size; the supplier side is left to the planner.
    places = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    single = (F.col("l_quantity") == 1) & (F.col("l_discount") == 0)
    # What a line says is made small before the joins carry it; the names of its part come last.
    lines = line.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", F.col("l_shipdate").cast("date").alias("date"), bracket_number(F.col("l_extendedprice")).alias("bracket"), single.alias("single"),
        F.col("_metadata.row_index").alias("place"),
    )
    joined = (
        lines.join(orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("ordered")), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(places.select("s_suppkey", "r_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )
    kind = F.when(F.col("l_returnflag") == "N", "Purchase").when(F.col("l_returnflag") == "R", "Sale").otherwise("Exchange")
    low = F.col("bracket") == 0
    flags = F.array_compact(F.array(F.when(low, "Amount below the first bracket"), F.when(F.col("single"), "Single unit at full price")))
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.struct("l_orderkey", "l_linenumber", "place").alias("ord"),
        F.concat_ws(" ", "p_name", "p_brand").alias("description"), F.col("p_brand").alias("ticker"), F.col("p_type").alias("asset_type"),
        F.col("r_name").alias("sector"), kind.alias("type"), "date", numbered_range(F.col("bracket")).alias("amount"),
        (F.col("date") > F.date_add("ordered", 45)).alias("late"),
        F.when(low, 0.55).otherwise(0.78).alias("confidence"), flags.alias("flags"), "p_size", "p_partkey", filing_url("l_suppkey").alias("url"),
    )


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """baseline_id, description, ticker, asset_type, value of each part and of each
    supplier's account."""
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("baseline_id"), F.concat_ws(" ", "p_name", "p_brand").alias("description"), F.col("p_brand").alias("ticker"),
        F.col("p_type").alias("asset_type"), bracket_of(F.col("p_retailprice")).alias("value"),
    )
    accounts = table(spark, sf_dir, "supplier").select(
        (-1 - F.col("s_suppkey")).alias("baseline_id"), F.col("s_name").alias("description"), F.lit(None).cast("string").alias("ticker"),
        F.lit("ACCOUNT").alias("asset_type"), bracket_of(F.col("s_acctbal") * 10).alias("value"),
    )
    return parts.unionByName(accounts)


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, ord, title, status, url, reliability of each source filing (a supplier)."""
    status = F.when(F.col("s_acctbal") < 0, "failed").when(F.col("s_acctbal") < 500, "needs-review").otherwise("parsed")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("title"), status.alias("status"), filing_url("s_suppkey").alias("url"), F.lit("official").alias("reliability"))


def dated_events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """event_id, date, user_id, value, category of one kind of event."""
    rows = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return rows.select("event_id", F.col("ts").cast("date").alias("date"), "user_id", "value", F.col("event_type").alias("category"))


CLASSES = ["Corporate Bond", "Municipal Bond", "Preferred / Hybrid", "Equity"]
RELIABILITIES = ["metadata_only", "archived_copy", "official"]


def instrument_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entries that name instruments: entry_id, display, asset_type, sector,
    identifiers, terms, tickers, status, review, reliability, score, current_mid,
    transaction_count, ord."""
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), (size % len(values) + 1).cast("int"))
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "part").withColumn("asset_type", pick(CLASSES))
    equity = F.col("asset_type") == "Equity"
    kind = F.try_element_at(F.create_map(*(F.lit(x) for pair in fixed.INSTRUMENT_KINDS.items() for x in pair)), F.col("asset_type"))
    return rows.select(
        key.cast("string").alias("entry_id"), F.concat_ws(" ", "p_name", "p_brand").alias("display"), "asset_type", F.col("p_type").alias("sector"), F.when(size % 10 == 0, F.upper(F.left(F.md5(F.col("p_name").cast("binary")), F.lit(9)))).alias("cusip"), none.alias("isin"), none.alias("figi"),
        kind.alias("kind"), F.when(~equity, F.col("p_name")).alias("issuer"), F.when(~equity, size / 10).alias("coupon"), F.when(~equity, F.lit("2035-11-15")).alias("maturity"), F.when(equity, F.col("p_brand")).alias("ticker"), F.when(size % 3 == 0, F.col("p_brand")).alias("issuer_ticker"),
        none.alias("status"), F.when(size == 50, "rejected").alias("review"), pick(RELIABILITIES).alias("reliability"), (F.col("p_retailprice") / 20).alias("score"), (F.col("p_retailprice") * 100).alias("current_mid"), size.cast("long").alias("transaction_count"), key.alias("ord"),
    )
