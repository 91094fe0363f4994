"""Operators on rows built in code."""

import datetime

from pyspark.sql import functions as F

from rangeledger.functions import money
from rangeledger.operators import events, filters, holdings, sectors
from rangeledger.sources import readers, sinks


def trades(spark, rows):
    df = spark.createDataFrame(rows, "id string, description string, ticker string, asset_type string, sector string, type string, date string, label string, late boolean, issuer_ticker string")
    return df.withColumns({"date": F.col("date").cast("date"), "amount": money.parse_range(F.col("label")), "ord": F.struct("id")})


PAIR = [
    ("1", "CLOUDFLARE INC CLASS A", "NET", "Equity", "IT", "Purchase", "2026-03-30", "$50,001-$100,000", True, None),
    ("2", "CLOUDFLARE INC CLASS A", "NET", "Equity", "IT", "Sale", "2026-04-01", "$15,001-$50,000", False, None),
]


def test_stock_pair(spark):
    row = sectors.stock_summary(trades(spark, PAIR)).first()
    assert (row["stock"], row["purchase_count"], row["sale_count"], row["direction"]) == ("CLOUDFLARE", 1, 1, "Net buy")


def test_sold_only_stocks_are_left_out(spark):
    assert sectors.stock_summary(trades(spark, PAIR[1:])).count() == 0


def test_event_window_of_a_named_ticker(spark):
    event = spark.createDataFrame([(1, "2026-03-25", None, ["NET"], [])], "event_id int, date string, end_date string, tickers array<string>, sectors array<string>")
    event = event.withColumns({"date": F.col("date").cast("date"), "end_date": F.col("end_date").cast("date")})
    other = ("3", "OTHER", "XYZ", "Equity", "Energy", "Purchase", "2026-03-26", "$1,001-$15,000", False, None)
    got = {r["window_days"]: r for r in events.event_windows(event, trades(spark, [*PAIR, other])).collect()}
    assert got[7]["transaction_count"] == 2 and got[7]["purchase_midpoint"] == 75000.5 and got[7]["tickers"] == ["NET"]
    empty = events.event_windows(event.withColumn("date", F.lit("2020-01-01").cast("date")), trades(spark, PAIR)).collect()
    assert sorted((r["window_days"], r["transaction_count"]) for r in empty) == [(7, 0), (30, 0)]


def test_holdings_and_scores(spark):
    base = spark.createDataFrame([(1, "CLOUDFLARE INC", "NET", "Equity", "$100,001-$250,000"), (2, "MONEY MARKET", None, "Other", "$1,001-$15,000")], "baseline_id long, description string, ticker string, asset_type string, label string")
    base = base.withColumn("value", money.parse_range(F.col("label")))
    held = holdings.estimated(holdings.grouped(trades(spark, PAIR)), base)
    got = {r["description"]: r for r in held.collect()}
    assert got["CLOUDFLARE INC"]["current"]["midpoint"] == 175000.5 + 75000.5 - 32500.5
    assert got["CLOUDFLARE INC"]["confidence"] == 0.86 and not got["CLOUDFLARE INC"]["missing_baseline"]
    assert got["MONEY MARKET"]["transaction_count"] == 0
    scored = holdings.scored(held).orderBy(F.col("score").desc()).collect()
    assert scored[0]["description"] == "CLOUDFLARE INC" and scored[0]["exposure"] == 100.0 and scored[0]["direction"] == "Net buy"


def test_two_baselines_leave_no_match(spark):
    base = spark.createDataFrame([(1, "CLOUDFLARE A", "NET", "Equity"), (2, "CLOUDFLARE B", "NET", "Equity")], "baseline_id long, description string, ticker string, asset_type string")
    base = base.withColumn("value", money.zero_range())
    rows = holdings.estimated(holdings.grouped(trades(spark, PAIR)), base).where("transaction_count > 0").collect()
    assert rows[0]["missing_baseline"]


def test_citations_are_capped(spark):
    rows = spark.createDataFrame([("k", i, f"u{i}") for i in range(8)] + [("k", 9, None)], "security_key string, ord int, url string")
    sources = spark.createDataFrame([("u1", "s1", "old", "archived_copy", 1), ("u1", "s1", "new", "official", 2)], "url string, source_id string, title string, reliability string, ord int")
    got = holdings.cited(rows, sources, sources.limit(0)).orderBy("rank").collect()
    assert len(got) == 5 and got[1]["label"] == "new"


def test_filters(spark):
    tx = trades(spark, PAIR)
    f = filters.Filters.from_params({"year": "2026", "lateOnly": "true", "confidence": "x", "query": "  cloud% "})
    assert f.late_only and f.confidence is None and f.query == "cloud%"
    assert filters.filtered(tx, f).count() == 0  # % is a character like any other
    assert filters.filtered(tx, filters.Filters(year="2026", query="CLOUD", ticker="net", late_only=True)).count() == 1
    assert filters.filtered(tx, filters.Filters(year="All", sector="All")).count() == 2
    page = filters.Filters(year="2026", start_date="2026-01-01").for_page("timing")
    assert page.year is None and page.start_date is None
    assert filters.Filters().for_page("equities").asset_type == "Equity"


def test_rate_conflicts_need_exposure(spark):
    held = spark.createDataFrame([("a", 60000.0), ("b", 50000.0)], "sector string, value double")
    event = spark.createDataFrame([(7,)], "event_id int")
    assert events.rate_conflicts(held, event, F.col("sector") == "a").count() == 0
    row = events.rate_conflicts(held, event, F.lit(True)).first()
    assert row["severity"] == "medium" and row["value"] == 110000


def test_sources_and_sinks(spark, tmp_path):
    lines = spark.createDataFrame([("Symbol|Security Name|X",), ("NET|Cloudflare, Inc.|N|N|Y",), ("File Creation Time: 1||",), ("|no symbol|",)], "value string")
    assert [tuple(r) for r in readers.symbol_directory(lines).collect()] == [("NET", "Cloudflare, Inc.", "N", True, False)]
    rows = spark.createDataFrame([([["1", "A Co", "a", "NYSE"], ["2", "short"], ["3", "", "x", "y"]],)], "data array<array<string>>")
    assert [r["ticker"] for r in readers.company_tickers(rows).collect()] == ["A"]
    assert readers.json_or_empty(spark, str(tmp_path / "none"), rows.schema).count() == 0
    sheet = sinks.flat_sheet(spark.createDataFrame([([1, 2], "x")], "a array<int>, b string")).first()
    assert sheet["a"] == "1; 2"
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert readers.fingerprints(spark, str(tmp_path / "f.bin")).first()["sha256"].startswith("BA7816BF")
