"""Transactions behind holdings, symbols of lines, a reader's order, all of an indicator."""

import random

from pyspark.sql import functions as F

from rangeledger.functions import fixed, money, order
from rangeledger.functions.text import named_symbol
from rangeledger.operators import documents, events, holdings


def test_ids_before_the_key(spark):
    tx = [("a", None, "Alpha", 1, "2024-01-01"), ("b", "BETA", "x", 2, "2024-01-02"), ("a", "BETA", "y", 3, "2024-01-03"), ("c", "", "beta", 4, "2024-01-04"), ("d", "GAMMA", "g", 5, "2024-01-05")]
    held = [(1, ["b", "zz", "a", "b", None], "GAMMA"), (2, ["zz"], "BETA"), (3, [], "ALPHA"), (4, ["zz"], None), (5, None, "GAMMA"), (6, ["zz"], "nobody")]
    frames = spark.createDataFrame(held, "holding_id int, transaction_ids array<string>, normalized_description string"), spark.createDataFrame(tx, "id string, normalized_description string, description string, ord int, date string")
    got = sorted((r["holding_id"], r["how"], r["place"] if r["place"] is not None else -1, r["id"], r["ord"]) for r in holdings.backing_transactions(*frames).collect())
    assert got == [(1, "ids", 0, "b", 2), (1, "ids", 2, "a", 1), (1, "ids", 3, "b", 2), (2, "key", -1, "a", 3), (2, "key", -1, "b", 2), (2, "key", -1, "c", 4), (3, "key", -1, "a", 1), (5, "key", -1, "d", 5)]


def first_symbol(said, symbols, names):
    upper = said.upper()
    return next((s for s in symbols if s in upper), None) or next((s for n, s in names.items() if n in upper), None)


def test_first_symbol_of_the_list(spark):
    rnd = random.Random(2)
    symbols, names = ["GOOGL", "GOOG", "OG", "MA", "A.B", "V"], {"VISA": "V", "MASTER": "MA", "IS": "OG"}
    said = ["".join(rnd.choice(["goog", "googl", "o", "g", "ma", "a.b", "axb", "v", "visa", "master", " ", "is", "x"]) for _ in range(rnd.randint(0, 5))) for _ in range(400)]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    got = {r["s"]: r["t"] for r in df.select("s", named_symbol(F.col("s"), symbols, names).alias("t")).collect()}
    assert got == {s: first_symbol(s, symbols, names) for s in said} and set(got.values()) > {None, "V", "OG", "GOOG"}
    one = lambda s: spark.range(1).select(named_symbol(F.lit(s), fixed.LINE_SYMBOLS, fixed.LINE_NAMES).alias("t")).first()["t"]
    assert [one(s) for s in ("Alphabet Inc GOOGL", "Apple Inc", "Coca-Cola Co", "plain", "")] == ["GOOGL", "AAPL", "KO", None, None]


def test_reported_trades(spark):
    text = "1 \tABBOTT LABS INC COM \tpurchase \t4/17/2026\n3 \tAmazon Com Inc \tpurchase \t5/5/2026 \tYes $1,000,001 - $5,000,000\nMicrosoft Corp SALE 12/1/2025 No $1,001–$15,000\nDescription purchase 1/1/2026\nABC sale 1/1/2026\nno trade\n" + "x" * 120 + " sale 1/1/2026\nWalt exchange 2/30/2026"
    rows = documents.lines(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    got = [tuple(r)[1:] for r in documents.reported_trades(rows).orderBy("n").collect()]
    assert [(g[0], str(g[1]), *g[2:]) for g in got] == [
        (1, "2026-04-17", "Purchase", "ABBOTT LABS INC COM", None, False, None), (2, "2026-05-05", "Purchase", "Amazon Com Inc", "$1,000,001 - $5,000,000", True, "MA"),  # the symbol stands within a word
        (3, "2025-12-01", "Sale", "Microsoft Corp", "$1,001–$15,000", False, "MSFT"), (8, "None", "Exchange", "Walt", None, False, None),
    ]


def test_visible_order(spark):
    names = ["b", "A", "a", "B", "é", "e", "E", "f", "ab", "a b", "1", "_", None, "10", "2"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(*order.visible("n")).collect()]
    assert got == [None, "_", "1", "10", "2", "a", "A", "a b", "ab", "b", "B", "e", "E", "é", "f"]
    down = [r[0] for r in spark.createDataFrame([("a",), ("B",), ("A",)], "n string").orderBy(*order.visible("n", down=True)).collect()]
    assert down == ["B", "A", "a"]


def test_money_of_payloads(spark):
    shown = lambda v: spark.range(1).select(money.short_money(F.lit(v)).alias("m")).first()["m"]
    assert [shown(v) for v in (0.0, 999.4, 999.5, 1000.0, 32500.5, 999_999.0, 1_000_000.0, 3_000_000.5, 50_000_001.0)] == ["$0", "$999", "$1000", "$1K", "$33K", "$1000K", "$1.0M", "$3.0M", "$50.0M"]


def test_all_of_an_indicator(spark):
    held = spark.createDataFrame([("h1", "AAPL", None, "Apple", "Information Technology", ["https://f/1"]), ("h2", None, "IBK", "Bank bond", "Financials", None)], "holding_id string, ticker string, issuer_ticker string, name string, sector string, source_urls array<string>")
    dated = spark.createDataFrame([(1, "2025-03-01", "tariff", "Chips", "https://e/1"), (2, "2025-06-01", "fed", "Cut", None)], "event_id long, date string, category string, title string, source_url string").withColumn("date", F.col("date").cast("date"))
    days = ["2025-01-29", "2025-01-30", "2025-02-10", "2025-03-01", "2025-03-31", "2025-04-01"]
    tx = [(f"t{i}", "AAPL", "X", day, f"https://t/{i}") for i, day in enumerate(days)] + [("n1", None, "Y", "2025-06-02", None), ("n2", "Q", "IBK", "2025-06-03", None), ("n3", "Q", "Z", "2025-06-03", None)]
    trades = spark.createDataFrame(tx, "id string, ticker string, issuer_ticker string, date string, source_url string").withColumn("date", F.col("date").cast("date"))
    shown = [
        ("policy-AAPL-tariff-holding", "medium", "tariff-holding", "AAPL", "Apple", 65000.5, None, 0.7), ("timing-h1-1", "high", "suspicious-timing", "AAPL", "h1", 65000.5, "1", 0.85),
        ("timing-h2-2", "medium", "suspicious-timing", None, "h2", 10.0, "2", 0.6), ("fed-2", "high", "fed-rate-sensitive", None, "3 financial holdings", 2.5e6, "2", 0.5),
    ]
    ranked = spark.createDataFrame(shown, "indicator_id string, severity string, category string, ticker string, holding string, value double, event_id string, evidence double")
    got = {r["indicator_id"]: r for r in events.detailed(ranked, held, dated, trades, most=3).collect()}
    policy, timing, other, fed = (got[s[0]] for s in shown)
    assert (policy["title"], policy["summary"], policy["tags"], policy["source_urls"], policy["position"], policy["transaction_ids"]) == ("Tariff-Affected Holding: Apple", "Holds $65K in AAPL. China manufacturing exposure", ["AAPL", "tariff-holding"], ["https://f/1"], None, [])
    assert timing["title"] == 'Suspicious timing: Apple transactions near "Chips"' and timing["summary"] == "4 transaction(s) within 30 days of tariff event. 2 occurred before the announcement."
    assert (timing["transaction_ids"], timing["related"], timing["window_days"], timing["position"], timing["tags"]) == (["t1", "t2", "t3"], 4, 30, "before", ["Information Technology", "tariff", "AAPL"])
    assert timing["source_urls"] == ["https://e/1", "https://t/1", "https://t/2", "https://t/3"] and str(timing["transaction_dates"][0]) == "2025-01-30"
    assert (other["transaction_ids"], other["position"], other["tags"]) == (["n1", "n2"], "after", ["Financials", "fed"])  # a missing ticker agrees with a missing one
    assert (fed["title"], fed["summary"], fed["position"], fed["tags"], fed["event_title"]) == ("Fed rate decision while holding rate-sensitive assets", 'Held $2.5M in rate-sensitive financials during Fed event: "Cut"', "during", ["fed", "financials", "rate-sensitive"], "Cut")
    groups = {(r["category"], r["severity"]): r["indicators"] for r in events.conflicts_by(ranked, "category", "severity").collect()}
    assert groups[("suspicious-timing", "high")] == ["timing-h1-1"] and len(groups) == 4
