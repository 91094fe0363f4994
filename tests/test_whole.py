"""Queries over whole tables lose no row; rules that whole tables seldom meet are shown on small fixtures."""

from pyspark.sql import functions as F

from rangeledger.operators import events, review
from rangeledger.operators.filters import Filters
from rangeledger.plans.api import Engine
from rangeledger.queries import QUERIES
from tests.test_queries import SMALL


def test_holdings_count_each_transaction_and_part(spark):
    lines, parts, suppliers = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("lineitem", "part", "supplier"))
    held = QUERIES["holdings_estimate"](spark, SMALL)
    assert held.agg(F.sum("transaction_count")).first()[0] == lines.count()
    assert held.where("asset_type = 'ACCOUNT'").count() == suppliers.count()
    names = parts.select(F.concat_ws(" ", "p_name", "p_brand")).distinct().count()
    assert Engine(spark, SMALL).holdings(Filters()).count() <= names + suppliers.count() and not held.where("missing_baseline and baseline_midpoint > 0").count()
    assert QUERIES["market_join"](spark, SMALL).first()["quoted"] == parts.select("p_brand").distinct().count()


def test_each_error_event_meets_the_rate_rule(spark):
    errors = spark.read.parquet(f"{SMALL}/events.parquet").where("event_type = 'error'").count()
    assert QUERIES["conflict_fed"](spark, SMALL).count() == errors


def test_timing_equals_all_pairs(spark):
    """Either key, missing issuers alike or not, keywords, days on the edge."""
    held = [(1, "A", "I", "s", 5.0), (2, "B", None, "s", 6.0), (3, None, None, "t", 7.0)]
    ev = [(10, "2024-03-01", "fed", "x", "y"), (11, "2024-06-01", "other", "Steel talks", ""), (12, "2024-03-01", "other", "none", "")]
    tx = [(1, "A", "I", "2024-01-31"), (2, "A", None, "2024-01-30"), (3, "Z", "I", "2024-03-31"), (4, "B", None, "2024-03-02"), (5, None, None, "2024-05-30"), (6, "Q", None, "2024-06-02")]
    config = [("s", ["fed"], ["steel"]), ("t", [], ["steel", "talks"])]
    frames = (
        spark.createDataFrame(held, "holding_id long, ticker string, issuer_ticker string, sector string, value double"),
        spark.createDataFrame(ev, "event_id long, date string, category string, title string, summary string").withColumn("date", F.col("date").cast("date")),
        spark.createDataFrame(tx, "id long, ticker string, issuer_ticker string, date string").withColumn("date", F.col("date").cast("date")),
        spark.createDataFrame(config, "sector string, triggers array<string>, words array<string>"),
    )
    from datetime import date, timedelta

    for strict in (True, False):
        want = set()
        for h, ticker, issuer, sector, _ in held:
            for e, day, kind, title, body in ev:
                if not any(s == sector and (kind in kinds or any(w in (title + "\n" + body).lower() for w in words)) for s, kinds, words in config):
                    continue
                at = date.fromisoformat(day)
                same = lambda a, b: a == b and (a is not None or not strict)
                near = [d for _, t, i, d in tx if (same(t, ticker) or same(i, issuer)) and abs(date.fromisoformat(d) - at) <= timedelta(30)]
                if near:
                    want.add((str(h), str(e), len(near), sum(date.fromisoformat(d) < at for d in near)))
        got = {(r["holding"], r["event_id"], r["related"], r["before"]) for r in events.timing_conflicts(*frames, strict=strict).collect()}
        assert got == want and want


def test_event_windows_without_targets_and_with_several(spark):
    ev = spark.createDataFrame([(1, "2024-03-01", None, [], []), (2, "2024-03-01", "2024-03-09", ["A", "B"], ["x"]), (3, "2020-01-01", None, [], []), (4, "2024-03-01", None, [], [])], "event_id long, date string, end_date string, tickers array<string>, sectors array<string>")
    ev = ev.withColumns({c: F.col(c).cast("date") for c in ("date", "end_date")})
    tx = [("a", "x", "Purchase", "2024-02-23", 10.0), ("a", "x", "Sale", "2024-03-16", 4.0), ("c", "x", "Purchase", "2024-03-08", 3.0), (None, "z", "Purchase", "2024-03-08", 2.0)]
    tx = spark.createDataFrame(tx, "ticker string, sector string, type string, date string, mid double").withColumns({"date": F.col("date").cast("date"), "amount": F.struct(F.col("mid").alias("midpoint"))})
    got = {r["event_id"]: (r["transaction_count"], r["purchase_midpoint"], r["sale_midpoint"], r["tickers"]) for r in events.event_windows(ev, tx, [7]).collect()}
    assert got == {1: (3, 15.0, 0.0, ["a", "c"]), 2: (3, 13.0, 4.0, ["a", "c"]), 3: (0, 0.0, 0.0, []), 4: (3, 15.0, 0.0, ["a", "c"])}


def test_review_rules(spark):
    filings = spark.createDataFrame([(1, 1, "F1", "failed"), (2, 2, "F2", "parsed"), (3, 3, "F3", "needs-review")], "source_id long, ord long, title string, status string")
    tx = spark.createDataFrame([("t1", 1, "D1", ["Odd"], 0.9), ("t2", 2, "D2", [], 0.65), ("t3", 3, "D3", [], 0.9), ("t4", 4, "D4", [], 0.5)], "id string, ord long, description string, flags array<string>, confidence double")
    held = spark.createDataFrame([(f"h{i}", f"H{i:03d}", float(300 - i), 1, i % 2 == 0) for i in range(300)], "security_key string, description string, mid double, transaction_count long, missing_baseline boolean")
    held = held.withColumn("current", F.struct(F.col("mid").alias("midpoint")))
    identities = spark.createDataFrame([("i1", "k1", "needs_identifier", "needs_review", 140.0, 1.0, 1.0, "I1"), ("i2", "k2", "exact", "verified", 99.0, 1.0, 1.0, "I2"), ("i3", "k3", "exact", "needs_review", 96.0, 1.0, 1.0, "I3")], "identity_id string, key string, status string, review string, priority double, score double, current_mid double, display string")
    empty = spark.createDataFrame([], "baseline_id long")
    rows = review.review_queue(filings, tx, empty, held, identities).collect()
    assert [(r["kind"], r["severity"], r["related_id"]) for r in rows[:3]] == [("source", "high", "1"), ("source", "medium", "3"), ("baseline", "high", None)]
    assert [(r["severity"], r["related_id"], r["detail"]) for r in rows[3:6]] == [("medium", "t1", "D1 | Odd"), ("medium", "t2", "D2 | Low confidence"), ("high", "t4", "D4 | Low confidence")]
    assert [r["related_id"] for r in rows[6:106]] == [f"h{i}" for i in range(0, 200, 2)]  # of the first 200
    assert [(r["severity"], r["related_id"]) for r in rows[106:]] == [("high", "i1"), ("medium", "i3")]
