"""Entry points and the streaming extension."""

import os

import pytest
from pyspark.sql import functions as F

from rangeledger.sources.versions import VersionStore
from rangeledger.plans.api import PAGES, Engine
from rangeledger.streaming import refresh

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the tables are not here")


@needs_tables
def test_pages(spark):
    engine = Engine(spark, SMALL)
    assert engine.page("sectors", {"year": "1998"})["kpis"].first()["transaction_count"] > 0
    assert engine.page("equities", {"year": "1998"})["kpis"].first()["transaction_count"] == 0  # no such asset type here
    for name in PAGES:
        assert all(df.columns for df in engine.page(name, {"year": "1998"}).values())  # every page can be planned
    assert engine.page("transactions", {})["transactions"].count() <= 1000
    with pytest.raises(ValueError):
        engine.page("nothing", {})


@needs_tables
def test_bootstrap_and_facts(spark):
    engine = Engine(spark, SMALL)
    assert engine.bootstrap()["index"].count() == 80 and "transactions" not in engine.bootstrap()
    facts = engine.facts({"year": "1998"})
    assert facts["entries"].count() == 12 and facts["years"].count() == 1
    one = facts["entries"].first()["entry_id"]
    assert {r["entry_id"] for r in engine.facts({}, [one])["entries"].collect()} == {one}


@needs_tables
def test_market(spark):
    quotes = spark.createDataFrame([("Brand#1", 11.0, 10.0)], "ticker string, price double, previous_close double")
    # Tickers of up to six characters: those of the tables have seven.
    engine = Engine(spark, SMALL)
    assert engine.market(["brand#1", "toolongticker"], quotes).count() == 0
    engine.holdings = lambda f: Engine(spark, SMALL).holdings(f).withColumn("ticker", F.regexp_replace("ticker", "rand#", ""))
    rows = engine.market([" b1 ", "B2"], quotes.withColumn("ticker", F.lit("B1"))).collect()
    assert len(rows) == 2 and {r["ticker"]: r["price"] for r in rows} == {"B1": 11.0, "B2": None}
    assert all(abs(r["market_value"] - r["cost"] * (1.1 if r["ticker"] == "B1" else 1)) < 1e-3 for r in rows)


@needs_tables
def test_build(spark, tmp_path):
    Engine(spark, SMALL).build(str(tmp_path / "out"), "v1")
    store = VersionStore(spark, str(tmp_path / "out"))
    assert store.table("index").count() == store.manifest("v1")["index"]["rows"] > 0 and store.table("review", "v1").count() > 0


@needs_tables
def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    refresh.refresh(stream, str(tmp_path / "sums"), ["event_type"], str(tmp_path / "cp")).awaitTermination()
    got = refresh.current(spark.read.parquet(str(tmp_path / "sums")), ["event_type"])
    want = events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    plain = lambda df: sorted((r["event_type"], r["n"], round(r["value"], 6)) for r in df.collect())
    assert plain(got) == plain(want)
    flow = refresh.windowed_flow(events)
    assert flow.agg(F.sum("n")).first()[0] == events.count()
