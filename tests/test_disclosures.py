"""Entry points and rules that the tables' queries do not reach."""

import pytest
from pyspark.sql import functions as F

from rangeledger.functions import fixed
from rangeledger.operators import context, documents, enrichment, events, ingest, liabilities
from rangeledger.plans import stages
from rangeledger.plans.api import PAGES, Engine
from tests.test_queries import SMALL


def test_every_page_has_rows_or_columns(spark):
    assert len(PAGES) == 16
    for name in ("filings", "identifier-review", "conflicts", "preferred", "other"):
        page = Engine(spark, SMALL).page(name, {})
        assert page["kpis"].count() == 1 and all(df.columns for df in page.values())
    assert Engine(spark, SMALL).page("identifier-review", {"issuer": "gear"})["identifier_review"].count() > 0
    assert Engine(spark, SMALL).page("conflicts", {})["index"].count() == 80


def test_conflicts_by_the_fixed_policies(spark):
    engine = Engine(spark, SMALL)
    held = [("JPM", "Financials", 2e6), ("AAPL", "Information Technology", 1e5), ("ZZ", "Energy", 5.0)]
    frame = spark.createDataFrame(held, "ticker string, sector string, mid double").select(F.col("ticker").alias("security_key"), "ticker", F.col("ticker").alias("description"), "sector", F.struct(F.col("mid").alias("midpoint")).alias("current"))
    engine.holdings = lambda f: frame
    dated = spark.createDataFrame([(1, "2025-03-01", "fed", "Rate decision", ""), (2, "2025-06-01", "tariff", "x", "y"), (3, "2025-06-01", "market", "China chips", "")], "event_id long, date string, category string, title string, summary string").withColumn("date", F.col("date").cast("date"))
    tx = spark.createDataFrame([("t", "AAPL", None, "2025-05-20"), ("u", "ZZ", None, "2025-07-15")], "id string, ticker string, issuer_ticker string, date string").withColumn("date", F.col("date").cast("date"))
    found = engine.conflicts(dated, tx=tx)
    ids = {r["indicator_id"]: (r["severity"], r["category"]) for r in found["indicators"].collect()}
    assert ids == {
        "policy-JPM-fed-rate-sensitive": ("high", "fed-rate-sensitive"), "policy-JPM-regulatory-holding": ("high", "regulatory-holding"), "policy-AAPL-tariff-holding": ("medium", "tariff-holding"),
        "policy-AAPL-foreign-policy": ("medium", "foreign-policy"), "fed-1": ("high", "fed-rate-sensitive"), "timing-AAPL-2": ("high", "suspicious-timing"), "timing-AAPL-3": ("high", "suspicious-timing"), "timing-ZZ-2": ("high", "suspicious-timing"),  # two missing issuers agree
    }
    summary = found["summary"].first()
    assert (summary["total"], summary["high"], summary["medium"], summary["events"]) == (8, 6, 2, 3)


def test_register_document(spark):
    rows = [("Executive order on <b>steel</b> &amp; aluminum", "2026-02-22", "https://x", None, 1), ("Plain", "2026-02-22", "https://x", "customs", 2), ("Plain", "2026-02-22", "https://x", "none", 3), ("Tariff-related", None, "u", "", 4), ("Proclamation", "2026-01-01", None, "", 5)]
    docs = spark.createDataFrame(rows, "title string, date string, url string, abstract string, number int").withColumn("date", F.col("date").cast("date"))
    got = {r["title"]: r for r in context.register_events(docs).collect()}
    assert set(got) == {"Executive order on steel & aluminum", "Plain"} and got["Plain"]["importance"] == 2
    steel = got["Executive order on steel & aluminum"]
    assert steel["tags"] == ["Section 232"] and steel["sectors"] == ["Materials"] and steel["summary"].startswith("Federal Register trade")


def test_story_tickers_and_summary(spark):
    long = "x" * 300
    rows = [("u1", "Head", None, long, "", "2026-01-01", ["R:AAPL.O", "N2:POTUS", "other"]), ("u2", None, None, None, None, "2026-01-01", None)]
    stories = spark.createDataFrame(rows, "uri string, headline string, slug string, fragment string, body_text string, created string, topic_codes array<string>").withColumns({"created": F.col("created").cast("date"), "url": F.lit(None).cast("string")})
    only = context.story_events(stories).collect()
    assert len(only) == 1 and only[0]["tickers"] == ["AAPL"] and only[0]["summary"] == "x" * 257 + "..." and "N2:POTUS" in only[0]["tags"]


def test_liability_layouts_of_one_document(spark):
    text = "\n".join([
        "Cover", "Part 8: Liabilities", "# Creditor", "1. Big Bank\tMortgage", "on a hotel Over $50,000,000 2012 2.5% 10 years", "American Express Credit card $15,001 - $50,000 2020 N/A Revolving", "Page 3", "Part 9: Gifts", "2. no liability $1,001 - $15,000 2001 N/A x",
    ])
    rows = liabilities.liabilities(documents.lines(spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "doc_id long, text string"))).orderBy("n").collect()
    assert [(r["creditor"], r["type"], r["amount"]["midpoint"], r["year"], r["rate"], r["term"]) for r in rows] == [
        ("Big Bank", "Mortgage on a hotel", 50000001.0, "2012", "2.5%", "10 years"), ("American Express", "Credit card", 32500.5, "2020", None, "Revolving"),
    ]
    named = liabilities.creditor_and_type(F.lit("Old Bank Somebody Tower loan"), filer="Somebody")
    assert spark.range(1).select(*named).first() == ("Old Bank", "Somebody Tower loan")


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda name, default: default)})

    with pytest.raises(ValueError):
        stages.shared_dir(Session())


def test_resolved_flags_and_exchange(spark):
    row = spark.range(1).select(enrichment.exchange_name(F.lit("Q")).alias("a"), enrichment.exchange_name(F.lit("ZZ")).alias("b"), enrichment.exchange_name(F.lit("")).alias("c"), ingest.transaction_type(F.lit(" SALE (full)")).alias("d")).first()
    assert tuple(row) == ("Nasdaq", "ZZ", None, "Sale")
    assert events.shown_events(spark.createDataFrame([], "event_id int, date date, end_date date"), "2024").count() == 0 and fixed.FIXED_INCOME


def test_baseline_by_each_typed_key(spark):
    """A baseline row is found by any of ten keys; keys of two characters are none."""
    from rangeledger.operators import holdings

    names = list(holdings.NAMING)
    schema = "description string, ticker string, " + ", ".join(f"{n} string" for n in names) + ", coupon double, maturity string"
    row = lambda d, **kw: (d, kw.get("ticker"), *(kw.get(n) for n in names), kw.get("coupon"), kw.get("maturity"))
    cases = [{"ticker": "TICK"}, *({n: f"value {n}"} for n in names), {"instrument_issuer": "Issuer X", "coupon": 5.5, "maturity": "2030-01-01"}, {"ticker": "AB"}]
    tx = spark.createDataFrame([row(f"traded {i}", **c) for i, c in enumerate(cases)], schema).withColumns({
        "asset_type": F.lit("Equity"), "sector": F.lit("s"), "type": F.lit("Purchase"), "date": F.lit("2024-01-01").cast("date"), "late": F.lit(False), "ord": F.monotonically_increasing_id(),
        "amount": F.struct(F.lit("l").alias("label"), *(F.lit(1.0).alias(n) for n in ("min", "max", "midpoint"))),
    })
    base = spark.createDataFrame([row(f"held {i}", **c) for i, c in enumerate(cases)], schema).withColumns({"asset_type": F.lit("Equity"), "value": F.struct(F.lit("l").alias("label"), *(F.lit(10.0).alias(n) for n in ("min", "max", "midpoint")))})
    base = base.withColumn("baseline_id", F.regexp_extract("description", r"(\d+)", 1).cast("int"))
    got = {r["security_key"]: r["description"] for r in holdings.estimated(holdings.grouped(tx), base).where("transaction_count > 0").collect()}
    assert got == {f"TRADED {i}": (f"held {i}" if i < len(cases) - 1 else f"traded {i}") for i in range(len(cases))}


def test_memoised_reads_again_after_a_change(spark, tmp_path):
    from rangeledger.sources import readers

    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    first = readers.memoised(spark, path, spark.read.parquet)
    assert first is readers.memoised(spark, path, spark.read.parquet) and first.count() == 3
    spark.range(5).write.mode("overwrite").parquet(path)
    assert readers.memoised(spark, path, spark.read.parquet).count() == 5


def test_built_bootstrap_and_workbook(spark, tmp_path):
    from rangeledger.sources import tables

    Engine(spark, SMALL).build(str(tmp_path / "b"), "v7")
    stored = Engine(spark, SMALL, str(tmp_path / "b")).bootstrap()
    plain = Engine(spark, SMALL).bootstrap()
    assert stored["kpis"].first() == plain["kpis"].first() and [r["security_key"] for r in stored["index"].collect()] == [r["security_key"] for r in plain["index"].collect()]
    names = Engine(spark, SMALL).workbook(str(tmp_path / "w"))
    assert len(names) == 25 and {"identifiers", "events", "event_windows", "historical_sources", "reports", "asset_holdings", "liabilities", "yearly_exposure", "methods", "evidence_methods"} <= set(names)
    figures = {r["field"]: r["value"] for r in spark.read.option("header", True).csv(str(tmp_path / "w" / "methods")).collect()}
    assert figures["transaction_count"] == str(spark.read.parquet(f"{SMALL}/lineitem.parquet").count()) and figures["liability_count"] == "0" and "index_formula" in figures
    assert spark.read.option("header", True).csv(str(tmp_path / "w" / "holdings")).count() == plain["index"].sparkSession.read.option("header", True).csv(str(tmp_path / "w" / "index")).count()
    assert tables.views(spark, SMALL)["nation"].count() == spark.table("nation").count() == 25


def test_workbook_of_given_tables(spark, tmp_path):
    text = "Part 6: Other Assets and Income\n1. Some Acct. N/A $1,001 - $15,000 Rent\nPart 7: Transactions\nPart 8: Liabilities\n1. A Bank mortgage $15,001 - $50,000 1999 4% On demand\nPart 9: Gifts"
    day = F.lit("2020-05-01").cast("date")
    given = {
        "documents": spark.createDataFrame([("s1", text)], "doc_id string, text string"), "events": spark.createDataFrame([("e1", "fed")], "event_id string, category string").select("event_id", F.lit("1998-05-01").cast("date").alias("date"), F.lit(None).cast("date").alias("end_date"), F.array().cast("array<string>").alias("tickers"), F.array().cast("array<string>").alias("sectors"), "category"),
        "historical": spark.createDataFrame([("s1", "Report", "Annual 278e", "https://x/1.pdf", "official")], "source_id string, title string, filing_type string, url string, reliability string").withColumn("filed_date", day),
        "candidates": spark.createDataFrame([("k", "BOND DUE 05/01/2030 5%", "Corporate Bond", [])], "security_key string, description string, asset_type string, candidates array<struct<figi:string,ticker:string,name:string,market:string,security_type:string,text:string>>"),
    }
    Engine(spark, SMALL).workbook(str(tmp_path / "w"), given)
    read = lambda name: spark.read.option("header", True).csv(str(tmp_path / "w" / name)).collect()
    assert [r["description"] for r in read("asset_holdings")] == ["Some Acct"] and [r["creditor"] for r in read("liabilities")] == ["A Bank"]
    assert [(r["source_id"], r["assets"], r["liabilities"], r["parser_status"]) for r in read("reports")] == [("s1", "1", "1", "parsed")]
    assert [r["status"] for r in read("identifiers")] == ["not_found"] and len(read("event_windows")) == 2 and int(read("event_windows")[0]["transaction_count"]) > 0
    assert {r["field"]: r["value"] for r in read("methods")}["asset_income_holding_count"] == "1"


def test_facts_cite_each_source_once(spark):
    bundle = Engine(spark, SMALL).facts({})
    entries, cited = bundle["entries"].collect(), bundle["citations"].collect()
    assert len(entries) == 12 and all(1 <= r["filing_count"] <= 5 and r["reliability"] == "official" for r in entries)
    assert 0 < len(cited) <= 12 and len({r["url"] for r in cited}) == len(cited) and "baseline" not in entries[0].__fields__
