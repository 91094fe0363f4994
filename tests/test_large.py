"""Steps that must not grow faster than their input, and rows beyond earlier bounds."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rangeledger import queries as q
from rangeledger.functions import money
from rangeledger.operators import documents, holdings
from rangeledger.plans.api import Engine
from rangeledger.sources import tables
from tests.test_queries import SMALL


def test_totals_behind_holdings_are_those_of_their_pairs(spark):
    tx = [("a", None, "Alpha", 1, "2024-01-01"), ("b", "BETA", "x", 2, "2024-01-02"), ("a", "BETA", "y", 3, "2024-01-03"), ("c", "", "beta", 4, "2024-01-04"), ("d", "GAMMA", "g", 5, "2024-01-05")]
    held = [(1, ["b", "zz", "a", "b", None], "GAMMA"), (2, ["zz"], "BETA"), (3, [], "ALPHA"), (4, ["zz"], None), (5, None, "GAMMA"), (6, ["zz"], "nobody")]
    frames = spark.createDataFrame(held, "holding_id int, transaction_ids array<string>, normalized_description string"), spark.createDataFrame(tx, "id string, normalized_description string, description string, ord int, date string")
    got = {(r["holding_id"], r["how"]): (r["n"], r["first_date"], r["last_date"], r["ids"]) for r in holdings.backing_totals(*frames).collect()}
    assert got == {
        (1, "ids"): (3, "2024-01-01", "2024-01-02", ["b", "a", "b"]), (2, "key"): (3, "2024-01-02", "2024-01-04", []), (3, "key"): (1, "2024-01-01", "2024-01-01", []), (5, "key"): (1, "2024-01-05", "2024-01-05", []),
    }


def test_rows_of_five_digits(spark):
    text = "Part 6: Other Assets and Income\n9999. FIRST CO $1,001 - $15,000\n10000. SECOND CO $15,001 - $50,000\n60000. THIRD CO $1,001 - $15,000"
    rows = documents.asset_rows(documents.lines(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    found = documents.asset_holdings(rows).collect()
    assert {(r["number"], r["description"]) for r in found} == {("9999", "FIRST CO"), ("10000", "SECOND CO"), ("60000", "THIRD CO")}


def test_every_source_by_its_link(spark):
    assert q.QUERIES["sources_with_links_first"](spark, SMALL).count() == tables.table(spark, SMALL, "orders").count()


def test_years_do_not_ask_for_the_index(spark, monkeypatch):
    def none(*_):
        raise AssertionError("the index was computed")

    monkeypatch.setattr(Engine, "index", none)
    bundle = Engine(spark, SMALL).facts({})
    assert set(bundle) == {"entries", "citations", "rollups", "years"} and bundle["years"].count() > 0
    with pytest.raises(AssertionError):
        bundle["entries"]


def test_transactions_are_read_once_for_the_holdings(spark):
    assert not any("lineitem" in f for f in q._held(spark, SMALL).inputFiles())


def test_first_row_by_pairs_of_integers_and_of_equal_place(spark):
    rows = [("X CO", "T2", "B", "s2", 7, 1), ("X CO", "T1", "A", "s1", 7, 1), ("X CO", "T0", "0", "s0", 7, 2), ("X CO", "T9", "0", "s0", 8, -3), ("Y CO", "T3", "C", "s3", -5, 3), ("Y CO", "T4", "D", "s4", -5, -2)]
    tx = spark.createDataFrame(rows, "description string, ticker string, asset_type string, sector string, a long, b int")
    tx = tx.select("*", F.struct("a", "b").alias("ord"), F.lit("Sale").alias("type"), F.lit("2024-01-01").cast("date").alias("date"), F.lit(False).alias("late"), money.parse_range(F.lit("$1,001-$15,000")).alias("amount"))
    for given in (tx, tx.withColumn("ord", F.struct(F.col("a").cast("string"), "b")).where("a > 0")):
        got = {r["security_key"]: (r["sample"]["ticker"], r["transaction_count"]) for r in holdings.grouped(given).collect()}
        assert got["X CO"] == ("T1", 4) and got.get("Y CO", ("T4", 2)) == ("T4", 2)


def test_keys_of_distinct_descriptions(spark):
    plan = q.QUERIES["holdings_anti_baseline"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan


def test_documents_are_built_once_for_their_liabilities(spark):
    assert not any("customer" in f for f in q.QUERIES["liability_rows"](spark, SMALL).inputFiles())


@pytest.fixture
def tied_lines(spark, tmp_path):
    """Tables in which two lines of one security share their order and number."""
    day = datetime(2000, 1, 1)
    rows = {
        "part": [(80, "red ring", "Brand#1", "STANDARD", 1, 900.0), (1, "red ring", "Brand#1", "ECONOMY", 1, 900.0)], "supplier": [(1, "S1", 1, 0.0), (2, "S2", 2, 0.0)],
        "nation": [(1, "N1", 1), (2, "N2", 2)], "region": [(1, "EUROPE"), (2, "AFRICA")], "orders": [(n, 1, "O", 1.0, day, "5-LOW") for n in (3, 4)],
        "lineitem": [(3, 80, 1, 2, 1.0, 2000.0, 0.1, 0.0, "N", "O", day), (3, 1, 2, 2, 1.0, 2000.0, 0.1, 0.0, "N", "O", day), (4, 1, 2, 1, 1.0, 2000.0, 0.1, 0.0, "N", "O", day)],
    }
    for name, given in rows.items():
        spark.createDataFrame(given, tables.table(spark, SMALL, name).schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_tied_sources_stand_as_in_the_file(spark, tied_lines):
    got = q.QUERIES["holding_citations"](spark, tied_lines).orderBy("rank").collect()
    assert [(r["rank"], r["cite"]) for r in got] == [(1, "u80"), (2, "h1")]


def test_first_of_tied_lines_is_the_first_in_the_file(spark, tied_lines):
    got = q._held(spark, tied_lines).where("transaction_count > 0").collect()
    assert [(r["asset_type"], r["sector"], r["transaction_count"]) for r in got] == [("STANDARD", "EUROPE", 3)]
    rollups = {(r["kind"], r["key"]): r["purchase_mid"] for r in q.QUERIES["index_rollups"](spark, tied_lines).collect()}
    assert rollups["sector", "EUROPE"] == rollups["asset_type", "STANDARD"] == 3 * 8000.5 and ("sector", "AFRICA") not in rollups


def test_order_numbers_of_the_largest_keys(spark):
    top, low, far = (1 << 63) - 1, (1 << 31) - 1, 10**9 - 1
    rows = [("X CO", "T1", top, low, far), ("X CO", "T0", top, low, far - 1), ("Y CO", "T1", -top - 1, -low - 1, 1), ("Y CO", "T0", -top - 1, -low - 1, 0), ("Z CO", "T0", 1, 1, far), ("Z CO", "T1", 1, 2, 0), ("Z CO", "T2", 2, 1, 0)]
    tx = spark.createDataFrame(rows, "description string, ticker string, a long, b int, c long").select(
        "*", F.struct("a", "b", "c").alias("ord"), F.lit("A").alias("asset_type"), F.lit("s").alias("sector"), F.lit("Sale").alias("type"), F.lit("2024-01-01").cast("date").alias("date"), F.lit(False).alias("late"), money.parse_range(F.lit("$1,001-$15,000")).alias("amount")
    )
    assert {r["sample"]["ticker"] for r in holdings.grouped(tx).collect()} == {"T0"}


def _nation_table(spark, tmp_path, name):
    """A directory with one table of 450 rows of one nation."""
    row = lambda n: (n, f"A{n}", 3, 0.0, "M") if name == "customer" else (n, f"A{n}", 3, 0.0)
    spark.createDataFrame([row(n) for n in range(450)], tables.table(spark, SMALL, name).schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("query, name", [("liability_rows", "customer"), ("liability_columns", "supplier"), ("periodic_line_items", "supplier")])
def test_a_nation_is_one_document(spark, tmp_path, query, name):
    got = q.QUERIES[query](spark, _nation_table(spark, tmp_path, name)).select("doc_id").collect()
    assert len(got) == 450 and {r["doc_id"] for r in got} == {3}
