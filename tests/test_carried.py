"""What lines of transactions carry through the joins, and what is made of it."""

from pyspark.sql import functions as F

from rangeledger.functions import money
from rangeledger.operators import events
from rangeledger.sources import tables

SMALL = "/root/testdata/sf0.001"


def test_lines_are_made_small_before_they_are_joined(spark):
    rows = tables.transactions(spark, SMALL).select("description", "amount", "flags", "date")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "bracket#" in above
    assert not any(wide in above for wide in ("l_extendedprice#", "l_quantity#", "l_discount#", "l_shipdate#"))


def test_numbers_of_brackets_make_the_brackets(spark):
    edges = [b[2] for b in money.BRACKETS if b[2] is not None]
    values = [None, float("nan"), float("inf"), -1.0, 0.0, 1000.99, 1001.0, *(e + x for e in edges for x in (-0.5, 0.0, 0.5))]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    both = rows.select("v", money.bracket_of(F.col("v")).alias("a"), money.numbered_range(money.bracket_number(F.col("v"))).alias("b"))
    assert both.schema["a"].dataType == both.schema["b"].dataType and both.schema["a"].nullable == both.schema["b"].nullable
    assert all(r["a"] == r["b"] for r in both.collect())


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_descriptions_are_classified_before_lines_are_joined(spark):
    from rangeledger.queries import QUERIES

    plan = _plan(QUERIES["normalized_transactions"](spark, SMALL))
    above, below = plan[: plan.index("Join")], plan[plan.index("Join") :]
    assert "CASH" in below and "CASH" not in above


def test_parts_are_dealt_to_all_tasks_before_the_cascade(spark):
    from rangeledger.queries import QUERIES

    assert "Repartition" in _plan(QUERIES["identifier_cascade"](spark, SMALL))


def test_indicators_of_one_id_are_ranked_alike_in_every_run(spark):
    rows = [("policy-A-x", "high", "A", f"n{i % 3}", float(i % 5), 0.7) for i in range(15)] + [("fed-1", "high", None, "f", 9.0, 0.5)]
    for order in (rows, rows[::-1]):
        found = spark.createDataFrame(order, "indicator_id string, severity string, ticker string, holding string, value double, evidence double")
        for parts in (1, 5):
            shown = events.ranked_conflicts(found.repartition(parts), 5).collect()
            assert [(r["value"], r["holding"]) for r in shown] == [(4.0, "n0"), (4.0, "n1"), (4.0, "n2"), (3.0, "n0"), (3.0, "n1")]
