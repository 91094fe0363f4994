"""The review queue: what a person should look at, by five rules in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeledger.functions import order

#: Holdings and identities looked at, and items in all (fixed values).
LOOKED_AT, ITEMS = 200, 500
LOW_CONFIDENCE, POOR_CONFIDENCE = 0.7, 0.6
HIGH_PRIORITY, MEDIUM_PRIORITY = 130, 95


def _items(rows: DataFrame, source: int, keys: list[Column], kind: str, severity: Column, related: Column, detail: Column) -> DataFrame:
    """A rule's items in its own order; no more than ``ITEMS`` of them can be shown,
    so only that many are numbered."""
    shown = rows.select(severity.alias("severity"), F.lit(kind).alias("kind"), related.cast("string").alias("related_id"), detail.alias("detail"), *(o.alias(f"_o{i}") for i, (o, _) in enumerate(keys)))
    by = [F.col(f"_o{i}").desc() if down else F.col(f"_o{i}").asc() for i, (_, down) in enumerate(keys)]
    few = shown.orderBy(*by).limit(ITEMS)
    return few.withColumn("seq", F.row_number().over(Window.orderBy(*by))).select(F.lit(source).alias("source"), "seq", "severity", "kind", "related_id", "detail")


def review_queue(filings: DataFrame, transactions: DataFrame, baseline: DataFrame, holdings: DataFrame, identities: DataFrame | None = None) -> DataFrame:
    """source (rank of the rule), seq, severity, kind, related_id, detail; the first 500.

    1 filings that failed or need review; 2 one item if there is no baseline at
    all; 3 transactions with flags or low confidence; 4 holdings without a baseline
    among the first 200; 5 identities without identifier or in review among the
    first 200."""
    status = F.col("status")
    rule1 = _items(filings.where(status.isin("failed", "needs-review")), 1, [(F.col("ord"), False)], "source", F.when(status == "failed", "high").otherwise("medium"), F.col("source_id"), F.col("title"))
    none = baseline.agg(F.count("*").alias("n")).where("n = 0")
    rule2 = none.select(F.lit(2).alias("source"), F.lit(1).alias("seq"), F.lit("high").alias("severity"), F.lit("baseline").alias("kind"), F.lit(None).cast("string").alias("related_id"), F.lit("Annual baseline not parsed").alias("detail"))
    flagged = transactions.where((F.size("flags") > 0) | (F.col("confidence") < LOW_CONFIDENCE))
    reason = F.coalesce(F.nullif(F.array_join("flags", ", "), F.lit("")), F.lit("Low confidence"))
    rule3 = _items(flagged, 3, [(F.col("ord"), False)], "classification", F.when(F.col("confidence") < POOR_CONFIDENCE, "high").otherwise("medium"), F.col("id"), F.concat_ws(" | ", "description", reason))
    first = holdings.orderBy(*order.holding_order()).limit(LOOKED_AT)
    ranks = [(F.col("current.midpoint"), True), (F.col("transaction_count"), True), (F.collate("description", "UNICODE"), False), (F.col("description"), False), (F.col("security_key"), False)]
    rule4 = _items(first.where("missing_baseline"), 4, ranks, "baseline", F.lit("low"), F.col("security_key"), F.col("description"))
    rules = [rule1, rule2, rule3, rule4]
    if identities is not None:
        ranks = [(F.col("priority"), True), (F.col("score"), True), (F.col("current_mid"), True), (F.collate("display", "UNICODE"), False), (F.col("display"), False), (F.col("key"), False)]
        top = identities.orderBy(*order.identity_order()).limit(LOOKED_AT)
        need = top.where((F.col("status") == "needs_identifier") | (F.col("review") == "needs_review"))
        grade = F.when(F.col("priority") >= HIGH_PRIORITY, "high").when(F.col("priority") >= MEDIUM_PRIORITY, "medium").otherwise("low")
        rules.append(_items(need, 5, ranks, "identifier", grade, F.col("identity_id"), F.col("display")))
    return reduce(DataFrame.unionByName, rules).orderBy("source", "seq").limit(ITEMS)
