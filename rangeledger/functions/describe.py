"""Sentences about classes, sectors, sums and transactions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rangeledger.functions import fixed
from rangeledger.functions.instruments import words_map


def asset_type_text(asset_type: Column) -> Column:
    return F.coalesce(F.try_element_at(words_map(fixed.ASSET_TYPE_TEXTS), asset_type), F.lit(fixed.ANY_ASSET_TYPE_TEXT))


def sector_text(sector: Column) -> Column:
    return F.coalesce(F.try_element_at(words_map(fixed.SECTOR_TEXTS), sector), F.lit(fixed.ANY_SECTOR_TEXT))


def sector_sentence(sector: Column, transactions: Column, net_midpoint: Column, companies: Column) -> Column:
    """How much of a sector is shown, which way it goes, and what it is."""
    way = F.when(net_midpoint >= 0, "net buying").otherwise("net selling")
    known = F.when(companies > 0, F.concat(F.format_number(companies, 0), F.lit(" public-company matches"))).otherwise("no public-company matches")
    return F.concat(F.format_number(transactions, 0), F.lit(" visible transactions, "), way, F.lit(" by midpoint estimate, "), known, F.lit(". "), sector_text(sector))


def transaction_sentence(columns: list[str]) -> Column:
    """What a transaction is: type, asset_type, sector, late and confidence, and what is
    known of its security where the columns are there."""
    at = lambda n: F.col(n) if n in columns else F.lit(None).cast("string")
    action = F.when(F.col("type") == "Purchase", "Bought").when(F.col("type") == "Sale", "Sold").otherwise("Reported")
    on = lambda n: F.when(F.coalesce(at(n), F.lit("")) != "", F.concat(F.lit(" on "), at(n))).otherwise("")
    named = lambda n: F.coalesce(at(n), F.lit("")) != ""
    known = F.when(named("resolved_ticker"), F.concat(F.lit("public match "), at("resolved_ticker"), on("resolved_exchange"))).when(
        named("issuer_ticker"), F.concat(F.lit("issuer context "), at("issuer_ticker"), on("issuer_exchange"))
    )
    sure = F.concat(F.floor(F.col("confidence") * 100 + 0.5).cast("string"), F.lit("% classifier confidence"))
    return F.concat(
        action, F.lit(" "), F.lower("asset_type"), F.lit(" exposure in "), F.col("sector"), F.lit("; "), F.when(F.col("late"), "reported late").otherwise("not flagged late"), F.lit("; "), sure,
        F.lit("; "), known.otherwise("no public-security match"), F.lit("."), F.when(named("instrument_summary"), F.concat(F.lit(" "), at("instrument_summary"))).otherwise(""),
    )
