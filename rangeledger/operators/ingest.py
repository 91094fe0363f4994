"""Landed rows to typed transactions, sources and reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeledger.functions import fixed, money
from rangeledger.functions.text import class_flags, classified, stable_id


def transaction_type(raw: Column) -> Column:
    """By the first word of what a source writes."""
    low = F.lower(F.trim(raw))
    return F.when(low.startswith("purchase"), "Purchase").when(low.startswith("sale"), "Sale").when(low.startswith("exchange"), "Exchange").otherwise("Other")


def clean_ticker(raw: Column) -> Column:
    return F.nullif(F.upper(F.trim(raw)), F.lit(""))


def normalized(rows: DataFrame) -> DataFrame:
    """Source rows (position, description, ticker, type, date, amount as written,
    late, url) as transactions with class, range, flags and a stable id.

    Where many rows share a description, ``c`` may hold its class (of
    :func:`classified`), found before rows are joined to it."""
    kind = transaction_type(F.col("type"))
    known = F.col("c") if "c" in rows.columns else classified(F.col("description"))
    typed = rows.withColumns({"c": known, "range": money.parse_range(F.col("amount")), "kind": kind})
    flags = F.concat(
        class_flags(F.col("c.found.asset_type"), F.col("c.found.sector"), F.col("c.found.confidence")),
        F.when(F.col("range.midpoint") == 0, F.array(F.lit("Unknown amount range"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("kind") == "Other", F.array(F.concat(F.lit("Unexpected transaction type: "), "type"))).otherwise(F.array().cast("array<string>")),
    )
    key = F.concat_ws("|", "description", F.coalesce("ticker", F.lit("")), "kind", F.col("date").cast("string"), "range.label", F.col("position").cast("string"))
    return typed.select(
        stable_id(key).alias("id"), "position", "description", F.col("c.normalized_description").alias("normalized_description"), clean_ticker(F.col("ticker")).alias("ticker"),
        F.col("kind").alias("type"), "date", F.col("range").alias("amount"), F.coalesce("late", F.lit(False)).alias("late"), F.col("url").alias("source_url"),
        F.col("c.found.asset_type").alias("asset_type"), F.col("c.found.sector").alias("sector"), F.col("c.found.confidence").alias("confidence"), flags.alias("flags"),
    )


def link_of(html: Column) -> Column:
    """Target of the first link of a cell."""
    return F.nullif(F.regexp_extract(html, r"href=[\"']([^\"']+)[\"']", 1), F.lit(""))


def is_pdf(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)\.pdf(?:$|\?)"), F.lit(False))


def year_named(text: Column) -> Column:
    """The first year of this or the last century in a title."""
    return F.nullif(F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")


def supported_records(records: DataFrame, name: str, types: str, since: str = "2015-01-01") -> DataFrame:
    """Source records of a filer by pattern, of supported types, from a date on."""
    return records.where(F.col("filer").rlike(f"(?i){name}") & F.col("type").rlike(f"(?i){types}") & (F.col("filed_date") >= F.lit(since).cast("date")))


def reliability_rank(c: Column) -> Column:
    return F.when(c == "official", 3).when(c == "archived_copy", 2).otherwise(1)


def parseable_sources(sources: DataFrame) -> DataFrame:
    """Reports whose document can be parsed: a supported type, a PDF, not failed."""
    return sources.where(F.col("filing_type").isin(fixed.PARSED_FILINGS) & is_pdf(F.col("url")) & (F.col("status") != "failed"))


def latest_source(sources: DataFrame, filing_type: str) -> DataFrame:
    """The newest source of a type that has a document; the more reliable first."""
    fine = sources.where((F.col("filing_type") == filing_type) & (F.coalesce("url", F.lit("")) != "") & (F.col("status") != "failed"))
    return fine.orderBy(F.col("filed_date").desc(), reliability_rank(F.col("reliability")).desc(), "source_id").limit(1)


def filtered_sources(sources: DataFrame, year: str | None = None, reliability: str | None = None) -> DataFrame:
    """Sources of a year, by their report or their filing, and of a reliability."""
    if year and year != "All":
        of_year = F.col("report_year") == int(year) if year.isdigit() else F.lit(False)
        sources = sources.where(F.coalesce(of_year, F.lit(False)) | F.col("filed_date").cast("string").startswith(year))
    if reliability and reliability != "All":
        sources = sources.where(F.col("reliability") == reliability)
    return sources


def reports(sources: DataFrame, assets: DataFrame, liabilities: DataFrame) -> DataFrame:
    """Every source but periodic ones with the rows parsed from it; counts are
    summed before they are joined."""
    count = lambda df, n: df.groupBy("source_id").agg(F.count("*").alias(n))
    rows = sources.where(F.col("filing_type") != "278-T").join(count(assets, "assets"), "source_id", "left").join(count(liabilities, "liabilities"), "source_id", "left")
    none = F.lit(0).cast("long")
    rows = rows.withColumns({"assets": F.coalesce("assets", none), "liabilities": F.coalesce("liabilities", none)})
    return rows.withColumn("parser_status", F.when(F.col("assets") + F.col("liabilities") > 0, "parsed").otherwise("needs-review"))


def unregistered(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Official records that no registered source stands for, by URL."""
    return records.join(registry.select("url").where("url is not null").distinct(), "url", "left_anti")


def baseline_of_assets(assets: DataFrame) -> DataFrame:
    """Asset rows with a value as a baseline, marked for review."""
    flags = F.array_distinct(F.concat("flags", F.array(F.lit(fixed.BASELINE_FLAG))))
    key = F.concat_ws("|", F.lit("baseline-holding"), F.col("source_id").cast("string"), "normalized_description", "value.label")
    return assets.where("value.midpoint > 0").select(
        stable_id(key).alias("baseline_id"), "description", "normalized_description", "value", "asset_type", "sector", F.col("source_id").alias("source_filing_id"),
        F.least("confidence", F.lit(fixed.BASELINE_CAP)).alias("confidence"), flags.alias("flags"),
    )


def available_years(transactions: DataFrame, sources: DataFrame) -> DataFrame:
    """Years of either table once, the newest first."""
    a = transactions.select(F.year("date").alias("year"))
    b = sources.select(F.coalesce("report_year", F.year("filed_date")).alias("year"))
    return a.unionByName(b).where("year is not null").distinct().orderBy(F.col("year").desc())


def resolved_numbers(transactions: DataFrame) -> DataFrame:
    """Distinct company numbers of transactions and of their issuers, ascending."""
    return transactions.select(F.explode(F.array_compact(F.array("resolved_cik", "issuer_cik"))).alias("cik")).distinct().orderBy("cik")


#: Figures of a cache: name, table, and what is counted of it ('' for its rows) or an aggregate.
FIGURES = [
    ("source_filing_count", "filings", ""), ("transaction_count", "transactions", ""), ("baseline_holding_count", "baseline", ""), ("estimated_holding_count", "holdings", ""), ("review_queue_count", "review", ""),
    ("late_transaction_count", "transactions", "late"), ("security_reference_count", "reference", ""), ("security_enrichment_count", "enrichments", ""),
    ("instrument_context_count", "transactions", "coalesce(instrument_summary, '') <> '' OR coalesce(issuer_ticker, '') <> ''"), ("fixed_income_identifier_count", "identifiers", ""),
    ("fixed_income_figi_match_count", "identifiers", "status = 'matched'"), ("fixed_income_identifier_ambiguous_count", "identifiers", "status = 'ambiguous'"), ("instrument_identity_count", "identities", ""),
    ("exact_instrument_reference_count", "identities", "status = 'exact' AND coalesce(reference_url, '') <> ''"), ("identifier_review_count", "identities", "status = 'needs_identifier' OR review = 'needs_review'"),
    ("annual_baseline_matched_count", "holdings", "NOT missing_baseline"), ("annual_baseline_missing_count", "holdings", "missing_baseline"), ("enriched_transaction_count", "transactions", "coalesce(resolved_ticker, '') <> ''"),
    ("event_count", "events", ""), ("event_window_count", "windows", ""), ("historical_source_count", "historical", ""), ("financial_disclosure_report_count", "reports", ""), ("asset_income_holding_count", "assets", ""),
    ("liability_count", "liabilities", ""), ("index_count", "index", ""),
]


def cache_figures(frames: Mapping[str, DataFrame]) -> DataFrame:
    """One row of all figures of a cache; tables that are not given, and conditions on
    columns that a table lacks, count none.  Every table is read once, its counts are
    combined in the tasks; data_through is the last filing's date and
    estimated_midpoint the sum of the transactions' midpoints."""
    out = None
    for table in dict.fromkeys(t for _, t, _ in FIGURES):
        if table not in frames:
            continue
        df = frames[table]
        for name in ("instrument_summary", "issuer_ticker", "resolved_ticker", "reference_url"):
            if name not in df.columns:
                df = df.withColumn(name, F.lit(None).cast("string"))
        wanted = [F.count("*").alias(n) if not when else F.count_if(F.expr(when)).alias(n) for n, t, when in FIGURES if t == table]
        if table == "filings" and "filed_date" in df.columns:
            wanted.append(F.max("filed_date").alias("data_through"))
        if table == "transactions":
            wanted.append(F.coalesce(F.sum("amount.midpoint"), F.lit(0.0)).alias("estimated_midpoint"))
        row = df.agg(*wanted)
        out = row if out is None else out.crossJoin(F.broadcast(row))
    if out is None:
        raise ValueError("none of the tables that figures are made of is given")
    rest = {"data_through": F.lit(None).cast("date"), "estimated_midpoint": F.lit(0.0)} | {n: F.lit(0).cast("long") for n, _, _ in FIGURES}
    return out.select("*", *(value.alias(n) for n, value in rest.items() if n not in out.columns))


def cache_meta(frames: Mapping[str, DataFrame], conditions: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row of counts: of each table, and of each table's rows under a condition.

    Every table is read once; the one-row results are joined."""
    out = None
    for name, df in frames.items():
        counts = [F.count("*").alias(name)] + [F.count_if(F.expr(when)).alias(label) for label, (table, when) in conditions.items() if table == name]
        row = df.agg(*counts)
        out = row if out is None else out.crossJoin(F.broadcast(row))
    return out
