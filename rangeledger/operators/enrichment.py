"""Securities with what the reference lists and identifier caches say of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeledger.functions import fixed, instruments, order
from rangeledger.functions.text import security_key, stable_id


def with_industry(reference: DataFrame, industries: DataFrame) -> DataFrame:
    """Reference rows with industry code, description and sector by company number;
    what has none keeps its own."""
    own = industries.select(F.col("cik").alias("n"), F.struct("sic", "sic_description", "sector").alias("i")).groupBy("n").agg(F.first("i").alias("i"))
    rows = reference.join(own, reference["cik"] == own["n"], "left").drop("n")
    for name in ("sic", "sic_description", "sector"):
        kept = F.col(name) if name in reference.columns else F.lit(None)
        rows = rows.withColumn(name, F.when(F.col("i").isNotNull(), F.col(f"i.{name}")).otherwise(kept))
    return rows.drop("i")


def applied(transactions: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Transactions with their security's resolution.

    A resolved sector replaces the classified one for what is accepted, which also
    lifts the confidence and takes back the wish for a sector review."""
    rows = transactions.withColumn("security_key", security_key(F.col("description"))).join(resolutions, "security_key", "left")
    enough = F.when(F.col("asset_type") == "Equity", fixed.EQUITY_ACCEPTS).otherwise(fixed.OTHER_ACCEPTS)
    use = F.col("resolved_sector").isNotNull() & F.col("resolved_ticker").isNotNull() & ~F.col("asset_type").isin("Municipal Bond", "ETF / Fund") & (F.col("match_confidence") >= enough)
    use = F.coalesce(use, F.lit(False))
    sector = F.when(use, F.col("resolved_sector")).otherwise(F.col("sector"))
    all_flags = F.array_union("flags", F.coalesce("match_flags", F.array().cast("array<string>")))
    flags = F.when(use & (sector != "Unclassified Equity"), F.array_except(all_flags, F.array(F.lit("Needs sector review")))).otherwise(all_flags)
    lifted = F.when(use, F.greatest("confidence", F.least(F.lit(0.92), "match_confidence"))).otherwise(F.col("confidence"))
    return rows.withColumns({"sector": sector, "flags": flags, "confidence": lifted})


def security_groups(transactions: DataFrame) -> DataFrame:
    """One row per security key and source ticker: first row's fields, its count and
    the asset types it comes under."""
    rows = transactions.withColumns({"security_key": security_key(F.col("description")), "source_ticker": F.coalesce("ticker", F.lit(""))})
    return rows.groupBy("security_key", "source_ticker").agg(
        F.min_by("description", "ord").alias("description"), F.count("*").alias("transaction_count"), F.array_sort(F.collect_set("asset_type")).alias("asset_types"), F.sum("amount.midpoint").alias("midpoint"),
    ).withColumn("group_id", stable_id(F.concat_ws("|", F.lit("security-enrichment"), "security_key", "source_ticker")))


def lookup_groups(transactions: DataFrame, kinds: list[str]) -> DataFrame:
    """Securities of the kinds that need an identifier, the largest first."""
    rows = transactions.where(F.col("asset_type").isin(kinds)).withColumn("security_key", security_key(F.col("description")))
    grouped = rows.groupBy("security_key").agg(F.min_by("description", "ord").alias("description"), F.count("*").alias("transaction_count"), F.sum("amount.midpoint").alias("midpoint"))
    return grouped.orderBy(*order.lookup_order())


def merged_cache(groups: DataFrame, cache: DataFrame, looked_up: DataFrame, limit: int) -> DataFrame:
    """An identifier cache brought up to date.

    A group whose cached row has not failed keeps it with its own counts; of the
    others the first ``limit`` in lookup order take what was looked up (failed if
    nothing was), the rest are not queried; cached rows that no group asks for stay."""
    old = cache.select("security_key", F.struct("status", "figi").alias("old"))
    new = looked_up.select("security_key", F.struct("status", "figi").alias("new"))
    rows = groups.join(old, "security_key", "left")
    kept = rows.where("old.status <> 'failed'").select("security_key", "midpoint", "transaction_count", "old.status", "old.figi")
    wanted = rows.where("old is null or old.status = 'failed'")
    # Only the first of the wanted are numbered: the limit bounds what is brought together.
    first = wanted.orderBy(*order.lookup_order()).limit(limit)
    asked = first.join(new, "security_key", "left").select("security_key", "midpoint", "transaction_count", F.coalesce("new.status", F.lit("failed")).alias("status"), "new.figi")
    rest = wanted.join(first.select("security_key"), "security_key", "left_anti").select("security_key", "midpoint", "transaction_count", F.lit("not_queried").alias("status"), F.lit(None).cast("string").alias("figi"))
    unseen = cache.join(groups.select("security_key"), "security_key", "left_anti").select("security_key", "midpoint", "transaction_count", "status", "figi")
    return kept.unionByName(asked).unionByName(rest).unionByName(unseen)


def identifiers_applied(transactions: DataFrame, cache: DataFrame, kinds: list[str]) -> DataFrame:
    """Transactions of the kinds that lack identifiers with a matched one of their
    security; all others as they are."""
    matched = cache.where("status = 'matched' and figi is not null").select("security_key", F.col("figi").alias("found"))
    rows = transactions.withColumn("security_key", security_key(F.col("description"))).join(matched, "security_key", "left")
    bare = F.coalesce("cusip", "isin", "figi").isNull() & F.col("asset_type").isin(kinds)
    use = F.col("found").isNotNull() & bare
    flags = F.array_union(F.array_except("flags", F.array(F.lit("No CUSIP/ISIN parsed"))), F.array(F.lit(fixed.FIGI_FLAG)))
    return rows.withColumns({"figi": F.when(use, F.col("found")).otherwise(F.col("figi")), "flags": F.when(use, flags).otherwise(F.col("flags")), "reference_status": F.when(use, "exact").otherwise(F.col("reference_status"))}).drop("found")


def merged_context(first: str, second: str, plain: list[str]) -> list[Column]:
    """Fields of two structs as one: the first that is there, the stronger status and
    review, the higher confidence, flags of both."""
    out = [F.coalesce(f"{first}.{c}", f"{second}.{c}").alias(c) for c in plain]
    none = F.array().cast("array<string>")
    return out + [
        instruments.strongest(instruments.STATUS, F.col(f"{first}.status"), F.col(f"{second}.status")).alias("status"),
        instruments.strongest(instruments.REVIEW, F.col(f"{first}.review"), F.col(f"{second}.review")).alias("review"),
        F.greatest(F.coalesce(f"{first}.confidence", F.lit(0.0)), F.coalesce(f"{second}.confidence", F.lit(0.0))).alias("confidence"),
        F.array_distinct(F.concat(F.coalesce(f"{first}.flags", none), F.coalesce(f"{second}.flags", none))).alias("flags"),
    ]


def plain_number(value: Column, places: int = 3) -> Column:
    """A number with at most ``places`` decimals and no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{places}f", value), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def instrument_sentence(issuer: Column, p: str) -> Column:
    """What a parsed instrument (a struct column) is, in a sentence."""
    col = lambda n: F.col(f"{p}.{n}")
    said = lambda c, text: F.when(c.isNotNull(), text)
    call = F.concat_ws(" ", F.lit("callable"), col("call_date"), said(col("call_price"), F.concat(F.lit("at "), plain_number(col("call_price")))))
    facts = F.array_compact(F.array(
        said(col("coupon"), F.concat(plain_number(col("coupon")), F.lit("% coupon"))), said(col("maturity"), F.concat(F.lit("due "), col("maturity"))), F.when(col("callable"), call),
        said(col("yield_to_call"), F.concat(plain_number(col("yield_to_call")), F.lit("% yield to call"))), said(col("yield_to_maturity"), F.concat(plain_number(col("yield_to_maturity")), F.lit("% yield to maturity"))),
        said(col("cusip"), F.concat(F.lit("CUSIP "), col("cusip"))), said(col("isin"), F.concat(F.lit("ISIN "), col("isin"))), said(col("figi"), F.concat(F.lit("FIGI "), col("figi"))),
    ))
    subject = F.coalesce(F.nullif(F.concat_ws(" ", F.nullif(issuer, F.lit("")), col("kind")), F.lit("")), F.lit("Instrument"))
    return F.concat(subject, F.when(F.size(facts) > 0, F.concat(F.lit(" ("), F.array_join(facts, "; "), F.lit(")"))).otherwise(""), F.lit("."))


def exchange_name(code: Column) -> Column:
    """An exchange by its one-letter code; other codes as they are."""
    return F.coalesce(F.try_element_at(instruments.words_map(fixed.EXCHANGES), code), F.nullif(code, F.lit("")))
