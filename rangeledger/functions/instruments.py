"""What a bond's description says: dates, coupon, identifiers, issuer, status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rangeledger.functions import fixed
from rangeledger.functions.text import normal_description, replaced, squeezed

STATUS = ["not_applicable", "issuer_context_only", "needs_identifier", "exact"]
REVIEW = ["verified", "needs_review", "rejected"]
RELIABILITY = ["metadata_only", "archived_copy", "official"]


def words_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def found(text: Column, pattern: str) -> Column:
    """The first group of a match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def strongest(order: list[str], *values: Column) -> Column:
    """The value that stands last in ``order``."""
    ranks = [F.coalesce(F.array_position(F.array(*(F.lit(o) for o in order)), v), F.lit(1)) for v in values]
    return F.element_at(F.array(*(F.lit(o) for o in order)), F.greatest(*ranks, F.lit(1)).cast("int"))


def us_date(text: Column) -> Column:
    """ISO text of month/day/year; two-digit years from 70 on are of the last century.

    Only the ranges of month and day are looked at, as in the source rows."""
    part = F.split(text, "/")
    month, day, year = (part[i].try_cast("int") for i in range(3))
    full = F.when(year < 70, year + 2000).when(year < 100, year + 1900).otherwise(year)
    fine = month.between(1, 12) & day.between(1, 31)
    return F.when(fine, F.format_string("%04d-%02d-%02d", full, month, day))


def bond_issuer(normal: Column) -> Column:
    """Issuer's name before what tells of the instrument, words written out and
    places at the end left out."""
    stem = replaced(normal, *((p, " ") for p in fixed.BOND_TAILS))
    alias = words_map(fixed.BOND_ALIASES)
    states = F.array(*(F.lit(w) for w in fixed.STATE_WORDS))
    words = F.transform(F.split(squeezed(stem), r"\s+"), lambda w: F.coalesce(F.try_element_at(alias, w), w))
    words = F.transform(words, lambda w, i: F.when((w == "ST") & (i > 0) & F.array_contains(states, F.get(words, i - 1)), "STATE").otherwise(w))
    places = "|".join(fixed.TRAILING_PLACES)
    return F.nullif(squeezed(F.regexp_replace(F.array_join(words, " "), rf"(?<=\S)(\s+({places}))+$", "")), F.lit(""))


def state_of(issuer: Column) -> Column:
    names = words_map(fixed.STATE_WORDS)
    states = F.filter(F.transform(F.split(issuer, r"\s+"), lambda w: F.try_element_at(names, w)), lambda s: s.isNotNull())
    return F.get(states, F.lit(0))


def municipal_kind(issuer: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, words in reversed(fixed.MUNICIPAL_KINDS):
        kind = F.when(issuer.rlike(rf"\b({words})\b"), name).otherwise(kind)
    return kind


def parsed(description: Column, asset_type: Column) -> Column:
    """Struct of kind, issuer, cusip, isin, figi, coupon, maturity, call date and
    price, yields, state, category, status, review and confidence."""
    raw, normal = F.upper(description), normal_description(description)
    maturity = F.coalesce(us_date(found(raw, fixed.DUE_DATE)), us_date(found(raw, fixed.MATURITY_DATE)))
    call_date = us_date(found(raw, fixed.CALL_DATE))
    numbers = (fixed.COUPON, fixed.CALL_PRICE, fixed.YIELD_TO_CALL, fixed.YIELD_TO_MATURITY)
    coupon, call_price, to_call, to_maturity = (found(raw, p).try_cast("double") for p in numbers)
    own = [found(raw, p) for p in (fixed.CUSIP, fixed.ISIN, fixed.FIGI)]
    known = [F.try_element_at(words_map({d: ids[i] for d, ids in fixed.KNOWN_IDENTIFIERS.items()}), normal) for i in range(3)]
    cusip, isin, figi = (F.coalesce(a, b) for a, b in zip(own, known, strict=True))
    municipal = asset_type == "Municipal Bond"
    bond = asset_type.isin("Corporate Bond", "Municipal Bond", "Preferred / Hybrid")
    signal = bond | maturity.isNotNull() | coupon.isNotNull() | call_date.isNotNull() | F.coalesce(*own).isNotNull()
    issuer = F.when(signal, bond_issuer(normal))
    exact = F.coalesce(cusip, isin, figi).isNotNull()
    status = F.when(exact, "exact").when(bond, "needs_identifier").otherwise("not_applicable")
    review = F.when(known[0].isNotNull(), "verified").when(status == "not_applicable", "verified").otherwise("needs_review")
    score = (
        F.lit(52) + F.when(issuer.isNotNull(), 12).otherwise(0) + F.when(coupon.isNotNull(), 10).otherwise(0) + F.when(maturity.isNotNull(), 10).otherwise(0)
        + F.when(call_date.isNotNull(), 4).otherwise(0) + F.when(exact, 14).otherwise(0)
    )
    callable_ = F.when(call_date.isNotNull() | F.contains(normal, F.lit(" CALLABLE ")), True)
    return F.struct(
        F.when(signal, F.try_element_at(words_map(fixed.INSTRUMENT_KINDS), asset_type)).alias("kind"), issuer.alias("issuer"), cusip.alias("cusip"), isin.alias("isin"), figi.alias("figi"),
        coupon.alias("coupon"), maturity.alias("maturity"), callable_.alias("callable"), call_date.alias("call_date"), call_price.alias("call_price"), to_call.alias("yield_to_call"),
        to_maturity.alias("yield_to_maturity"), F.when(municipal, state_of(issuer)).alias("state"), F.when(municipal, municipal_kind(issuer)).alias("category"),
        status.alias("status"), review.alias("review"), F.when(signal, F.least(F.lit(0.92), score / 100)).otherwise(0.0).alias("confidence"),
    )


def is_generic_url(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike(fixed.GENERIC_URLS), F.lit(False))


def issuer_name(text: Column) -> Column:
    """Issuer of any security: words written out, legal forms and lone letters at
    the end left out."""
    base = squeezed(replaced(normal_description(text), *((p, " ") for p in fixed.ISSUER_NOISE)))
    alias, drop = words_map(fixed.ISSUER_ALIASES), F.array(*(F.lit(s) for s in fixed.ISSUER_SUFFIXES))
    words = F.filter(F.transform(F.split(base, r"\s+"), lambda w: F.coalesce(F.try_element_at(alias, w), w)), lambda w: ~F.array_contains(drop, w))
    return squeezed(F.regexp_replace(F.array_join(words, " "), r"(?<=\S)(\s+[A-Z])+$", ""))


def industry_sector(code: Column, description: Column) -> Column:
    """Sector by the words of an industry's description, else by its code."""
    normal = normal_description(F.coalesce(description, F.lit("")))
    sector = F.lit(None).cast("string")
    number = code.try_cast("int")
    for low, high, name in reversed(fixed.INDUSTRY_CODES):
        sector = F.when(number.between(low, high), name).otherwise(sector)
    for name, words in reversed(fixed.INDUSTRY_WORDS):
        sector = F.when(normal.rlike(rf"\b({words})\b"), name).otherwise(sector)
    return sector


def candidate_coupons(text: Column) -> Column:
    """Numbers below 20 in a candidate's text, mixed fractions as decimals."""
    mixed = F.regexp_extract_all(text, F.lit(fixed.MIXED_FRACTION), F.lit(1))
    whole = F.transform(mixed, lambda m: F.split(m, " ")[0].cast("double") + F.try_divide(F.split(F.split(m, r"\s+")[1], "/")[0].cast("double"), F.split(m, "/")[1].cast("double")))
    plain = F.transform(F.regexp_extract_all(F.regexp_replace(text, fixed.MIXED_FRACTION, " "), F.lit(fixed.CANDIDATE_NUMBER), F.lit(1)), lambda n: n.cast("double"))
    return F.filter(F.concat(whole, plain), lambda n: (n > 0) & (n < 20))


def candidate_dates(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(fixed.CANDIDATE_DATE), F.lit(1)), us_date)
