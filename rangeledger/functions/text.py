"""Descriptions, keys, classes and labels as column expressions."""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rangeledger.functions import fixed


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), pairs, text)


def first_truthy(*values: Column) -> Column:
    """First value that is neither null nor an empty string."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def normal_description(text: Column) -> Column:
    return squeezed(replaced(F.upper(text), ("&", " AND "), (r"[.,()]", " ")))


def security_key(text: Column) -> Column:
    bare = replaced(normal_description(text), *((p, "") for p in fixed.KEY_CUTS))
    return F.left(squeezed(bare), F.lit(fixed.KEY_CHARS))


def stock_key(text: Column) -> Column:
    """The security key without legal suffixes; the key itself if nothing is left."""
    key = security_key(text)
    bare = replaced(key, (fixed.STOCK_TAILS, ""), (fixed.KEY_CUTS[2], ""), (fixed.STOCK_SUFFIXES, ""), (fixed.STOCK_KINDS, ""))
    return F.coalesce(F.nullif(squeezed(bare), F.lit("")), key)


def stock_title(name: Column) -> Column:
    """Title case, with short words and known initials in capitals."""
    keep = F.array(*(F.lit(w) for w in fixed.STOCK_UPPER))
    words = F.transform(
        F.split(F.lower(name), r"\s+"),
        lambda w: F.when(F.array_contains(keep, F.upper(w)) | (F.length(w) <= 2), F.upper(w)).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 20))),
    )
    return F.array_join(words, " ")


def title_case(name: Column, kept: list[str] | None = None) -> Column:
    """Each word with a capital; words of ``kept`` as they are written there."""
    known = F.create_map(*(F.lit(x) for w in (kept or ["LLC", "LP", "NA", "USA"]) for x in (w.lower(), w)))
    words = F.transform(F.split(F.lower(F.trim(name)), r"\s+"), lambda w: F.coalesce(F.try_element_at(known, w), F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 20))))
    return F.array_join(words, " ")


def slug(text: Column) -> Column:
    return replaced(F.lower(text), (r"[^a-z0-9]+", "-"), (r"^-|-$", ""))


def stable_id(text: Column) -> Column:
    """32-bit polynomial hash (base 31) of the characters, as 8 hex digits."""
    total = F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda h, c: F.when(c == "", h).otherwise((h * 31 + F.ascii(c)) % F.lit(1 << 32)))
    return F.lower(F.lpad(F.hex(total), 8, "0"))


def sector_of(normal: Column) -> Column:
    """Sector by the first list that has a word of the description, else null."""
    found = None
    for sector, words in fixed.SECTOR_WORDS:
        hit = normal.rlike(rf"\b({words})\b")
        found = F.when(hit, sector) if found is None else found.when(hit, sector)
    return found


def classified(text: Column) -> Column:
    """Struct of normalized_description, asset_type, sector, confidence and flags."""
    normal = normal_description(text)
    sector = sector_of(normal)

    def result(kind: str, of: Column, confidence: Column) -> Column:
        return F.struct(F.lit(kind).alias("asset_type"), of.alias("sector"), confidence.alias("confidence"))

    def known(kind: str, fallback: str, confidence: float) -> Column:
        return result(kind, F.coalesce(sector, F.lit(fallback)), F.lit(confidence))

    equity = result("Equity", F.coalesce(sector, F.lit("Unclassified Equity")), F.when(sector.isNull(), 0.62).otherwise(0.78))
    found = (
        F.when(normal.rlike(fixed.CASH), result("Other", F.lit("Cash & Bank Accounts"), F.lit(0.82)))
        .when(normal.rlike(fixed.MUNICIPAL) & normal.rlike(fixed.BOND), result("Municipal Bond", F.lit("Municipal Bonds"), F.lit(0.9)))
        .when(normal.rlike(fixed.FUND), result("ETF / Fund", F.lit("ETF / Funds"), F.lit(0.88)))
        .when(normal.rlike(fixed.PREFERRED), known("Preferred / Hybrid", "Preferred / Hybrid", 0.82))
        .when(normal.rlike(fixed.BOND), known("Corporate Bond", "Corporate Credit", 0.78))
        .when(normal.rlike(fixed.EQUITY), equity)
        .when(sector.isNotNull(), result("Equity", sector, F.lit(0.66)))
        .otherwise(result("Other", F.lit("Other"), F.lit(0.55)))
    )
    return F.struct(normal.alias("normalized_description"), found.alias("found"))


def class_flags(asset_type: Column, sector: Column, confidence: Column) -> Column:
    by_sector = sector.isin("Other", "Unclassified Equity") | (confidence < 0.7)
    by_type = (asset_type == "Other") & (sector != "Cash & Bank Accounts")
    return F.array_compact(F.array(F.when(by_sector, "Needs sector review"), F.when(by_type, "Needs asset-type review")))


def labels_of(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Sorted labels whose pattern occurs in the lower-cased text."""
    low = F.lower(text)
    return F.array_sort(F.array_compact(F.array(*(F.when(low.rlike(pattern), label) for label, pattern in rules))))


def importance_of(text: Column) -> Column:
    return F.when(text.rlike(fixed.IMPORTANT_3), 3).when(text.rlike(fixed.IMPORTANT_2), 2).otherwise(1)


def clean_html(text: Column) -> Column:
    return squeezed(replaced(text, ("<[^>]*>", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")))


def confidence_label(confidence: Column) -> Column:
    (high, h), (medium, m) = fixed.CONFIDENCE_LABELS
    return F.when(confidence >= high, h).when(confidence >= medium, m).otherwise("Low")


def ticker_mentions(text: Column) -> Column:
    """Sorted distinct $ABC mentions."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\$([A-Z]{1,5})\b"), F.lit(1))))


def summary_of(text: Column) -> Column:
    return F.when(F.length(text) > 260, F.concat(F.left(text, F.lit(257)), F.lit("..."))).otherwise(text)


def issuer_similarity(a: Column, b: Column) -> Column:
    """1 for equal names down to 0: equality, containment, or the better of shared
    words and edit distance (names of up to 48 characters)."""
    ca, cb = (F.regexp_replace(F.upper(x), "[^A-Z0-9]", "") for x in (a, b))
    la, lb = F.length(a), F.length(b)
    inside = (la >= 5) & (lb >= 5) & (F.contains(a, b) | F.contains(b, a))
    wa, wb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    jaccard = F.size(F.array_intersect(wa, wb)) / F.greatest(F.lit(1), F.size(F.array_union(wa, wb)))
    longest = F.greatest(F.length(ca), F.length(cb))
    edit = F.when((F.length(ca) == 0) | (F.length(cb) == 0) | (longest > 48), 0.0).otherwise(1 - F.levenshtein(ca, cb) / longest)
    return (
        F.when((a == "") | (b == ""), 0.0).when(a == b, 0.93).when(ca == cb, 0.91)
        .when(inside, 0.84 + 0.08 * F.least(la, lb) / F.greatest(la, lb)).otherwise(F.greatest(jaccard, 0.92 * edit))
    )


def named_symbol(description: Column, symbols: list[str], names: dict[str, str]) -> Column:
    """The first symbol in the list's order that the text holds anywhere, else that of
    the first name it holds.

    One pass finds the best symbol that begins at each place (a symbol that begins
    another one stands for it only if it comes first); the least rank counts."""
    upper = F.upper(description)
    alternatives = "|".join(re.escape(s) for s in symbols)
    found = F.regexp_extract_all(upper, F.lit(f"(?=({alternatives}))"), F.lit(1))
    order = F.array(*(F.lit(s) for s in symbols))
    first = F.array_min(F.transform(found, lambda s: F.array_position(order, s)))
    by_name = F.coalesce(*(F.when(F.contains(upper, F.lit(name)), symbol) for name, symbol in names.items())) if names else F.lit(None).cast("string")
    return F.coalesce(F.get(order, (first - 1).cast("int")), by_name)
