"""Request filters as conjunctive predicates that reach the scan."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSET_PAGES = {"equities": "Equity", "corporate-bonds": "Corporate Bond", "municipal-bonds": "Municipal Bond", "funds": "ETF / Fund", "preferred": "Preferred / Hybrid", "other": "Other"}


@dataclass(frozen=True)
class Filters:
    year: str | None = None
    start_date: str | None = None
    end_date: str | None = None
    asset_type: str | None = None
    sector: str | None = None
    transaction_type: str | None = None
    late_only: bool = False
    confidence: float | None = None
    query: str | None = None
    ticker: str | None = None
    issuer: str | None = None

    @classmethod
    def from_params(cls, params: Mapping[str, str]) -> Filters:
        """Trimmed parameters; empty ones are off, what is no number is none."""
        found: dict = {}
        for field in fields(cls):
            words = field.name.split("_")
            raw = (params.get(words[0] + "".join(w.title() for w in words[1:])) or "").strip()
            if field.name == "late_only":
                found[field.name] = raw == "true"
            elif field.name == "confidence":
                try:
                    found[field.name] = float(raw) if raw else None
                except ValueError:
                    found[field.name] = None
            else:
                found[field.name] = raw or None
        return cls(**found)

    def for_page(self, page: str) -> Filters:
        """Asset pages fix the asset type; the timing page looks at all dates."""
        changed = {f.name: getattr(self, f.name) for f in fields(self)}
        if page in ASSET_PAGES:
            changed["asset_type"] = ASSET_PAGES[page]
        if page == "timing":
            changed |= {"year": None, "start_date": None, "end_date": None}
        return Filters(**changed)


def field_text(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The named columns in small letters, in their order, with a space after each; a
    missing value is empty, lists give their members, what the table lacks is left out."""
    parts = []
    for field in (df.schema[n] for n in names if n in df.columns):
        column = F.col(field.name)
        parts.append(column if isinstance(field.dataType, T.ArrayType) else F.coalesce(column.cast("string"), F.lit("")))
    return F.lower(F.concat_ws(" ", *parts))


#: What words are sought in, of transactions, holdings and index entries, in this order (fixed values).
INSTRUMENT_FIELDS = ("instrument_issuer", "instrument_state", "instrument_category", "instrument_label", "instrument_source")
TEXT_FIELDS = (
    "description", "ticker", "resolved_ticker", "issuer_ticker", "resolved_issuer", "issuer_context", *INSTRUMENT_FIELDS, "instrument_summary", "resolved_exchange", "issuer_exchange", "resolved_cik", "issuer_cik",
    "resolved_sector", "issuer_sector", "sector", "asset_type", "flags", "instrument_flags", "issuer_flags",
)
HOLDING_FIELDS = ("description", "resolved_ticker", "issuer_ticker", "resolved_issuer", "issuer_context", *INSTRUMENT_FIELDS, "instrument_summary", "sector", "asset_type")
ENTRY_FIELDS = ("resolved_issuer", "issuer_context", *INSTRUMENT_FIELDS, "display", "instrument_summary")
ISSUER_FIELDS = ("resolved_issuer", "issuer_context", "instrument_issuer", "description")


def predicate(df: DataFrame, f: Filters) -> Column:
    """All filters that are on; words are sought as they are, not as patterns."""
    on = lambda v: v is not None and v != "All"
    parts: list[Column] = []
    if on(f.year):
        whole = str(f.year).isdigit() and len(str(f.year)) == 4
        # A span of dates reaches the scan, the year of a date does not.
        span = F.col("date").between(F.lit(f"{f.year}-01-01").cast("date"), F.lit(f"{f.year}-12-31").cast("date")) if whole else F.col("date").cast("string").startswith(str(f.year))
        parts.append(span)
    if f.start_date:
        parts.append(F.col("date") >= F.lit(f.start_date).cast("date"))
    if f.end_date:
        parts.append(F.col("date") <= F.lit(f.end_date).cast("date"))
    parts += [F.col(c) == v for c, v in (("asset_type", f.asset_type), ("sector", f.sector), ("type", f.transaction_type)) if on(v)]
    if f.late_only:
        parts.append(F.col("late"))
    if f.confidence is not None and "confidence" in df.columns:
        parts.append(F.col("confidence") >= f.confidence)
    if f.query:
        parts.append(F.contains(field_text(df, TEXT_FIELDS), F.lit(f.query.strip().lower())))
    if on(f.ticker):
        tickers = F.array_compact(F.array(*(F.upper(c) for c in ("resolved_ticker", "ticker", "issuer_ticker") if c in df.columns)))
        parts.append(F.array_contains(tickers, f.ticker.upper()))
    if f.issuer:
        parts.append(F.contains(field_text(df, ISSUER_FIELDS), F.lit(f.issuer.strip().lower())))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def filtered(df: DataFrame, f: Filters) -> DataFrame:
    return df.where(predicate(df, f))
