"""Entry points: pages, bootstrap, full response, conflicts, market, facts, build.

Each returns lazy DataFrames by name; a page plans only the tables it shows."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeledger.functions import fixed, order
from rangeledger.functions.text import security_key
from rangeledger.operators import documents, enrichment, events, filters, holdings, ingest, liabilities, resolution, review, sectors, timeline
from rangeledger.operators.filters import Filters
from rangeledger.plans.stages import Parts, cut, stages
from rangeledger.sources import sinks, tables
from rangeledger.sources.versions import VersionStore

# Rows a page shows at most (fixed values).
BOOTSTRAP_ROWS, INDEX_ROWS, TRANSACTION_ROWS, REVIEW_ROWS = 80, 600, 1000, 500
FACT_ENTRIES, FACT_SECTORS, FACT_YEARS, FACT_CITATIONS = 12, 10, 12, 12
CONFLICT_ROWS = 100
PAGES = (
    "overview", "index", "equities", "corporate-bonds", "municipal-bonds", "funds", "preferred", "other", "holdings", "sectors", "timing", "transactions", "filings", "identifier-review",
    "conflicts", "review",
)


class Engine:
    """Queries over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, built: str | None = None, version: str | None = None) -> None:
        """``built`` is the folder :meth:`build` has written versions to; the first screen
        is read from the newest one, or from ``version``, instead of being computed."""
        self.spark, self.sf_dir, self.version = spark, sf_dir, version
        self.store = VersionStore(spark, built) if built else None

    def _stored(self, name: str) -> DataFrame:
        return self.store.table(name, self.version)

    def transactions(self, f: Filters) -> DataFrame:
        return filters.filtered(tables.transactions(self.spark, self.sf_dir), f)

    def holdings(self, f: Filters) -> DataFrame:
        return holdings.estimated(holdings.grouped(self.transactions(f)), tables.baseline(self.spark, self.sf_dir))

    def index(self, f: Filters) -> DataFrame:
        """Entries of the holdings that pass the filters of type, sector and words;
        scores are scaled to these, so a filter changes them.  Ticker and issuer only
        choose among the scored."""
        return self._entries(self.holdings(f), f)

    @staticmethod
    def _entries(held: DataFrame, f: Filters) -> DataFrame:
        chosen = holdings.filtered_holdings(held, f.asset_type, f.sector, f.query)
        return holdings.filtered_entries(holdings.scored(chosen), ticker=f.ticker, issuer=f.issuer)

    def identities(self) -> DataFrame:
        return resolution.identities(tables.instrument_entries(self.spark, self.sf_dir))

    def review(self) -> DataFrame:
        """The review queue over everything."""
        return self._review(cut(self.holdings(Filters())), cut(self.identities()))

    def _review(self, held: DataFrame, identities: DataFrame) -> DataFrame:
        spark, d = self.spark, self.sf_dir
        return review.review_queue(tables.filings(spark, d), tables.transactions(spark, d), tables.baseline(spark, d), held, identities)

    def conflicts(self, dated: DataFrame, tx: DataFrame | None = None, policies: DataFrame | None = None, triggers: DataFrame | None = None, sensitive: Column | None = None) -> dict[str, DataFrame]:
        """Possible conflicts of all holdings with dated events (event_id, date,
        category, title, summary): the ranked indicators, their summary, and their
        counts by category and severity.  No filter applies.

        ``policies`` (ticker, categories) and ``triggers`` (sector, triggers, words)
        are the fixed ones unless given; ``sensitive`` tells what rates move."""
        policies = self.spark.createDataFrame(list(fixed.POLICY_TICKERS.items()), "ticker string, categories array<string>") if policies is None else policies
        triggers = self.spark.createDataFrame(fixed.SECTOR_TRIGGERS, "sector string, triggers array<string>, words array<string>") if triggers is None else triggers
        sensitive = ((F.col("sector") == "Financials") | F.coalesce(F.col("ticker").isin(fixed.RATE_TICKERS), F.lit(False))) if sensitive is None else sensitive
        held = cut(self.holdings(Filters()).select(F.col("security_key").alias("holding_id"), "ticker", F.lit(None).cast("string").alias("issuer_ticker"), F.col("description").alias("name"), "sector", F.col("current.midpoint").alias("value")))
        trades = self.transactions(Filters()).withColumn("issuer_ticker", F.lit(None).cast("string")) if tx is None else tx
        timing = events.timing_conflicts(held, dated, trades, triggers).drop("related", "before")
        rate = events.rate_conflicts(held, dated.where("category = 'fed'").select("event_id"), sensitive)
        found = cut(events.policy_conflicts(held, policies).unionByName(rate).unionByName(timing))
        shown = events.ranked_conflicts(found, CONFLICT_ROWS)
        return {"indicators": shown, "details": events.detailed(shown, held, dated, trades), "summary": events.conflict_summary(found, CONFLICT_ROWS), "groups": events.conflicts_by(found, "category", "severity", n=CONFLICT_ROWS)}

    @staticmethod
    def _first(index: DataFrame, n: int) -> DataFrame:
        return index.orderBy(*order.index_order()).limit(n)

    def page(self, name: str, params: Mapping[str, str]) -> dict[str, DataFrame]:
        if name not in PAGES:
            raise ValueError(f"no page {name}")
        f = Filters.from_params(params).for_page(name)
        tx = self.transactions(f)
        out = {"kpis": sectors.kpis(tx)}
        if name in ("overview", "sectors"):
            out["sectors"] = sectors.sector_order(sectors.sector_summary(tx))
        if name in ("overview", "timing"):
            out["flow"] = timeline.gap_filled_flow(tx)
        if name in ("overview", "index", "conflicts", *filters.ASSET_PAGES):
            index = cut(self.index(f))
            out["index"] = self._first(index, BOOTSTRAP_ROWS if name == "conflicts" else INDEX_ROWS)
            out["rollups"] = holdings.rollups(index)
        if name in filters.ASSET_PAGES:
            out |= {"transactions": tx, "sectors": sectors.sector_summary(tx)}
        if name in ("filings", *filters.ASSET_PAGES):
            out["filings"] = tables.filings(self.spark, self.sf_dir)
        if name == "identifier-review":
            found = cut(resolution.filtered_identities(self.identities(), f.asset_type, issuer=f.issuer, query=f.query))
            out |= {"identities": found, "identifier_review": resolution.review_items(found).limit(REVIEW_ROWS)}
        if name == "equities":
            out["stocks"] = sectors.stock_summary(tx)
        if name == "holdings":
            out["holdings"] = self.holdings(f)
        if name in ("transactions", "timing"):
            out["transactions"] = tx.orderBy(F.col("date").desc(), "id").limit(TRANSACTION_ROWS)
        if name == "review":
            out["review"] = self.review()
        return out

    def bootstrap(self) -> dict[str, DataFrame]:
        """What the first screen shows; no raw tables."""
        tx = self.transactions(Filters())
        if self.store:
            return {"kpis": sectors.kpis(self._stored("transactions")), "sectors": self._stored("sectors"), "index": self._first(self._stored("index"), BOOTSTRAP_ROWS), "years": self._stored("transactions").select(F.year("date").alias("year")).distinct()}
        return {"kpis": sectors.kpis(tx), "sectors": sectors.sector_summary(tx), "index": self._first(self.index(Filters()), BOOTSTRAP_ROWS), "years": tx.select(F.year("date").alias("year")).distinct()}

    def full_response(self, params: Mapping[str, str]) -> dict[str, DataFrame]:
        f = Filters.from_params(params)
        tx = self.transactions(f)
        # Holdings are computed once, and the index made of them once.
        held = cut(self.holdings(f))
        index = cut(self._entries(held, f))
        return {"kpis": sectors.kpis(tx), "transactions": tx, "sectors": sectors.sector_summary(tx), "holdings": held, "index": index, "rollups": holdings.rollups(index), "stocks": sectors.stock_summary(tx)}

    def citations(self, tx: DataFrame, entries: DataFrame) -> DataFrame:
        """Sources of the transactions behind the entries given, which are few."""
        keyed = tx.select(security_key(F.col("description")).alias("security_key"), "ord", "url").join(F.broadcast(entries.select("security_key")), "security_key", "left_semi")
        filed = tables.filings(self.spark, self.sf_dir)
        return holdings.cited(keyed, filed.limit(0), filed)

    def market(self, tickers: list[str], quotes: DataFrame) -> DataFrame:
        """Values of holdings by quotes of up to 50 tickers of up to 6 characters."""
        wanted = [t.strip().upper() for t in tickers if 0 < len(t.strip()) <= 6][:50]
        held = self.holdings(Filters()).groupBy("ticker").agg(F.sum("current.midpoint").alias("cost"))
        return sectors.market_values(held.where(F.upper("ticker").isin(wanted)), quotes)

    def facts(self, params: Mapping[str, str], selected: list[str] | None = None) -> Mapping[str, DataFrame]:
        """A bounded bundle: the selected or first entries, their citations, sector rollups, years.

        Each is planned when it is taken, so that the years alone do not ask for the index."""
        f = Filters.from_params(params)

        def placed() -> DataFrame:
            index = steps["index"]
            entries = index.where(F.col("entry_id").isin(selected)) if selected else self._first(index, FACT_ENTRIES)
            place = Window.orderBy(*order.index_order())
            return cut(entries.withColumn("place", F.row_number().over(place)))  # as many rows as are shown

        def years() -> DataFrame:
            counts = self.transactions(f).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n"))
            return counts.orderBy(F.col("year").desc()).limit(FACT_YEARS)

        steps = Parts(index=lambda: cut(self.index(f)), placed=placed, cited=lambda: cut(self.citations(self.transactions(f), steps["placed"])))
        return Parts(
            entries=lambda: holdings.compact(holdings.with_citations(steps["placed"], steps["cited"]).orderBy("place")),
            citations=lambda: holdings.unique_citations(steps["placed"], steps["cited"], FACT_CITATIONS),
            rollups=lambda: holdings.rollups(steps["index"]).where("kind = 'sector'").orderBy(*order.rollup_order()).limit(FACT_SECTORS),
            years=years,
        )

    def workbook(self, path: str, given: Mapping[str, DataFrame] | None = None) -> list[str]:
        """A sheet (CSV folder) of every table, nested cells spread; their names.

        ``given`` has what the tables lack: events (event_id, date, end_date, tickers,
        sectors and more), historical (source_id, title, filed_date, filing_type, url,
        reliability), documents (doc_id, text) and candidates (as of the identifier
        cascade).  Without events the dated ones of the tables stand there; the other
        sheets are empty then, and identifiers are not queried."""
        with stages(self.spark):
            spark, d, given, everything = self.spark, self.sf_dir, given or {}, self.full_response({})
            tx, identities = everything["transactions"], cut(self.identities())
            none = F.array().cast("array<string>")
            dated = given.get("events")
            if dated is None:
                dated = tables.dated_events(spark, d, "signup").select("event_id", "date", F.lit(None).cast("date").alias("end_date"), none.alias("tickers"), none.alias("sectors"), "category")
            history = given.get("historical")
            if history is None:
                history = spark.createDataFrame([], "source_id string, title string, filed_date date, filing_type string, url string, reliability string")
            docs = given.get("documents")
            lines = cut(documents.lines(spark.createDataFrame([], "doc_id string, text string") if docs is None else docs))
            assets, debts = cut(documents.asset_holdings(documents.asset_rows(lines))), cut(liabilities.liabilities(lines).withColumn("source_id", F.col("doc_id")))
            wanted = enrichment.lookup_groups(tx, list(fixed.IDENTIFIED_TYPES))
            if "candidates" in given:
                found = cut(resolution.identifier_candidates(given["candidates"]))
            else:
                found = cut(wanted.select("security_key", F.lit("not_queried").alias("status"), F.lit(None).cast("string").alias("figi")))
            review_rows = cut(self._review(everything["holdings"], identities))
            windows = cut(events.event_windows(dated, tx))
            figures = ingest.cache_figures({
                "transactions": tx, "holdings": everything["holdings"], "index": everything["index"], "filings": tables.filings(spark, d), "baseline": tables.baseline(spark, d), "review": review_rows, "identities": identities,
                "identifiers": found, "events": dated, "windows": windows, "historical": history, "assets": assets, "liabilities": debts,
            })
            reports = ingest.reports(history.withColumn("status", F.lit("ok")), assets.select("source_id"), debts.select("source_id"))
            flows = assets.groupBy(F.lit(None).cast("int").alias("year")).agg(F.sum("value.midpoint").alias("asset_value"))
            told = spark.createDataFrame(fixed.METHODS, "field string, value string")
            counted = figures.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in figures.columns))).alias("r")).select("r.*")
            sheets = {
                "index": everything["index"].drop("baseline", "purchases", "sales"), "rollups": everything["rollups"], "transactions": tx.drop("ord"), "stocks": everything["stocks"], "holdings": everything["holdings"],
                "sectors": everything["sectors"], "security_groups": enrichment.security_groups(tx), "identifiers": found, "events": dated, "event_windows": windows, "filings": tables.filings(spark, d), "historical_sources": history,
                "reports": reports, "asset_holdings": assets, "liabilities": debts, "yearly_exposure": timeline.yearly_exposure(tx, flows), "identities": identities, "identifier_review": resolution.review_items(identities),
                "review": review_rows, "evidence_methods": spark.createDataFrame(fixed.EVIDENCE_METHODS, "field string, value string"), "methods": told.unionByName(counted), "kpis": everything["kpis"],
                "baseline": tables.baseline(spark, d), "monthly_flow": timeline.monthly_flow(tx), "monthly_activity": timeline.monthly_activity(tx),
            }
            sinks.write_sheets(sheets, path)
            return list(sheets)

    def build(self, path: str, version: str, generated_at: datetime | None = None) -> None:
        """Write the derived tables of a version and commit them together."""
        with stages(self.spark):
            spark, d, everything = self.spark, self.sf_dir, self.full_response({})
            identities = cut(self.identities())
            made = {name: everything[name] for name in ("transactions", "holdings", "index", "rollups", "stocks", "sectors")} | {
                "baseline": tables.baseline(spark, d), "filings": tables.filings(spark, d), "identities": identities, "review": self._review(everything["holdings"], identities),
            }
            VersionStore(spark, path).publish(version, generated_at or datetime.now(timezone.utc), made)
