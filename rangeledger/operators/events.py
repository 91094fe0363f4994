"""Events: tagging, merging, windows over transactions, and possible conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeledger.functions import fixed
from rangeledger.functions.money import short_money
from rangeledger.functions.text import clean_html, importance_of, labels_of
from rangeledger.plans.joins import interval_join, last_wins
from rangeledger.plans.stages import cut


def tagged(documents: DataFrame, title: str, body: str) -> DataFrame:
    """Title and body cleaned, with tags, sectors and importance of their text."""
    text = F.concat_ws(" ", clean_html(F.col(title)), clean_html(F.col(body)))
    return documents.withColumn("clean", text).withColumns(
        {"tags": labels_of(F.col("clean"), fixed.EVENT_TAGS), "sectors": labels_of(F.col("clean"), fixed.EVENT_SECTORS), "importance": importance_of(F.col("clean"))}
    )


def merged(events: DataFrame, order: str) -> DataFrame:
    """Of each event id the row that comes last."""
    return last_wins(events, ["event_id"], F.col(order))


def _spans(events: DataFrame, days: list[int]) -> DataFrame:
    """Per event and window size: low and high, with its targets in capitals."""
    sizes = events.withColumn("window_days", F.explode(F.array(*(F.lit(d) for d in days))))
    return sizes.select(
        "event_id", "window_days", F.date_sub("date", F.col("window_days")).alias("low"), F.date_add(F.coalesce("end_date", "date"), F.col("window_days")).alias("high"),
        F.array_sort(F.array_distinct("tickers")).alias("tickers"), F.array_sort(F.array_distinct("sectors")).alias("sectors"),
    )


def event_windows(events: DataFrame, tx: DataFrame, days: list[int] | None = None, bucket_days: int = 8) -> DataFrame:
    """Per event and window size: what was traded from ``days`` before its start to
    ``days`` after its end; events that name tickers or sectors see only those.

    events: event_id, date, end_date, tickers, sectors.  An event without
    transactions still has its rows.  Events of one span and one set of targets
    share their result, which is computed once.  Trades of one day, ticker, sector
    and type are summed first.  Named targets are joined by equality with them (and
    a date bucket); spans without targets meet one row a day."""
    sizes = _spans(events, days or fixed.WINDOW_DAYS)
    span = ["low", "high", "tickers", "sectors"]
    spans = sizes.select(*span).distinct()
    rows = tx.select(F.col("date").alias("tx_date"), F.col("ticker").alias("tx_ticker"), F.col("sector").alias("tx_sector"), "type", F.col("amount.midpoint").alias("mid"))
    kind = lambda name: F.coalesce(F.sum(F.when(F.col("type") == name, F.col("mid"))), F.lit(0.0))
    groups = cut(rows.groupBy("tx_date", "tx_ticker", "tx_sector").agg(F.count("*").alias("n"), kind("Purchase").alias("buy"), kind("Sale").alias("sale")))
    open_ = (F.size("tickers") == 0) & (F.size("sectors") == 0)
    total = [F.sum("n").alias("transaction_count"), F.sum("buy").alias("purchase_midpoint"), F.sum("sale").alias("sale_midpoint"), F.min("tx_date").alias("first_date"), F.max("tx_date").alias("last_date")]
    daily = groups.groupBy("tx_date").agg(F.sum("n").alias("n"), F.sum("buy").alias("buy"), F.sum("sale").alias("sale"), F.collect_set("tx_ticker").alias("day_tickers"), F.collect_set("tx_sector").alias("day_sectors"))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    untargeted = interval_join(spans.where(open_), daily, "low", "high", "tx_date", bucket_days)
    untargeted = untargeted.groupBy(*span).agg(*total, union("day_tickers").alias("found_tickers"), union("day_sectors").alias("found_sectors"))
    names = lambda c, tag, of: F.transform(c, lambda x: F.struct(F.lit(tag).alias("kind"), of(x).alias("name")))
    same = lambda x: x
    wanted = spans.where(~open_).withColumn("target", F.explode(F.concat(names("tickers", "ticker", same), names("sectors", "sector", same))))
    own = F.array(F.struct(F.lit("ticker").alias("kind"), F.upper("tx_ticker").alias("name")), F.struct(F.lit("sector").alias("kind"), F.col("tx_sector").alias("name")))
    offered = groups.withColumn("target_tx", F.explode(own)).where("target_tx.name is not null")
    met = interval_join(wanted, offered, "low", "high", "tx_date", bucket_days, also=F.col("target") == F.col("target_tx"))
    # A trade met by several of a span's targets counts once.
    met = met.dropDuplicates([*span, "tx_date", "tx_ticker", "tx_sector"])
    targeted = met.groupBy(*span).agg(*total, F.array_sort(F.collect_set("tx_ticker")).alias("found_tickers"), F.array_sort(F.collect_set("tx_sector")).alias("found_sectors"))
    found = sizes.join(untargeted.unionByName(targeted), span, "left")
    zero, none = F.lit(0.0), F.array().cast("array<string>")
    buy, sale = F.coalesce("purchase_midpoint", zero), F.coalesce("sale_midpoint", zero)
    return found.select(
        "event_id", "window_days", F.coalesce("transaction_count", F.lit(0)).alias("transaction_count"), buy.alias("purchase_midpoint"), sale.alias("sale_midpoint"),
        F.coalesce("found_tickers", none).alias("tickers"), F.coalesce("found_sectors", none).alias("sectors"), "first_date", "last_date", (buy - sale).alias("net_midpoint"),
    )


def policy_conflicts(holdings: DataFrame, config: DataFrame) -> DataFrame:
    """Holdings of tickers under a policy, one row per category of the policy
    (``config`` is a table of fixed rows, a few)."""
    rows = holdings.join(F.broadcast(config), "ticker").withColumn("category", F.explode("categories"))
    severity = F.when(F.col("value") > 500_000, "high").otherwise("medium")
    return rows.select(
        F.concat_ws("-", F.lit("policy"), "ticker", "category").alias("indicator_id"), severity.alias("severity"), "category", "ticker", F.col("name").alias("holding"), "value",
        F.lit(None).cast("string").alias("event_id"), F.lit(0.7).alias("evidence"),
    )


def matters_to(events: DataFrame, config: DataFrame) -> DataFrame:
    """Sector, event_id and event_date of the events that matter to a sector, by
    their category (a join by equality) or by a word of their title or summary.

    config: sector, triggers (event categories), words: fixed rows, a few."""
    words = F.broadcast(config.select("sector", F.explode("words").alias("word")))
    by_kind = events.join(F.broadcast(config.select("sector", F.explode("triggers").alias("category"))), "category").select("sector", "event_id", F.col("date").alias("event_date"))
    text = F.concat_ws("\n", F.lower("title"), F.lower("summary"))
    # All words of the configuration at once; only events that have one are told apart.
    said = events.withColumn("text", text).join(words, F.contains(F.col("text"), F.col("word"))).select("sector", "event_id", F.col("date").alias("event_date"))
    return by_kind.unionByName(said).distinct()


def timing_conflicts(holdings: DataFrame, events: DataFrame, tx: DataFrame, config: DataFrame, days: int = 30, strict: bool = False) -> DataFrame:
    """Holdings traded within ``days`` of an event that matters to their sector.

    A transaction belongs to a holding by its ticker or its issuer's; two missing
    ones agree, unless ``strict`` asks for one that is there.  Before the event weighs
    more than after.  Trades are counted by day under each ticker, issuer and pair
    of both, a missing one being a value like any other; trades by either are those
    by ticker and by issuer less those by both.  Events of one date are looked up
    once."""
    matters = cut(matters_to(events, config))
    dates = matters.select("sector", "event_date").distinct()
    held = holdings.select("holding_id", "ticker", "issuer_ticker", "sector", "value")
    spans = held.join(dates, "sector").withColumns({"low": F.date_sub("event_date", days), "high": F.date_add("event_date", days)})
    daily = cut(tx.groupBy(F.col("ticker").alias("tx_ticker"), F.col("issuer_ticker").alias("tx_issuer"), F.col("date").alias("tx_date")).agg(F.count("*").alias("n")))

    def counted(on: list[tuple[str, str]], sign: int) -> DataFrame:
        some = daily.groupBy(*(t for _, t in on), "tx_date").agg(F.sum("n").alias("n"))
        some = some.dropna(subset=[t for _, t in on]) if strict else some
        left = spans.select("holding_id", "event_date", "low", "high", *(h for h, _ in on)).distinct()
        same = F.lit(True)
        for h, t in on:
            same = same & (F.col(h) == F.col(t) if strict else F.col(h).eqNullSafe(F.col(t)))
        met = interval_join(left, some, "low", "high", "tx_date", 16, also=same)
        early = F.sum(F.when(F.col("tx_date") < F.col("event_date"), F.col("n")).otherwise(0))
        return met.groupBy("holding_id", "event_date").agg((F.sum("n") * sign).alias("n"), (early * sign).alias("early"))

    ticker, issuer = ("ticker", "tx_ticker"), ("issuer_ticker", "tx_issuer")
    counts = counted([ticker], 1).unionByName(counted([issuer], 1)).unionByName(counted([ticker, issuer], -1))
    counts = counts.groupBy("holding_id", "event_date").agg(F.sum("n").alias("related"), F.sum("early").alias("before")).where("related > 0")
    rows = held.join(counts, "holding_id").join(matters, ["sector", "event_date"])
    return rows.select(
        F.concat_ws("-", F.lit("timing"), "holding_id", "event_id").alias("indicator_id"), F.when(F.col("before") > 0, "high").otherwise("medium").alias("severity"),
        F.lit("suspicious-timing").alias("category"), "ticker", F.col("holding_id").cast("string").alias("holding"), "value", F.col("event_id").cast("string").alias("event_id"),
        F.when(F.col("before") > 0, 0.85).otherwise(0.6).alias("evidence"), "related", "before",
    )


def rate_conflicts(holdings: DataFrame, events: DataFrame, sensitive: Column) -> DataFrame:
    """Rate events while more than 100,000 was held in what rates move."""
    total = holdings.where(sensitive).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"), F.count("*").alias("n"))
    # One row of totals.
    rows = events.crossJoin(F.broadcast(total)).where("value > 100000")
    return rows.select(
        F.concat_ws("-", F.lit("fed"), "event_id").alias("indicator_id"), F.when(F.col("value") > 1_000_000, "high").otherwise("medium").alias("severity"), F.lit("fed-rate-sensitive").alias("category"),
        F.lit(None).cast("string").alias("ticker"), F.concat(F.col("n"), F.lit(" financial holdings")).alias("holding"), "value", F.col("event_id").cast("string").alias("event_id"), F.lit(0.5).alias("evidence"),
    )


def severity_order(severity: Column) -> Column:
    return F.when(severity == "critical", 4).when(severity == "high", 3).when(severity == "medium", 2).otherwise(1)


def ranked_conflicts(indicators: DataFrame, n: int = 100) -> DataFrame:
    """The gravest indicators, the better evidenced first; of one id (holdings of one
    ticker) those of the most value, then by name, so that every run shows the same."""
    return indicators.orderBy(severity_order(F.col("severity")).desc(), F.col("evidence").desc(), "indicator_id", F.col("value").desc(), "holding").limit(n)


def conflict_summary(indicators: DataFrame, n: int = 100) -> DataFrame:
    """Counts over the ranked indicators; exposure over all of them."""
    indicators = cut(indicators)
    shown = ranked_conflicts(indicators, n)
    exposure = indicators.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("exposure"))
    counted = shown.agg(
        F.count("*").alias("total"), F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"),
        F.countDistinct(F.coalesce("ticker", "holding")).alias("holdings"), F.countDistinct("event_id").alias("events"),
    )
    return counted.crossJoin(exposure)


def conflicts_by(indicators: DataFrame, *keys: str, n: int = 100) -> DataFrame:
    """The ranked indicators under each key (category, severity): counts, and their ids
    in the order of the ranking (all keys together hold ``n`` of them)."""
    placed = F.struct((-severity_order(F.col("severity"))).alias("s"), (-F.col("evidence")).alias("e"), "indicator_id")
    ids = F.transform(F.array_sort(F.collect_list(placed)), lambda x: x["indicator_id"]).alias("indicators")
    return ranked_conflicts(indicators, n).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("value").alias("value"), F.max("evidence").alias("evidence"), ids)


def detailed(shown: DataFrame, holdings: DataFrame, dated: DataFrame, tx: DataFrame, notes: dict[str, str] | None = None, days: int = 30, most: int = 50) -> DataFrame:
    """Ranked indicators with all that is shown of them: title, summary, the event's
    date and title, ids and dates of the transactions, window, position, links, tags.

    holdings: holding_id, ticker, issuer_ticker, name, sector; dated: event_id, date,
    category, title; tx: id, ticker, issuer_ticker, date; ``source_urls`` of holdings
    and ``source_url`` of the others count where they are there.  An indicator names
    the first ``most`` transactions by date and id: tasks keep no more of each before
    the shuffle.  The indicators are bounded by their rank and go to the transactions."""
    kind = F.split("indicator_id", "-")[0]
    url = lambda df: F.col("source_url") if "source_url" in df.columns else F.lit(None).cast("string")
    urls = F.col("source_urls") if "source_urls" in holdings.columns else F.array().cast("array<string>")
    found = dated.select(F.col("event_id").cast("string").alias("event_id"), F.col("date").alias("event_date"), F.col("title").alias("event_title"), F.col("category").alias("event_category"), url(dated).alias("event_url"))
    held = holdings.select(F.col("holding_id").cast("string").alias("holding"), F.col("ticker").alias("own_ticker"), F.col("issuer_ticker").alias("own_issuer"), F.col("name").alias("own_name"), F.col("sector").alias("own_sector"))
    sources = holdings.groupBy(F.col("ticker"), F.col("name").alias("holding")).agg(F.min(urls).alias("holding_urls"))
    rows = cut(shown.withColumn("family", kind).join(found, "event_id", "left"))
    timing = rows.where("family = 'timing'").join(held, "holding")
    spans = timing.select("indicator_id", "event_date", "own_ticker", "own_issuer", F.date_sub("event_date", days).alias("low"), F.date_add("event_date", days).alias("high"))
    bucket = lambda c: F.floor(F.unix_date(c) / days)
    # As many rows as indicators are shown, a few buckets each.
    spread = F.broadcast(spans.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high"))))))
    trades = tx.select(F.col("id").cast("string").alias("tx_id"), F.col("ticker").alias("tx_ticker"), F.col("issuer_ticker").alias("tx_issuer"), F.col("date").alias("tx_date"), url(tx).alias("tx_url")).withColumn("_tx_bucket", bucket(F.col("tx_date")))
    same = F.col("own_ticker").eqNullSafe(F.col("tx_ticker")) | F.col("own_issuer").eqNullSafe(F.col("tx_issuer"))
    met = trades.join(spread, (F.col("_bucket") == F.col("_tx_bucket")) & F.col("tx_date").between(F.col("low"), F.col("high")) & same)
    counts = met.groupBy("indicator_id").agg(F.count("*").alias("related"), F.count_if(F.col("tx_date") < F.col("event_date")).alias("before"))
    first = met.withColumn("_n", F.row_number().over(Window.partitionBy("indicator_id").orderBy("tx_date", "tx_id"))).where(F.col("_n") <= most)
    lists = first.groupBy("indicator_id").agg(F.array_sort(F.collect_list(F.struct("tx_date", "tx_id", "tx_url"))).alias("trades"))
    rows = rows.drop("related", "before").join(timing.select("indicator_id", "own_name", "own_sector"), "indicator_id", "left").join(counts, "indicator_id", "left").join(lists, "indicator_id", "left").join(sources, ["ticker", "holding"], "left")
    labels = F.create_map(*(F.lit(x) for pair in fixed.CATEGORY_LABELS.items() for x in pair))
    noted = F.create_map(*(F.lit(x) for pair in (fixed.POLICY_NOTES if notes is None else notes or {"": ""}).items() for x in pair))
    is_timing, is_policy, worth = F.col("family") == "timing", F.col("family") == "policy", short_money(F.col("value"))
    quoted = F.concat(F.lit('"'), F.coalesce("event_title", F.lit("")), F.lit('"'))
    title = F.when(is_policy, F.concat(F.coalesce(F.try_element_at(labels, F.col("category")), "category"), F.lit(": "), "holding")).when(
        is_timing, F.concat(F.lit("Suspicious timing: "), "own_name", F.lit(" transactions near "), quoted)
    )
    summary = F.when(is_policy, F.concat(F.lit("Holds "), worth, F.lit(" in "), "ticker", F.lit(". "), F.coalesce(F.try_element_at(noted, F.col("ticker")), F.lit("")))).when(
        is_timing, F.concat("related", F.lit(f" transaction(s) within {days} days of "), "event_category", F.lit(" event. "), "before", F.lit(" occurred before the announcement."))
    )
    tags = F.when(is_policy, F.array("ticker", "category")).when(is_timing, F.filter(F.array("own_sector", "event_category", "ticker"), lambda t: F.coalesce(t, F.lit("")) != "")).otherwise(F.array(*(F.lit(t) for t in fixed.RATE_TAGS)))
    none = F.array().cast("array<string>")
    links = F.when(is_policy, F.coalesce("holding_urls", none)).otherwise(F.array_compact(F.concat(F.array("event_url"), F.coalesce(F.transform("trades", lambda t: t["tx_url"]), none))))
    return rows.select(
        "indicator_id", "severity", "category", F.coalesce(title, F.lit("Fed rate decision while holding rate-sensitive assets")).alias("title"),
        F.coalesce(summary, F.concat(F.lit("Held "), worth, F.lit(" in rate-sensitive financials during Fed event: "), quoted)).alias("summary"), F.col("ticker"),
        F.when(is_timing, F.col("own_name")).otherwise(F.col("holding")).alias("holding"), "value", "event_id", "event_date", "event_title",
        F.coalesce(F.transform("trades", lambda t: t["tx_id"]), none).alias("transaction_ids"), F.coalesce(F.transform("trades", lambda t: t["tx_date"]), F.array().cast("array<date>")).alias("transaction_dates"),
        F.coalesce("related", F.lit(0)).alias("related"), F.when(is_timing, days).alias("window_days"),
        F.when(is_timing, F.when(F.col("before") > 0, "before").otherwise("after")).when(~is_policy, "during").alias("position"), "evidence", links.alias("source_urls"), tags.alias("tags"),
    )


def conflict_timeline(indicators: DataFrame, events: DataFrame, links: DataFrame, tx: DataFrame) -> DataFrame:
    """Dated entries of the events and transactions that indicators name, each with
    its indicators in order.

    links: indicator_id and tx_id.  Both halves are joins by id from the
    indicators' side, which is bounded by its rank."""
    named = indicators.where("event_id is not null").groupBy("event_id").agg(F.array_sort(F.collect_set("indicator_id")).alias("indicators"))
    by_event = events.select(F.col("event_id").cast("string").alias("event_id"), "date", "title").join(named, "event_id")
    traded = links.join(indicators.select("indicator_id"), "indicator_id").groupBy("tx_id").agg(F.array_sort(F.collect_set("indicator_id")).alias("indicators"))
    title = F.concat(F.col("type"), F.lit(": "), F.left("description", F.lit(50)), F.lit("..."))
    by_tx = tx.select(F.col("id").alias("tx_id"), "date", title.alias("title")).where("date is not null").join(traded, "tx_id")
    event_rows = by_event.select("date", F.lit("event").alias("type"), F.col("event_id").alias("id"), "title", "indicators")
    return event_rows.unionByName(by_tx.select("date", F.lit("transaction").alias("type"), F.col("tx_id").alias("id"), "title", "indicators"))


def shown_events(events: DataFrame, year: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Events of a year (by their first date) and those that overlap a span."""
    rows = events
    if year and year != "All":
        rows = rows.where(F.col("date").cast("string").startswith(year))
    if start:
        rows = rows.where(F.coalesce("end_date", "date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    return rows


def filtered_conflicts(indicators: DataFrame, severity: str | None = None, category: str | None = None) -> DataFrame:
    for name, value in (("severity", severity), ("category", category)):
        if value and value != "All":
            indicators = indicators.where(F.col(name) == value)
    return indicators
