"""Resolving descriptions to reference securities, identifiers and identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeledger.functions import fixed, instruments, order
from rangeledger.functions.money import round1
from rangeledger.functions.text import first_truthy, normal_description, security_key, stable_id
from rangeledger.operators.enrichment import plain_number
from rangeledger.operators.similarity import similar_names


def ticker_key(ticker: Column) -> Column:
    """A ticker without marks, in capitals."""
    return F.regexp_replace(F.upper(F.trim(ticker)), "[^A-Z0-9]", "")


def reference_merge(companies: DataFrame, directory: DataFrame) -> DataFrame:
    """Two lists of securities as one by ticker key: the first list's name, ticker
    and number come first, marks of either count, sources are joined."""
    key = ticker_key(F.col("ticker"))
    a = companies.select(key.alias("ticker_key"), F.col("ticker").alias("t1"), F.col("issuer_name").alias("n1"), "cik", F.col("exchange").alias("x1"))
    b = directory.select(key.alias("ticker_key"), F.col("ticker").alias("t2"), F.col("issuer_name").alias("n2"), "is_etf", "is_test")
    rows = a.join(b, "ticker_key", "full")
    name = F.coalesce("n1", "n2")
    sources = F.array_compact(F.array(F.when(F.col("n1").isNotNull(), "companies"), F.when(F.col("n2").isNotNull(), "directory")))
    return rows.select(
        "ticker_key", F.coalesce("t1", "t2").alias("ticker"), name.alias("issuer_name"), normal_description(name).alias("normal_name"), instruments.issuer_name(name).alias("clean_name"),
        "cik", F.col("x1").alias("exchange"), F.coalesce("is_etf", F.lit(False)).alias("is_etf"), F.coalesce("is_test", F.lit(False)).alias("is_test"), sources.alias("sources"),
    )


def candidates(securities: DataFrame, reference: DataFrame) -> DataFrame:
    """Every security (security_key, description, source_ticker, asset_type) with
    the reference rows it can mean, the best score of each ticker.

    Ticker, full name, clean name and compact name are joins by equality; names
    that are only alike are joined by keys that such names must share."""
    ref = reference.where(~F.col("is_test")).withColumn("compact_name", F.regexp_replace("clean_name", "[^A-Z0-9]", ""))
    named = securities.withColumns({"name": normal_description(F.col("description")), "clean": instruments.issuer_name(F.col("description"))})
    named = named.withColumn("short", security_key(F.col("description")))
    named = named.withColumns({"compact": F.regexp_replace("clean", "[^A-Z0-9]", ""), "tk": ticker_key(F.col("source_ticker"))})
    keys = lambda *pairs: F.filter(F.array(*(F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(score).alias("score")) for kind, value, score in pairs)), lambda k: F.coalesce(k["value"], F.lit("")) != "")
    left = named.select("security_key", "asset_type", "clean", F.explode(F.array_distinct(keys(("ticker", F.col("tk"), 1.0), *(("exact", F.col(c), fixed.EXACT) for c in ("name", "short")), ("clean", F.col("clean"), fixed.CLEAN), ("clean", instruments.issuer_name(F.col("short")), fixed.CLEAN), ("compact", F.col("compact"), fixed.COMPACT)))).alias("k"))
    right = ref.select("ticker_key", "ticker", "issuer_name", "clean_name", "cik", "is_etf", F.explode(keys(("ticker", F.col("ticker_key"), 1.0), ("exact", F.col("normal_name"), 1.0), ("clean", F.col("clean_name"), 1.0), ("compact", F.col("compact_name"), 1.0))).alias("r"))
    same = left.join(right, (F.col("k.kind") == F.col("r.kind")) & (F.col("k.value") == F.col("r.value")))
    same = same.select("security_key", "asset_type", "ticker_key", "ticker", "issuer_name", "clean_name", "cik", "is_etf", F.col("k.kind").alias("how"), F.col("k.score").alias("score"))
    alike = similar_names(
        named.where(F.length("clean") >= 4).select(F.col("clean").alias("name")), ref.select(F.col("clean_name").alias("name")), fixed.SIMILAR
    )
    near = named.join(alike, F.col("clean") == F.col("left_name")).join(ref, F.col("right_name") == F.col("clean_name"))
    near = near.select("security_key", "asset_type", "ticker_key", "ticker", "issuer_name", "clean_name", "cik", "is_etf", F.lit("similar").alias("how"), "score")
    rows = same.unionByName(near)
    fund_by_name = (F.col("how") != "ticker") & (((F.col("asset_type") == "Equity") & F.col("is_etf")) | (F.col("asset_type") == "ETF / Fund"))
    best = F.row_number().over(Window.partitionBy("security_key", "ticker_key").orderBy(F.col("score").desc(), "how"))
    return rows.where(~fund_by_name).withColumn("rn", best).where("rn = 1").drop("rn")


def _order() -> list[Column]:
    """Candidates of one security, the best first."""
    return [F.col("score").desc(), F.col("cik").isNotNull().desc(), F.col("is_etf").desc(), F.col("ticker").asc()]


def is_common(ticker: Column, issuer_name: Column, is_etf: Column) -> Column:
    """Whether a reference row is an issuer's plain share."""
    words = F.upper(F.concat_ws(" ", ticker, issuer_name))
    return ~is_etf & ~words.rlike(fixed.NO_COMMON_WORDS) & ~F.upper(ticker).rlike(fixed.NO_COMMON_TICKER)


def issuer_contexts(found: DataFrame) -> DataFrame:
    """The issuer that a security other than a share belongs to, where its candidates say so.

    Candidates near the best one are a family; of its names the one of the best
    candidate counts, then the one with more rows; of that name's rows the first
    plain share stands for the issuer, else the first."""
    others = found.where(F.col("asset_type") != "Equity")
    top = F.max("score").over(Window.partitionBy("security_key"))
    family = others.withColumn("top", top).where((F.col("top") >= fixed.CONTEXT_FLOOR) & (F.col("score") >= F.greatest(F.lit(fixed.CONTEXT_FLOOR), F.col("top") - fixed.AMBIGUITY_MARGIN)))
    common = is_common(F.col("ticker"), F.col("issuer_name"), F.col("is_etf"))
    # Fields in the order of the comparison, the least first.
    row = F.struct((~common).alias("other"), (-F.col("score")).alias("less"), F.col("cik").isNull().alias("no_cik"), (~F.col("is_etf")).alias("no_etf"), "ticker", "issuer_name", "cik", "score")
    names = family.groupBy("security_key", "clean_name").agg(F.max("score").alias("best"), F.count("*").alias("rows"), F.min(row).alias("row"))
    first = names.groupBy("security_key").agg(F.min(F.struct((-F.col("best")).alias("b"), (-F.col("rows")).alias("n"), "clean_name", "row")).alias("g"))
    chosen, rows = F.col("g.row"), -F.col("g.n")
    flags = F.array_compact(F.array(F.lit(fixed.CONTEXT_ONLY), F.when(rows > 1, fixed.SHARED_NAME), F.when(chosen["cik"].isNull(), fixed.NO_CONTEXT_NUMBER)))
    return first.select(
        "security_key", chosen["ticker"].alias("context_ticker"), chosen["issuer_name"].alias("context_issuer"), chosen["cik"].alias("context_cik"),
        F.when(chosen["cik"].isNotNull(), "sec-issuer-context").otherwise("nasdaq-issuer-context").alias("context_source"), F.least(F.lit(fixed.CONTEXT_CAP), chosen["score"]).alias("context_confidence"),
        rows.alias("context_rows"), flags.alias("context_flags"),
    )


def resolved(securities: DataFrame, found: DataFrame) -> DataFrame:
    """Each security's decision: its ticker if the best candidate is good enough
    and clear of the second, else why not; its issuer's context where it has one; and
    its first five candidates."""
    best = Window.partitionBy("security_key").orderBy(*_order())
    ranked = found.withColumns({"rank": F.row_number().over(best), "second": F.lead("score").over(best)}).where("rank <= 5").drop("asset_type", "clean_name")
    five = ranked.groupBy("security_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ticker"))), lambda c: c["ticker"]).alias("candidate_tickers"))
    rows = securities.join(ranked.where("rank = 1").drop("rank"), "security_key", "left").join(five, "security_key", "left").join(issuer_contexts(found), "security_key", "left")
    kind, none = F.col("asset_type"), F.col("score").isNull()
    ambiguous = F.coalesce(F.col("second").isNotNull() & (F.col("score") < fixed.CERTAIN) & (F.col("score") - F.col("second") < fixed.AMBIGUITY_MARGIN), F.lit(False))
    poor = F.col("score") < F.when(kind == "Equity", fixed.EQUITY_ACCEPTS).otherwise(fixed.OTHER_ACCEPTS)
    # What passes the threshold above passes those of bonds too, which are lower.
    direct = kind.isin(*fixed.DIRECT_TYPES) | (F.coalesce("source_ticker", F.lit("")) != "")
    accepted = ~none & ~ambiguous & ~poor & direct
    has_context = F.col("context_ticker").isNotNull()
    context_note = F.when(has_context, fixed.CONTEXT_ONLY)
    why = (
        F.when(none, F.array(F.when(kind == "Equity", "No public match")))
        .when(ambiguous, F.array(F.lit("Multiple possible tickers"), context_note))
        .when(poor, F.array(F.lit("Low-confidence issuer match"), context_note))
        .when(~direct, F.array(F.when(has_context, fixed.CONTEXT_ONLY).otherwise(fixed.NO_DIRECT_TICKER)))
        .otherwise(F.array(F.when(F.col("score") < 0.9, "Low-confidence issuer match")))
    )
    return rows.select(
        "security_key", "asset_type", F.when(accepted, F.col("ticker")).alias("resolved_ticker"), F.when(accepted, F.col("issuer_name")).alias("resolved_issuer"),
        F.when(accepted, F.col("cik")).alias("resolved_cik"), F.when(accepted, F.col("how")).otherwise("none").alias("source"), F.coalesce("score", F.lit(0.0)).alias("confidence"),
        F.array_compact(why).alias("flags"), F.coalesce("candidate_tickers", F.array().cast("array<string>")).alias("candidate_tickers"),
        "context_ticker", "context_issuer", "context_cik", "context_source", "context_confidence", F.coalesce("context_flags", F.array().cast("array<string>")).alias("context_flags"),
    )


def meaningful_tokens(words: Column) -> Column:
    """Words of an issuer's name that tell it from others, short forms spelled out."""
    plain = F.split(normal_description(F.coalesce(words, F.lit(""))), r"\s+")
    known = instruments.words_map(fixed.TOKEN_ALIASES)
    return F.filter(F.transform(plain, lambda w: F.coalesce(F.try_element_at(known, w), w)), lambda w: (F.length(w) >= 2) & ~w.isin(fixed.COMMON_TOKENS))


def search_query(issuer_ticker: Column, issuer: Column, other_issuers: list[Column], coupon: Column, maturity: Column) -> Column:
    """What an identifier service is asked: issuer, coupon and maturity as mm/dd/yy, those that are known."""
    full = lambda c: F.nullif(c, F.lit(""))
    short = F.concat_ws("/", F.substring(maturity, 6, 2), F.substring(maturity, 9, 2), F.substring(maturity, 3, 2))
    return F.trim(F.concat_ws(" ", F.coalesce(full(issuer_ticker), full(issuer), *(full(c) for c in other_issuers)), F.when(coupon.isNotNull(), plain_number(coupon)), F.when(full(maturity).isNotNull(), short)))


def identifier_candidates(groups: DataFrame) -> DataFrame:
    """Which of a bond's candidates remain after market, coupon, maturity, issuer and
    restricted-sale filters: matched if exactly one.

    groups: security_key, description, asset_type, candidates (array of structs figi,
    ticker, name, market, security_type, text), and issuer_ticker and issuer_name of the
    context where they are known.  Returns status, figi, remaining, confidence, flags,
    shown (at most eight of what remains, else of all) and the query that asks for them."""
    if "issuer_ticker" not in groups.columns:
        groups = groups.withColumn("issuer_ticker", F.lit(None).cast("string"))
    if "issuer_name" not in groups.columns:
        groups = groups.withColumn("issuer_name", F.lit(None).cast("string"))
    rows = groups.withColumn("candidates", F.coalesce("candidates", F.array().cast(groups.schema["candidates"].dataType))).withColumn("p", instruments.parsed(F.col("description"), F.col("asset_type")))
    # What candidates are compared by is told once of each of the market.
    rows = rows.withColumns({"mine": meaningful_tokens(F.coalesce("p.issuer", "issuer_name")), "normal": normal_description(F.col("description"))})
    market = F.when(F.col("asset_type") == "Municipal Bond", "MUNI").otherwise("CORP")
    whole = lambda c: F.concat_ws(" ", c["ticker"], c["text"], c["name"], c["security_type"])
    kept = F.filter("candidates", lambda c: F.coalesce(F.upper(c["market"]) == market, F.lit(False)))
    said = F.transform(kept, lambda c: F.struct(c.alias("c"), whole(c).alias("whole")))
    told = lambda x: F.struct(
        x["c"].alias("c"), instruments.candidate_coupons(x["whole"]).alias("coupons"), instruments.candidate_dates(x["whole"]).alias("dates"), normal_description(x["whole"]).alias("normal"),
        normal_description(F.coalesce(x["c"]["security_type"], F.lit(""))).alias("kind"), meaningful_tokens(F.concat_ws(" ", x["c"]["name"], x["c"]["ticker"])).alias("tokens"),
    )
    rows = rows.withColumn("told", F.transform(said, told))
    mine, normal = F.col("mine"), F.col("normal")
    by_coupon = lambda x: F.exists(x["coupons"], lambda v: F.abs(v - F.col("p.coupon")) <= fixed.COUPON_MARGIN)
    by_date = lambda x: F.array_contains(x["dates"], F.col("p.maturity"))
    # The issuer's words are counted each time they stand there, the candidate's once.
    shared = lambda x: F.size(F.filter(mine, lambda w: F.array_contains(x["tokens"], w)))
    by_issuer = lambda x: (F.size(mine) == 0) | (shared(x) >= F.least(F.lit(2), F.size(mine)))
    regs = lambda x: x["normal"].rlike(fixed.REG_S) | (x["kind"] == "EURO DOLLAR")
    private = lambda x: x["normal"].rlike(fixed.RULE_144A) | (x["kind"] == "PRIV PLACEMENT")

    def preferred(some: Column) -> Column:
        free = F.filter(some, lambda x: ~regs(x) & ~private(x))
        return F.when(normal.rlike(fixed.REG_S), F.filter(some, regs)).when(normal.rlike(fixed.RULE_144A), F.filter(some, private)).when(F.size(free) > 0, free).otherwise(some)

    def once(some: Column) -> Column:
        """Of candidates that share an identifier the last, at the first one's place."""
        figis = F.array_distinct(F.transform(some, lambda x: x["c"]["figi"]))
        return F.transform(figis, lambda f: F.element_at(F.filter(some, lambda x: x["c"]["figi"] == f), -1))

    fits = F.filter("told", lambda x: F.col("p.coupon").isNull() | by_coupon(x))
    rows = rows.withColumn("by_terms", F.filter(fits, lambda x: F.col("p.maturity").isNull() | by_date(x)))
    rows = rows.withColumns({"terms": preferred(F.col("by_terms")), "left": preferred(F.filter("by_terms", by_issuer))})
    rows = rows.withColumns({"terms": once(F.col("terms")), "left": once(F.col("left"))})
    municipal = F.col("asset_type") == "Municipal Bond"
    unclear = municipal & (F.size("terms") != 1)
    rest = F.when(unclear, F.col("terms")).otherwise(F.col("left"))
    rows = rows.withColumns({"rest": rest, "unclear": unclear}).withColumn("matched", ~F.col("unclear") & (F.size("rest") == 1) & (F.size("candidates") > 0)).withColumn("one", F.get("rest", F.lit(0)))
    one = F.col("one")
    sure = (
        F.lit(62) + F.when(F.col("p.coupon").isNotNull() & by_coupon(one), 12).otherwise(0) + F.when(F.col("p.maturity").isNotNull() & by_date(one), 12).otherwise(0)
        + F.when(by_issuer(one), 8).otherwise(0) + F.when((F.coalesce("issuer_ticker", F.lit("")) != "") & normal_description(F.coalesce(one["c"]["ticker"], F.lit(""))).startswith(F.col("issuer_ticker")), 4).otherwise(0)
    )
    n = F.size("rest")
    flag = (
        F.when(F.col("matched"), F.array(*(F.lit(f) for f in fixed.MATCHED_FLAGS)))
        .when(F.col("unclear"), F.array(F.when(n > 1, F.concat(n, F.lit(fixed.MUNICIPAL_SHARED))).otherwise(fixed.MUNICIPAL_NONE)))
        .when(F.size("candidates") == 0, F.array(F.lit(fixed.NO_CANDIDATES))).otherwise(F.array(F.concat(n, F.lit(fixed.CANDIDATES_LEFT))))
    )
    status = F.when(F.col("matched"), "matched").when(F.size("candidates") == 0, "not_found").otherwise("ambiguous")
    shown = F.slice(F.when(n > 0, F.transform("rest", lambda x: x["c"])).otherwise(F.col("candidates")), 1, fixed.CANDIDATES_SHOWN)
    return rows.select(
        "security_key", status.alias("status"), F.when(F.col("matched"), one["c"]["figi"]).alias("figi"), F.size("left").alias("remaining"),
        F.when(F.col("matched"), F.least(F.lit(fixed.MATCH_CAP), sure / 100)).alias("confidence"), flag.alias("flags"), shown.alias("shown"),
        search_query(F.col("issuer_ticker"), F.col("p.issuer"), [F.col("issuer_name")], F.col("p.coupon"), F.col("p.maturity")).alias("query"),
    )


def identities(entries: DataFrame) -> DataFrame:
    """Index entries that name the same instrument, as one row with its review.

    entries: entry_id, display, asset_type, sector, cusip, isin, figi, kind,
    issuer, coupon, maturity, ticker, issuer_ticker, status, review, reliability,
    score, current_mid, transaction_count, ord."""
    parsed = F.concat_ws("|", F.lit("parsed"), "asset_type", normal_description(F.coalesce("issuer", "display")), F.coalesce(F.col("coupon").cast("string"), F.lit("")), F.coalesce("maturity", F.lit("")), security_key(F.col("display")))
    tag = lambda name, c: F.concat(F.lit(f"{name}|"), F.nullif(c, F.lit("")))
    key = F.coalesce(tag("cusip", "cusip"), tag("isin", "isin"), tag("figi", "figi"), tag("ticker", "ticker"), F.when(F.col("kind").isNull(), tag("issuer-context", "issuer_ticker")), parsed)
    has = F.coalesce("kind", "cusip", "isin", "figi", "issuer_ticker").isNotNull()
    exact = F.coalesce("cusip", "isin", "figi").isNotNull()
    bond = F.col("kind").isin("corporate bond/note", "municipal bond", "preferred/hybrid security")
    status = F.when(exact, "exact").when(bond, "needs_identifier").when(F.col("issuer_ticker").isNotNull(), "issuer_context_only").otherwise(F.coalesce("status", F.lit("not_applicable")))
    rows = entries.where(has).withColumns({"identity_id": stable_id(F.concat(F.lit("identity|"), key)), "key": key, "status": status})
    rows = rows.withColumn("review", F.when(F.col("review") == "rejected", "rejected").when(F.col("status") == "needs_identifier", "needs_review").otherwise(F.coalesce("review", F.lit("verified"))))
    rank = lambda order, c: F.max(F.array_position(F.array(*(F.lit(o) for o in order)), F.col(c)))
    back = lambda order, c: F.element_at(F.array(*(F.lit(o) for o in order)), F.greatest(F.col(c), F.lit(1)).cast("int"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)
    # The key, not its 32-bit hash, tells identities apart.
    merged = rows.groupBy("key").agg(
        F.first("identity_id").alias("identity_id"), F.max_by("display", F.struct("score", -F.col("ord"))).alias("display"), F.max_by("sector", F.struct("current_mid", -F.col("ord"))).alias("sector"),
        *(first(c) for c in ("asset_type", "cusip", "isin", "figi", "issuer", "coupon", "maturity")), rank(instruments.STATUS, "status").alias("s"), rank(instruments.REVIEW, "review").alias("r"),
        rank(instruments.RELIABILITY, "reliability").alias("l"), F.max("score").alias("score"), F.sum("current_mid").alias("current_mid"), F.sum("transaction_count").alias("transaction_count"), F.count("*").alias("entries"),
    )
    merged = merged.withColumns({"status": back(instruments.STATUS, "s"), "review": back(instruments.REVIEW, "r"), "reliability": back(instruments.RELIABILITY, "l")}).drop("s", "r", "l")
    boost = F.when(F.col("status") == "needs_identifier", 45).when(F.col("review") == "needs_review", 25).otherwise(0)
    trust = F.when(F.col("reliability") == "metadata_only", 15).when(F.col("reliability") == "archived_copy", 8).otherwise(0)
    weight = boost + trust + F.log1p(F.greatest(F.lit(0.0), "current_mid")) * 4 + F.log1p(F.greatest(F.lit(0), "transaction_count")) * 8 + F.col("score")
    return merged.withColumn("priority", round1(weight))


def review_items(found: DataFrame) -> DataFrame:
    need = (F.col("status") == "needs_identifier") | (F.col("review") == "needs_review")
    return found.where(need).orderBy(*order.identity_order())


def filtered_identities(found: DataFrame, asset_type: str | None = None, reliability: str | None = None, issuer: str | None = None, query: str | None = None) -> DataFrame:
    """Identities by type, reliability, words of their name, and words anywhere."""
    for name, value in (("asset_type", asset_type), ("reliability", reliability)):
        if value and value != "All":
            found = found.where(F.col(name) == value)
    has = lambda columns, words: F.contains(F.lower(F.concat_ws(" ", *(c for c in columns if c in found.columns))), F.lit(words.strip().lower()))
    if issuer and issuer.strip():
        found = found.where(has(("display", "issuer"), issuer))
    if query and query.strip():
        found = found.where(has(("display", "issuer", "cusip", "isin", "figi", "asset_type", "sector", "status"), query))
    return found


def display_name(issuer: Column, ticker: Column, description: Column) -> Column:
    return first_truthy(issuer, ticker, description)
