"""Registered queries over the star-schema tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rangeledger.functions import fixed, money, text
from rangeledger.operators import documents, events, filters, holdings, review, sectors, timeline
from rangeledger.plans import joins
from rangeledger.plans.stages import cut
from rangeledger.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _bracket_sql(amount: str, field: int, zero: str) -> str:
    text_ = (lambda v: f"'{v}'") if field == 0 else (lambda v: f"{v}::DOUBLE")
    cases = " ".join(f"WHEN {amount} <= {b[2]} THEN {text_(b[field])}" for b in fixed.BRACKETS[:-1])
    return f"CASE WHEN {amount} < 1001 THEN {zero} {cases} ELSE {text_(fixed.BRACKETS[-1][field])} END"


TX = f"""tx AS (
SELECT l_orderkey || '-' || l_linenumber AS id, l_orderkey, l_linenumber, p_name || ' ' || p_brand AS description, p_brand AS ticker,
  p_type AS asset_type, r_name AS sector, CASE l_returnflag WHEN 'N' THEN 'Purchase' WHEN 'R' THEN 'Sale' ELSE 'Exchange' END AS type,
  l_shipdate::DATE AS date, {_bracket_sql('l_extendedprice', 0, "'None (or less than $1,001)'")} AS label,
  {_bracket_sql('l_extendedprice', 1, '0.0::DOUBLE')} AS lo, {_bracket_sql('l_extendedprice', 2, '0.0::DOUBLE')} AS hi, {_bracket_sql('l_extendedprice', 3, '0.0::DOUBLE')} AS mid,
  l_shipdate::DATE > o_orderdate::DATE + 45 AS late, CASE WHEN l_extendedprice < 1001 THEN 0.55::DOUBLE ELSE 0.78::DOUBLE END AS confidence,
  [x FOR x IN [CASE WHEN l_extendedprice < 1001 THEN 'Amount below the first bracket' END, CASE WHEN l_quantity = 1 AND l_discount = 0 THEN 'Single unit at full price' END] IF x IS NOT NULL] AS flags, p_size, p_partkey
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""  # fmt: skip
NORMAL = r"trim(regexp_replace(regexp_replace(replace(upper({0}), '&', ' AND '), '[.,()]', ' ', 'g'), '\s+', ' ', 'g'))"


def _key_sql(of: str) -> str:
    s = NORMAL.format(of)
    for pattern in fixed.KEY_CUTS:
        s = f"regexp_replace({s}, '{pattern}', '', 'g')"
    return rf"left(trim(regexp_replace({s}, '\s+', ' ', 'g')), 160)"


def _stable_sql(of: str) -> str:
    codes = f"list_transform(string_split({of}, ''), lambda c: ascii(c)::UBIGINT)"
    return f"lower(lpad(to_hex(list_reduce(list_prepend(0::UBIGINT, {codes}), lambda h, c: (h * 31 + c) % 4294967296)), 8, '0'))"


@query(f"WITH {TX} SELECT label, count(*) AS n, sum(lo) AS sum_min, sum(hi) AS sum_max, sum(mid) AS sum_midpoint FROM tx GROUP BY label")
def amount_brackets(spark: SparkSession, d: str) -> DataFrame:
    tx = tables.transactions(spark, d)
    return tx.groupBy(F.col("amount.label").alias("label")).agg(F.count("*").alias("n"), *(F.sum(f"amount.{f}").alias(f"sum_{f}") for f in ("min", "max", "midpoint")))


@query(f"WITH {TX} SELECT DISTINCT label, CASE WHEN label LIKE 'None%' THEN 0 ELSE lo END AS min, CASE WHEN label LIKE 'None%' THEN 0 ELSE hi END AS max, CASE WHEN label LIKE 'None%' THEN 0 ELSE mid END AS midpoint FROM tx")
def parsed_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Labels written with dashes and spaces of other kinds parse to the same range."""
    shown = tables.transactions(spark, d).select(F.col("amount.label").alias("label")).distinct()
    return shown.withColumn("r", money.parse_range(F.regexp_replace("label", "-", " – "))).select("label", "r.min", "r.max", "r.midpoint")


@query(f"WITH {TX} SELECT id, date, mid AS midpoint FROM tx WHERE year(date) = 1998 AND sector = 'ASIA' AND type = 'Purchase' AND late AND date >= DATE '1998-02-01' AND date <= DATE '1998-10-31'")
def filtered_transactions(spark: SparkSession, d: str) -> DataFrame:
    f = filters.Filters(year="1998", sector="ASIA", transaction_type="Purchase", late_only=True, start_date="1998-02-01", end_date="1998-10-31")
    return filters.filtered(tables.transactions(spark, d), f).select("id", "date", F.col("amount.midpoint").alias("midpoint"))


@query(f"WITH {TX} SELECT id, description FROM tx WHERE contains(lower(concat_ws(' ', description, ticker, sector, asset_type)), 'ring brand#1')")
def free_text_search(spark: SparkSession, d: str) -> DataFrame:
    return filters.filtered(tables.transactions(spark, d), filters.Filters(query=" RING Brand#1 ")).select("id", "description")


@query(f"WITH {TX} SELECT asset_type, count(*) AS n FROM tx WHERE upper(ticker) = 'BRAND#7' GROUP BY asset_type")
def ticker_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.filtered(tables.transactions(spark, d), filters.Filters(ticker="brand#7")).groupBy("asset_type").agg(F.count("*").alias("n"))


@query(f"WITH {TX} SELECT sector, count(*) AS n FROM tx WHERE contains(lower(description), 'red widget') GROUP BY sector")
def issuer_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.filtered(tables.transactions(spark, d), filters.Filters(issuer="Red Widget")).groupBy("sector").agg(F.count("*").alias("n"))


@query(f"""WITH {TX} SELECT count(*) AS transaction_count, count(*) FILTER (type = 'Purchase') AS purchase_count, count(*) FILTER (type = 'Sale') AS sale_count,
count(*) FILTER (late) AS late_count, sum(lo) AS volume_min, sum(hi) AS volume_max, sum(mid) AS volume_midpoint, max(date) AS latest_date,
count(DISTINCT coalesce(nullif(ticker, ''), {_key_sql('description')})) AS unique_securities FROM tx""")
def kpis(spark: SparkSession, d: str) -> DataFrame:
    return sectors.kpis(tables.transactions(spark, d))


SECTORS = f"""WITH {TX}, s AS (SELECT CASE WHEN grouping(asset_type) = 1 THEN 'All' ELSE asset_type END AS asset_type, sector,
count(*) AS transaction_count, count(*) FILTER (type = 'Purchase') AS purchase_count, count(*) FILTER (type = 'Sale') AS sale_count, count(*) FILTER (late) AS late_count,
count(DISTINCT ticker) AS company_count, count(ticker) AS enriched_count, round(avg(confidence), 6) AS confidence, coalesce(sum(lo) FILTER (type = 'Purchase'), 0) AS plo, coalesce(sum(hi) FILTER (type = 'Purchase'), 0) AS phi,
coalesce(sum(mid) FILTER (type = 'Purchase'), 0) AS purchase_midpoint, coalesce(sum(lo) FILTER (type = 'Sale'), 0) AS slo, coalesce(sum(hi) FILTER (type = 'Sale'), 0) AS shi,
coalesce(sum(mid) FILTER (type = 'Sale'), 0) AS sale_midpoint FROM tx GROUP BY GROUPING SETS ((sector), (asset_type, sector))),
t AS (SELECT asset_type, sector, transaction_count, purchase_count, sale_count, late_count, company_count, enriched_count, confidence, purchase_midpoint, sale_midpoint,
plo - shi AS net_min, phi - slo AS net_max, purchase_midpoint - sale_midpoint AS net_midpoint FROM s)"""  # fmt: skip


@query(f"{SECTORS} SELECT * FROM t")
def sector_summary(spark: SparkSession, d: str) -> DataFrame:
    return sectors.sector_summary(tables.transactions(spark, d))


@query(f"{SECTORS} SELECT sector, greatest(purchase_midpoint + sale_midpoint, abs(net_midpoint), 1) AS tile, net_midpoint FROM t WHERE asset_type = 'All' ORDER BY tile DESC, sector LIMIT 18")
def sector_tiles(spark: SparkSession, d: str) -> DataFrame:
    return sectors.sector_tiles(sectors.sector_summary(tables.transactions(spark, d)))


def _held(spark: SparkSession, d: str) -> DataFrame:
    return holdings.estimated(holdings.grouped(tables.transactions(spark, d)), tables.baseline(spark, d))


GROUPS = f"""{TX}, h AS (SELECT *, {_key_sql('description')} AS k FROM tx),
g AS (SELECT k AS security_key, arg_min(description, (l_orderkey, l_linenumber)) AS description, arg_min(ticker, (l_orderkey, l_linenumber)) AS ticker,
  arg_min(asset_type, (l_orderkey, l_linenumber)) AS asset_type, arg_min(sector, (l_orderkey, l_linenumber)) AS sector,
  coalesce(sum(lo) FILTER (type = 'Purchase'), 0) AS plo, coalesce(sum(hi) FILTER (type = 'Purchase'), 0) AS phi, coalesce(sum(mid) FILTER (type = 'Purchase'), 0) AS pmid,
  coalesce(sum(lo) FILTER (type = 'Sale'), 0) AS slo, coalesce(sum(hi) FILTER (type = 'Sale'), 0) AS shi, coalesce(sum(mid) FILTER (type = 'Sale'), 0) AS smid,
  count(*) AS transaction_count, count(*) FILTER (type = 'Purchase') AS purchase_count, count(*) FILTER (type = 'Sale') AS sale_count, max(date) AS last_date, min(date) AS first_date, min(confidence) AS conf, list_sort(list_distinct(flatten(list(flags)))) AS flags FROM h GROUP BY k),
b AS (SELECT p_partkey AS baseline_id, p_name || ' ' || p_brand AS description, p_brand AS ticker, p_type AS asset_type, {_key_sql("p_name || ' ' || p_brand")} AS k,
  {_bracket_sql('p_retailprice', 1, '0.0::DOUBLE')} AS lo, {_bracket_sql('p_retailprice', 2, '0.0::DOUBLE')} AS hi, {_bracket_sql('p_retailprice', 3, '0.0::DOUBLE')} AS mid FROM part
  UNION ALL SELECT -1 - s_suppkey, s_name, NULL, 'ACCOUNT', {_key_sql('s_name')}, {_bracket_sql('s_acctbal * 10', 1, '0.0::DOUBLE')}, {_bracket_sql('s_acctbal * 10', 2, '0.0::DOUBLE')}, {_bracket_sql('s_acctbal * 10', 3, '0.0::DOUBLE')} FROM supplier),
c AS (SELECT g.security_key, b.baseline_id, bool_or(g.asset_type = b.asset_type OR g.ticker = b.ticker) AS pref, bool_or(g.security_key = b.k) AS ex
  FROM g JOIN b ON g.security_key = b.k OR g.ticker = b.ticker GROUP BY ALL),
n AS (SELECT security_key, count(*) AS n, count(*) FILTER (pref) AS np, count(*) FILTER (ex) AS ne, count(*) FILTER (pref AND ex) AS nb, min(baseline_id) AS any_id,
  min(baseline_id) FILTER (pref) AS p_id, min(baseline_id) FILTER (ex) AS e_id, min(baseline_id) FILTER (pref AND ex) AS b_id FROM c GROUP BY security_key),
m AS (SELECT security_key, CASE WHEN np = 1 THEN p_id WHEN np > 1 AND nb = 1 THEN b_id WHEN np = 0 AND n = 1 THEN any_id WHEN np = 0 AND ne = 1 THEN e_id END AS baseline_id FROM n),
e AS (SELECT g.security_key, coalesce(b.description, g.description) AS description, g.ticker, g.asset_type, g.sector, coalesce(b.lo, 0) AS blo, coalesce(b.hi, 0) AS bhi, coalesce(b.mid, 0) AS bmid,
  plo, phi, pmid, slo, shi, smid, transaction_count, purchase_count, sale_count, last_date, b.baseline_id IS NULL AS missing_baseline,
  greatest(0, coalesce(b.lo, 0) + plo - shi) AS clo, greatest(0, coalesce(b.hi, 0) + phi - slo) AS chi, greatest(0, coalesce(b.mid, 0) + pmid - smid) AS cmid,
  least(CASE WHEN b.baseline_id IS NULL THEN 0.58::DOUBLE ELSE 0.86::DOUBLE END, conf) AS confidence, list_concat(CASE WHEN b.baseline_id IS NULL THEN ['{fixed.NO_BASELINE_FLAG}'] ELSE [] END, g.flags) AS flags
  FROM g LEFT JOIN m USING (security_key) LEFT JOIN b USING (baseline_id)
  UNION ALL SELECT k, description, NULL, asset_type, 'Other', lo, hi, mid, 0, 0, 0, 0, 0, 0, 0, 0, 0, NULL, false, lo, hi, mid, 0.74::DOUBLE, [] FROM b WHERE k NOT IN (SELECT security_key FROM g))"""  # fmt: skip


@query(f"""WITH {GROUPS} SELECT security_key, description, ticker, asset_type, sector, bmid AS baseline_midpoint, pmid AS purchase_midpoint, smid AS sale_midpoint,
clo AS current_min, chi AS current_max, cmid AS current_midpoint, transaction_count, purchase_count, sale_count, last_date, missing_baseline, confidence, array_to_string(flags, '|') AS flags FROM e""")
def holdings_estimate(spark: SparkSession, d: str) -> DataFrame:
    return _held(spark, d).select(
        "security_key", "description", "ticker", "asset_type", "sector", F.col("baseline.midpoint").alias("baseline_midpoint"), F.col("purchases.midpoint").alias("purchase_midpoint"),
        F.col("sales.midpoint").alias("sale_midpoint"), F.col("current.min").alias("current_min"), F.col("current.max").alias("current_max"), F.col("current.midpoint").alias("current_midpoint"),
        "transaction_count", "purchase_count", "sale_count", "last_date", "missing_baseline", "confidence", F.array_join("flags", "|").alias("flags"),
    )


@query(f"WITH {GROUPS} SELECT baseline_id, k AS base_key FROM b WHERE k NOT IN (SELECT security_key FROM g)")
def holdings_anti_baseline(spark: SparkSession, d: str) -> DataFrame:
    # One row of each description: keys are made of those, and the join holds no more.
    keys = tables.transactions(spark, d).select("description").distinct().select(text.security_key(F.col("description")).alias("base_key")).distinct()
    base = tables.baseline(spark, d).select("baseline_id", text.security_key(F.col("description")).alias("base_key"))
    return base.join(keys, "base_key", "left_anti").select("baseline_id", "base_key")


ROUND1 = "floor(({0}) * 10 + 0.5) / 10"
INDEX = f"""{GROUPS}, i AS (SELECT *, greatest(0, cmid - (pmid - smid)) AS prev FROM e), x AS (SELECT greatest(1, max(ln(1 + cmid))) AS me, greatest(1, max(ln(1 + abs(cmid - prev)))) AS mc,
greatest(1, max(ln(1 + pmid + smid))) AS ma FROM i), j AS (SELECT i.*, cmid - prev AS chg, {ROUND1.format('ln(1 + cmid) / me * 100')} AS exposure, {ROUND1.format('ln(1 + abs(cmid - prev)) / mc * 100')} AS change,
{ROUND1.format('ln(1 + pmid + smid) / ma * 100')} AS activity FROM i CROSS JOIN x),
s AS (SELECT *, {ROUND1.format('exposure * 0.5::DOUBLE + change * 0.3::DOUBLE + activity * 0.2::DOUBLE')} AS score FROM j)"""  # fmt: skip


@query(f"""WITH {INDEX} SELECT security_key, cmid AS current_mid, prev AS previous_mid, chg AS change_mid, round(CASE WHEN prev > 0 THEN chg / prev * 100 WHEN cmid > 0 THEN 100.0 END, 6) AS change_pct,
exposure, change, activity, score, CASE WHEN pmid - smid > 0 THEN 'Net buy' WHEN pmid - smid < 0 THEN 'Net sale' ELSE 'Hold' END AS direction FROM s""")
def index_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = holdings.scored(_held(spark, d))
    return scored.select("security_key", "current_mid", "previous_mid", "change_mid", F.round("change_pct", 6).alias("change_pct"), "exposure", "change", "activity", "score", "direction")


@query(f"""WITH {INDEX}, u AS (SELECT 'sector' AS kind, sector AS key, * FROM s UNION ALL SELECT 'asset_type', asset_type, * FROM s),
r AS (SELECT kind, key, security_key, row_number() OVER (PARTITION BY kind, key ORDER BY score DESC, cmid DESC, security_key) AS rank FROM u)
SELECT kind, key, count(*) AS entry_count, sum(cmid) AS current_mid, sum(pmid) AS purchase_mid, sum(smid) AS sale_mid, sum(pmid - smid) AS net_mid,
{ROUND1.format('round(sum(score), 6) / count(*)')} AS average_score,
(SELECT string_agg(security_key, '|' ORDER BY rank) FROM r WHERE r.kind = u.kind AND r.key = u.key AND rank <= 5) AS top_entries FROM u GROUP BY kind, key""")
def index_rollups(spark: SparkSession, d: str) -> DataFrame:
    return holdings.rollups(holdings.scored(_held(spark, d)))


def _leader(by: str, order: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return holdings.leaders(holdings.scored(_held(spark, d)), by).select("security_key", "current_mid", "change_mid", "net_mid")

    run.__name__ = f"index_leaders_{by}"
    query(f"WITH {INDEX} SELECT security_key, cmid AS current_mid, chg AS change_mid, pmid - smid AS net_mid FROM s ORDER BY {order}, security_key LIMIT 5")(run)


for _by, _order in (("exposure", "cmid DESC"), ("mover", "abs(chg) DESC"), ("buy", "pmid - smid DESC"), ("sell", "pmid - smid")):
    _leader(_by, _order)


def _stock_sql() -> str:
    key = _key_sql("description")
    s = key
    for p in (fixed.STOCK_TAILS, fixed.KEY_CUTS[2], fixed.STOCK_SUFFIXES, fixed.STOCK_KINDS):
        s = f"regexp_replace({s}, '{p}', '', 'g')"
    return rf"coalesce(nullif(trim(regexp_replace({s}, '\s+', ' ', 'g')), ''), {key})"


@query(f"""WITH {TX}, g AS (SELECT {_stock_sql()} AS stock, count(*) AS transaction_count, count(*) FILTER (type = 'Purchase') AS purchase_count, count(*) FILTER (type = 'Sale') AS sale_count,
count(*) FILTER (late) AS late_count, coalesce(sum(mid) FILTER (type = 'Purchase'), 0) AS purchase_midpoint, coalesce(sum(mid) FILTER (type = 'Sale'), 0) AS sale_midpoint,
coalesce(sum(lo) FILTER (type = 'Purchase'), 0) - coalesce(sum(hi) FILTER (type = 'Sale'), 0) AS net_min, coalesce(sum(hi) FILTER (type = 'Purchase'), 0) - coalesce(sum(lo) FILTER (type = 'Sale'), 0) AS net_max,
min(date) FILTER (type = 'Purchase') AS first_purchase, max(date) FILTER (type = 'Purchase') AS last_purchase, max(date) AS last_date FROM tx WHERE asset_type = 'STANDARD' GROUP BY 1)
SELECT *, purchase_midpoint - sale_midpoint AS net_midpoint, CASE WHEN purchase_midpoint > sale_midpoint THEN 'Net buy' WHEN purchase_midpoint < sale_midpoint THEN 'Net sale' ELSE 'Hold' END AS direction,
'Based on disclosed-range midpoint' || CASE WHEN sale_count = 0 THEN '; no sales in visible rows' WHEN net_min < 0 AND net_max > 0 THEN '; range crosses zero' ELSE '' END AS note FROM g WHERE purchase_count > 0""")
def equity_stocks(spark: SparkSession, d: str) -> DataFrame:
    return sectors.stock_summary(tables.transactions(spark, d).where("asset_type = 'STANDARD'"))


FLOW = "coalesce(sum(mid) FILTER (type = 'Purchase'), 0) AS purchase_midpoint, coalesce(sum(mid) FILTER (type = 'Sale'), 0) AS sale_midpoint, count(*) AS transaction_count"


@query(f"WITH {TX} SELECT strftime(date, '%Y-%m') AS month, {FLOW} FROM tx GROUP BY 1")
def monthly_flow(spark: SparkSession, d: str) -> DataFrame:
    return timeline.monthly_flow(tables.transactions(spark, d))


@query(f"""WITH {TX}, m AS (SELECT strftime(date, '%Y-%m') AS month, count(*) FILTER (type = 'Purchase') AS purchases, count(*) FILTER (type = 'Sale') AS sales, count(*) FILTER (late) AS late, count(*) AS n FROM tx GROUP BY 1)
SELECT *, round(late / n, 6) AS late_share, CASE WHEN late / n >= 0.9 THEN 'severe' WHEN late / n >= 0.7 THEN 'high' WHEN late / n >= 0.35 THEN 'medium' ELSE 'low' END AS tone FROM m""")
def monthly_activity(spark: SparkSession, d: str) -> DataFrame:
    return timeline.monthly_activity(tables.transactions(spark, d))


@query(f"""WITH {TX}, r AS (SELECT * FROM tx), f AS (SELECT strftime(date, '%Y-%m') AS month, {FLOW} FROM r GROUP BY 1),
sp AS (SELECT strftime(unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)), '%Y-%m') AS month FROM r)
SELECT month, purchase_midpoint, sale_midpoint, transaction_count FROM sp LEFT JOIN f USING (month)""")
def gap_filled_flow(spark: SparkSession, d: str) -> DataFrame:
    return timeline.gap_filled_flow(tables.transactions(spark, d))


@query(f"WITH {TX} SELECT asset_type, count(*) AS n, sum(mid) AS midpoint FROM tx GROUP BY asset_type")
def asset_mix(spark: SparkSession, d: str) -> DataFrame:
    return tables.transactions(spark, d).groupBy("asset_type").agg(F.count("*").alias("n"), F.sum("amount.midpoint").alias("midpoint"))


@query(f"WITH {TX} SELECT 'sector' AS facet, sector AS value, count(*) AS n FROM tx GROUP BY sector UNION ALL SELECT 'type', type, count(*) FROM tx GROUP BY type UNION ALL SELECT 'year', year(date)::VARCHAR, count(*) FROM tx GROUP BY 2")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    tx = tables.transactions(spark, d)
    facets = F.array(*(F.struct(F.lit(n).alias("facet"), v.alias("value")) for n, v in (("sector", F.col("sector")), ("type", F.col("type")), ("year", F.year("date").cast("string")))))
    return tx.select(F.explode(facets).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


@query(f"""WITH {TX}, y AS (SELECT year(date) AS year, {FLOW} FROM tx GROUP BY 1), a AS (SELECT year(o_orderdate) AS year, sum(o_totalprice) AS asset_value FROM orders GROUP BY 1),
sp AS (SELECT unnest(generate_series(min(year(date)) - 1, max(year(date)) + 1)) AS year FROM tx)
SELECT year::INTEGER AS year, coalesce(transaction_count, 0) AS transaction_count, coalesce(purchase_midpoint, 0) AS purchase_midpoint, coalesce(sale_midpoint, 0) AS sale_midpoint,
round(coalesce(nullif(asset_value, 0), coalesce(purchase_midpoint, 0)), 2) AS exposure FROM sp LEFT JOIN y USING (year) LEFT JOIN a USING (year)""")
def yearly_exposure(spark: SparkSession, d: str) -> DataFrame:
    orders = tables.table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    assets = orders.groupBy("year").agg(F.sum("o_totalprice").alias("asset_value"))
    return timeline.yearly_exposure(tables.transactions(spark, d), assets).withColumn("exposure", F.round("exposure", 2))


@query("""WITH s AS (SELECT o_orderkey, unnest(list_distinct([year(o_orderdate), year(o_orderdate + INTERVAL 45 DAY)])) AS year, o_orderstatus AS status FROM orders)
SELECT year::INTEGER AS year, count(*) FILTER (status = 'F') AS official, count(*) FILTER (status = 'O') AS archived, count(*) FILTER (status = 'P') AS metadata, count(*) AS total FROM s GROUP BY year""")
def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    orders = tables.table(spark, d, "orders").select("o_orderstatus", F.year("o_orderdate").alias("y1"), F.year(F.date_add(F.col("o_orderdate").cast("date"), 45)).alias("y2"))
    status = F.col("o_orderstatus")
    return timeline.two_year_rows(orders, "y1", "y2").groupBy("year").agg(
        F.count_if(status == "F").alias("official"), F.count_if(status == "O").alias("archived"), F.count_if(status == "P").alias("metadata"), F.count("*").alias("total")
    )


@query("""WITH sp AS (SELECT unnest(generate_series(1990, 2010)) AS year), y AS (SELECT year(o_orderdate) AS year, count(*) AS n, count(DISTINCT o_custkey) AS filers FROM orders GROUP BY 1)
SELECT year::INTEGER AS year, coalesce(n, 0) AS n, coalesce(filers, 0) AS filers, CASE WHEN n IS NULL THEN 'gap' WHEN n < 2000 THEN 'thin' ELSE 'covered' END AS state FROM sp LEFT JOIN y USING (year)""")
def year_spine_audit(spark: SparkSession, d: str) -> DataFrame:
    spine = spark.range(1990, 2011).select(F.col("id").cast("int").alias("year"))
    rows = tables.table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("filers"))
    state = F.when(F.col("n").isNull(), "gap").when(F.col("n") < 2000, "thin").otherwise("covered")
    none = F.lit(0).cast("long")
    return spine.join(rows, "year", "left").select("year", F.coalesce("n", none).alias("n"), F.coalesce("filers", none).alias("filers"), state.alias("state"))


def _signups(spark: SparkSession, d: str) -> DataFrame:
    """Events of one kind as dated events: a third name a ticker, a third a sector."""
    rows = tables.dated_events(spark, d, "signup")
    none = F.array().cast("array<string>")
    return rows.select(
        "event_id", "date", F.when(F.col("event_id") % 5 == 0, F.date_add("date", 2)).alias("end_date"), "value", "category",
        F.when(F.col("event_id") % 3 == 0, F.array(F.concat(F.lit("USER"), F.col("user_id") % 20))).otherwise(none).alias("tickers"),
        F.when(F.col("event_id") % 3 == 1, F.array(F.concat(F.lit("S"), F.col("user_id") % 4))).otherwise(none).alias("sectors"),
    )


def _purchases(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table(spark, d, "events").where("event_type in ('purchase', 'click')")
    return rows.select(
        F.col("event_id").alias("id"), F.col("ts").cast("date").alias("date"), F.concat(F.lit("user"), F.col("user_id") % 20).alias("ticker"), F.concat(F.lit("S"), F.col("user_id") % 4).alias("sector"),
        F.when(F.col("event_type") == "purchase", "Purchase").otherwise("Sale").alias("type"), money.bracket_of(F.col("value") * 1000).alias("amount"),
        F.when(F.col("user_id") % 7 == 0, F.concat(F.lit("I"), F.col("user_id") % 5)).alias("issuer_ticker"),
    )


EVENTS_SQL = f"""s AS (SELECT event_id, ts::DATE AS date, CASE WHEN event_id % 5 = 0 THEN ts::DATE + 2 END AS end_date, CASE WHEN event_id % 3 = 0 THEN 'USER' || (user_id % 20) END AS ticker,
CASE WHEN event_id % 3 = 1 THEN 'S' || (user_id % 4) END AS sector FROM events WHERE event_type = 'signup'),
p AS (SELECT event_id AS id, ts::DATE AS date, 'user' || (user_id % 20) AS ticker, 'S' || (user_id % 4) AS sector, CASE event_type WHEN 'purchase' THEN 'Purchase' ELSE 'Sale' END AS type,
{_bracket_sql('value * 1000', 3, '0.0::DOUBLE')} AS mid, CASE WHEN user_id % 7 = 0 THEN 'I' || (user_id % 5) END AS issuer FROM events WHERE event_type IN ('purchase', 'click'))"""  # fmt: skip


@query(f"""WITH {EVENTS_SQL}, w AS (SELECT s.*, unnest([7, 30]) AS window_days FROM s)
SELECT w.event_id, w.window_days::INTEGER AS window_days, count(p.id) AS transaction_count, coalesce(sum(p.mid) FILTER (p.type = 'Purchase'), 0) AS purchase_midpoint,
coalesce(sum(p.mid) FILTER (p.type = 'Sale'), 0) AS sale_midpoint, coalesce(sum(p.mid) FILTER (p.type = 'Purchase'), 0) - coalesce(sum(p.mid) FILTER (p.type = 'Sale'), 0) AS net_midpoint,
coalesce(string_agg(DISTINCT p.ticker, '|' ORDER BY p.ticker), '') AS tickers, coalesce(string_agg(DISTINCT p.sector, '|' ORDER BY p.sector), '') AS sectors, min(p.date) AS first_date, max(p.date) AS last_date
FROM w LEFT JOIN p ON p.date BETWEEN w.date - w.window_days AND coalesce(w.end_date, w.date) + w.window_days
AND ((w.ticker IS NULL AND w.sector IS NULL) OR upper(p.ticker) = w.ticker OR p.sector = w.sector) GROUP BY w.event_id, w.window_days""")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    found = events.event_windows(_signups(spark, d), _purchases(spark, d))
    return found.withColumns({"tickers": F.array_join("tickers", "|"), "sectors": F.array_join("sectors", "|")})


@query("""WITH c AS (SELECT event_type AS category, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY ALL)
SELECT category, month, n, row_number() OVER (ORDER BY n DESC, category DESC, month DESC) = 1 AS is_busiest FROM c""")
def event_density(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table(spark, d, "events").select(F.col("event_type").alias("category"), F.col("ts").cast("date").alias("date"))
    return timeline.density(rows)


@query("""WITH r AS (SELECT event_type AS category, strftime(ts, '%Y-%m') AS month, (user_id % 3 + 1)::INTEGER AS importance, ts::DATE AS date, event_id::VARCHAR AS title FROM events)
SELECT category, month, importance, date, title FROM r QUALIFY row_number() OVER (PARTITION BY category, month ORDER BY importance DESC, date DESC, title) = 1""")
def event_pins(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table(spark, d, "events").select(
        F.col("event_type").alias("category"), (F.col("user_id") % 3 + 1).cast("int").alias("importance"), F.col("ts").cast("date").alias("date"), F.col("event_id").cast("string").alias("title")
    )
    return timeline.pins(rows).select("category", "month", "importance", "date", "title")


@query("SELECT user_id AS event_id, arg_max(event_type, (ts, event_id)) AS category, max(ts) AS ts FROM events GROUP BY user_id")
def event_merge_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table(spark, d, "events").select(F.col("user_id").alias("event_id"), F.col("event_type").alias("category"), "ts", F.struct("ts", "event_id").alias("ord"))
    return events.merged(rows, "ord").select("event_id", "category", "ts")


@query("""WITH r AS (SELECT ts::DATE AS date, event_type AS category, event_id FROM events) SELECT event_id, row_number() OVER (PARTITION BY date, category ORDER BY event_id)::INTEGER - 1 AS stacked_index,
dense_rank() OVER (ORDER BY strftime(date, '%Y-%m'))::INTEGER - 1 AS month_index FROM r""")
def stacked_points(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table(spark, d, "events").select(F.col("ts").cast("date").alias("date"), F.col("event_type").alias("category"), "event_id")
    months = rows.select(timeline.month("date").alias("month")).distinct()  # a row per month
    months = months.withColumn("month_index", F.dense_rank().over(Window.orderBy("month")) - 1)
    placed = timeline.stacked(rows, ["date", "category"], ["event_id"]).withColumn("month", timeline.month("date"))
    return placed.join(F.broadcast(months), "month").select("event_id", "stacked_index", "month_index")


def _config(spark: SparkSession) -> DataFrame:
    schema = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("categories", T.ArrayType(T.StringType()))])
    return spark.createDataFrame([("Brand#1", ["tariff-holding", "foreign-policy"]), ("Brand#5", ["regulatory-holding"]), ("Brand#9", ["fed-rate-sensitive", "regulatory-holding"])], schema)


def _conflict_holdings(spark: SparkSession, d: str) -> DataFrame:
    held = _held(spark, d)
    return held.select(F.col("security_key").alias("holding_id"), "ticker", F.col("description").alias("name"), "sector", F.col("current.midpoint").alias("value"))


POLICY = f"""WITH {GROUPS}, cfg AS (SELECT * FROM (VALUES ('Brand#1', 'tariff-holding'), ('Brand#1', 'foreign-policy'), ('Brand#5', 'regulatory-holding'), ('Brand#9', 'fed-rate-sensitive'), ('Brand#9', 'regulatory-holding')) v(ticker, category)),
pc AS (SELECT 'policy-' || ticker || '-' || category AS indicator_id, CASE WHEN cmid > 500000 THEN 'high' ELSE 'medium' END AS severity, category, ticker, description AS holding, cmid AS value, NULL::VARCHAR AS event_id, 0.7::DOUBLE AS evidence FROM e JOIN cfg USING (ticker))"""  # fmt: skip


@query(f"{POLICY} SELECT * FROM pc")
def conflict_policy(spark: SparkSession, d: str) -> DataFrame:
    return events.policy_conflicts(_conflict_holdings(spark, d), _config(spark))


FED = f"""{POLICY}, ft AS (SELECT coalesce(sum(cmid), 0) AS value, count(*) AS n FROM e WHERE sector = 'EUROPE'),
fc AS (SELECT 'fed-' || event_id AS indicator_id, CASE WHEN ft.value > 1000000 THEN 'high' ELSE 'medium' END AS severity, 'fed-rate-sensitive' AS category, NULL::VARCHAR AS ticker, n || ' financial holdings' AS holding, ft.value, event_id::VARCHAR AS event_id, 0.5::DOUBLE AS evidence
FROM events CROSS JOIN ft WHERE event_type = 'error' AND ft.value > 100000)"""  # fmt: skip


def _rate(spark: SparkSession, d: str) -> DataFrame:
    errors = tables.table(spark, d, "events").where("event_type = 'error'")
    return events.rate_conflicts(_conflict_holdings(spark, d), errors.select("event_id"), F.col("sector") == "EUROPE")


@query(f"{FED} SELECT * FROM fc")
def conflict_fed(spark: SparkSession, d: str) -> DataFrame:
    return _rate(spark, d)


TIMING_CONFIG = [("S0", ["signup"], ['"k": 11']), ("S1", ["error"], ["view"]), ("S2", ["signup", "error"], ['"k": 42', '"k": 43'])]
_KINDS_SQL = ", ".join(f"('{s}', '{k}')" for s, kinds, _ in TIMING_CONFIG for k in kinds)
_SAID_SQL = ", ".join(f"('{s}', '{w}')" for s, _, words in TIMING_CONFIG for w in words)
TIMING = f"""{EVENTS_SQL}, hd AS (SELECT ticker AS holding_id, ticker, max(issuer) AS issuer, min(sector) AS sector, sum(CASE type WHEN 'Purchase' THEN mid ELSE -mid END) AS value FROM p GROUP BY ticker),
ev AS (SELECT event_id, ts::DATE AS date, event_type AS category, event_type AS title, props AS summary FROM events),
mt AS (SELECT c.sector, event_id, date FROM ev JOIN (VALUES {_KINDS_SQL}) c(sector, category) USING (category) UNION SELECT c.sector, event_id, date FROM ev JOIN (VALUES {_SAID_SQL}) c(sector, word) ON contains(lower(title), word) OR contains(lower(summary), word)),
pd AS (SELECT ticker, issuer, date AS d2, count(*) AS n FROM p GROUP BY ALL), sd AS (SELECT DISTINCT sector, date FROM mt),
x AS (SELECT holding_id, sd.date, sum(n) AS related, coalesce(sum(n) FILTER (d2 < sd.date), 0) AS before FROM hd JOIN sd USING (sector) JOIN pd ON d2 BETWEEN sd.date - 30 AND sd.date + 30 AND (pd.ticker = hd.ticker OR pd.issuer IS NOT DISTINCT FROM hd.issuer) GROUP BY ALL),
tc AS (SELECT 'timing-' || holding_id || '-' || event_id AS indicator_id, CASE WHEN before > 0 THEN 'high' ELSE 'medium' END AS severity, 'suspicious-timing' AS category, ticker, holding_id AS holding, value, event_id::VARCHAR AS event_id,
CASE WHEN before > 0 THEN 0.85::DOUBLE ELSE 0.6::DOUBLE END AS evidence, related::BIGINT AS related, before::BIGINT AS before FROM x JOIN hd USING (holding_id) JOIN mt USING (sector, date))"""  # fmt: skip


def _traded_holdings(spark: SparkSession, d: str) -> DataFrame:
    """Holdings of the purchases and clicks, one of each ticker."""
    net = F.when(F.col("type") == "Purchase", F.col("amount.midpoint")).otherwise(-F.col("amount.midpoint"))
    rows = _purchases(spark, d).groupBy("ticker").agg(F.max("issuer_ticker").alias("issuer_ticker"), F.min("sector").alias("sector"), F.sum(net).alias("value"))
    return rows.withColumn("holding_id", F.col("ticker"))


def _timing(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table(spark, d, "events").select("event_id", F.col("ts").cast("date").alias("date"), F.col("event_type").alias("category"), F.col("event_type").alias("title"), F.col("props").alias("summary"))
    config = spark.createDataFrame(TIMING_CONFIG, "sector string, triggers array<string>, words array<string>")
    return events.timing_conflicts(_traded_holdings(spark, d), rows, _purchases(spark, d), config, days=30, strict=False)


@query(f"WITH {TIMING} SELECT * FROM tc")
def conflict_timing(spark: SparkSession, d: str) -> DataFrame:
    return _timing(spark, d)


ALL_CONFLICTS = f"""{FED}, {TIMING}, al AS (SELECT * FROM pc UNION ALL SELECT * FROM fc UNION ALL SELECT indicator_id, severity, category, ticker, holding, value, event_id, evidence FROM tc),
sh AS (SELECT * FROM al ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, evidence DESC, indicator_id LIMIT 100)"""


def _all_conflicts(spark: SparkSession, d: str) -> DataFrame:
    held = cut(_conflict_holdings(spark, d))
    rate = events.rate_conflicts(held, tables.table(spark, d, "events").where("event_type = 'error'").select("event_id"), F.col("sector") == "EUROPE")
    return events.policy_conflicts(held, _config(spark)).unionByName(rate).unionByName(_timing(spark, d).drop("related", "before"))


@query(f"""{ALL_CONFLICTS} SELECT count(*) AS total, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(DISTINCT coalesce(ticker, holding)) AS holdings, count(DISTINCT event_id) AS events,
(SELECT sum(value) FROM al) AS exposure FROM sh""")
def conflict_summary(spark: SparkSession, d: str) -> DataFrame:
    return events.conflict_summary(_all_conflicts(spark, d))


@query(f"{ALL_CONFLICTS} SELECT category, severity, count(*) AS n, sum(value) AS value, max(evidence) AS evidence, string_agg(indicator_id, '|' ORDER BY evidence DESC, indicator_id) AS indicators FROM sh GROUP BY category, severity")
def conflict_groups(spark: SparkSession, d: str) -> DataFrame:
    return events.conflicts_by(_all_conflicts(spark, d), "category", "severity").withColumn("indicators", F.array_join("indicators", "|"))


@query(f"{ALL_CONFLICTS} SELECT indicator_id, value FROM sh WHERE severity = 'high' AND category = 'suspicious-timing'")
def conflict_filter(spark: SparkSession, d: str) -> DataFrame:
    shown = events.ranked_conflicts(_all_conflicts(spark, d))
    return events.filtered_conflicts(shown, severity="high", category="suspicious-timing").select("indicator_id", "value")


@query(f"""WITH {TIMING}, sh AS (SELECT * FROM tc ORDER BY CASE severity WHEN 'high' THEN 3 ELSE 2 END DESC, evidence DESC, indicator_id LIMIT 100),
lk AS (SELECT DISTINCT sh.indicator_id, p.id FROM sh JOIN ev ON ev.event_id::VARCHAR = sh.event_id JOIN hd ON hd.holding_id = sh.holding JOIN p ON p.ticker = hd.ticker AND p.date BETWEEN ev.date - 30 AND ev.date + 30)
SELECT ev.date, 'event' AS type, ev.event_id::VARCHAR AS id, title, string_agg(DISTINCT indicator_id, '|' ORDER BY indicator_id) AS indicators FROM ev JOIN sh ON ev.event_id::VARCHAR = sh.event_id GROUP BY ALL
UNION ALL SELECT p.date, 'transaction', p.id::VARCHAR, p.type || ': ' || left(p.ticker, 50) || '...', string_agg(DISTINCT indicator_id, '|' ORDER BY indicator_id) FROM p JOIN lk USING (id) GROUP BY p.date, p.id, p.type, p.ticker""")
def conflict_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Events and transactions (here by ticker) of the ranked timing indicators."""
    shown = cut(events.ranked_conflicts(_timing(spark, d)))
    rows = tables.table(spark, d, "events").select("event_id", F.col("ts").cast("date").alias("date"), F.col("event_type").alias("title"))
    tx = _purchases(spark, d).withColumn("description", F.col("ticker"))
    spans = shown.join(rows.select(F.col("event_id").cast("string").alias("event_id"), "date"), "event_id").select("indicator_id", "ticker", F.date_sub("date", 30).alias("low"), F.date_add("date", 30).alias("high"))
    bare = tx.select(F.col("id").alias("tx_id"), F.col("ticker").alias("tx_ticker"), F.col("date").alias("tx_date"))
    links = joins.interval_join(spans, bare, "low", "high", "tx_date", 16, also=F.col("ticker") == F.col("tx_ticker")).select("indicator_id", "tx_id").distinct()
    found = events.conflict_timeline(shown, rows, links.withColumn("tx_id", F.col("tx_id").cast("string")), tx.withColumn("id", F.col("id").cast("string")))
    return found.withColumn("indicators", F.array_join("indicators", "|"))


@query(f"WITH {EVENTS_SQL} SELECT event_id FROM s WHERE year(date) = 2024 AND coalesce(end_date, date) >= DATE '2024-01-10' AND date <= DATE '2024-01-12'")
def event_overlap_filter(spark: SparkSession, d: str) -> DataFrame:
    return events.shown_events(_signups(spark, d), "2024", "2024-01-10", "2024-01-12").select("event_id")


@query(f"SELECT p_partkey, {NORMAL.format('p_name')} AS normal, {_key_sql(chr(39) + 'Class A ' + chr(39) + ' || p_name || ' + chr(39) + ' Common due 01/02' + chr(39))} AS key FROM part")
def normalized_keys(spark: SparkSession, d: str) -> DataFrame:
    part = tables.table(spark, d, "part")
    long = F.concat(F.lit("Class A "), F.col("p_name"), F.lit(" Common due 01/02"))
    return part.select("p_partkey", text.normal_description(F.col("p_name")).alias("normal"), text.security_key(long).alias("key"))


CLASS_WORDS = ["STEEL BANK CORP", "CNTY SCH DIST 5% DUE 09/01/35", "VANGUARD FUND", "APPLE INC COM", "PLAIN", "U S BANK ACCOUNT", "REALTY PFD", "OIL CO NOTE"]


def _class_sql(normal: str) -> str:
    def m(p: str) -> str:
        return f"regexp_matches({normal}, '{p}')"

    sector = "CASE " + " ".join(f"WHEN {m(chr(92) + 'b(' + w + ')' + chr(92) + 'b')} THEN '{s}'" for s, w in fixed.SECTOR_WORDS) + " END"
    return f"""CASE WHEN {m(fixed.CASH)} THEN ['Other', 'Cash & Bank Accounts', '0.82'] WHEN {m(fixed.MUNICIPAL)} AND {m(fixed.BOND)} THEN ['Municipal Bond', 'Municipal Bonds', '0.9']
    WHEN {m(fixed.FUND)} THEN ['ETF / Fund', 'ETF / Funds', '0.88'] WHEN {m(fixed.PREFERRED)} THEN ['Preferred / Hybrid', coalesce({sector}, 'Preferred / Hybrid'), '0.82']
    WHEN {m(fixed.BOND)} THEN ['Corporate Bond', coalesce({sector}, 'Corporate Credit'), '0.78'] WHEN {m(fixed.EQUITY)} THEN ['Equity', coalesce({sector}, 'Unclassified Equity'), CASE WHEN {sector} IS NULL THEN '0.62' ELSE '0.78' END]
    WHEN {sector} IS NOT NULL THEN ['Equity', {sector}, '0.66'] ELSE ['Other', 'Other', '0.55'] END"""


_WORDS_SQL = "[" + ", ".join(f"'{w}'" for w in CLASS_WORDS) + "]"


@query(f"""WITH r AS (SELECT p_partkey, {NORMAL.format("p_name || ' ' || " + _WORDS_SQL + "[(p_partkey % 8 + 1)::INTEGER]")} AS n FROM part), c AS (SELECT p_partkey, {_class_sql('n')} AS c FROM r)
SELECT c[1] AS asset_type, c[2] AS sector, c[3]::DOUBLE AS confidence, count(*) AS n FROM c GROUP BY ALL""")
def classified_securities(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*(F.lit(w) for w in CLASS_WORDS))
    part = tables.table(spark, d, "part").withColumn("t", F.concat_ws(" ", "p_name", F.element_at(words, (F.col("p_partkey") % 8 + 1).cast("int"))))
    found = part.select(text.classified(F.col("t")).alias("c")).select("c.found.*")
    return found.groupBy("asset_type", "sector", "confidence").agg(F.count("*").alias("n"))


@query(f"SELECT s_suppkey, {_stable_sql(chr(39) + 'holding|' + chr(39) + ' || s_name')} AS id FROM supplier")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "supplier").select("s_suppkey", text.stable_id(F.concat(F.lit("holding|"), F.col("s_name"))).alias("id"))


@query("""WITH n AS (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 1) AS block FROM part), p AS (SELECT a.name AS left_name, b.name AS right_name,
CASE WHEN length(a.name) >= 5 AND length(b.name) >= 5 AND (contains(a.name, b.name) OR contains(b.name, a.name)) THEN 0.84 + 0.08 * least(length(a.name), length(b.name)) / greatest(length(a.name), length(b.name))
ELSE greatest(len(list_intersect(list_distinct(string_split(a.name, ' ')), list_distinct(string_split(b.name, ' ')))) / len(list_distinct(list_concat(string_split(a.name, ' '), string_split(b.name, ' ')))),
0.92 * (1 - levenshtein(replace(upper(a.name), ' ', ''), replace(upper(b.name), ' ', '')) / greatest(length(replace(a.name, ' ', '')), length(replace(b.name, ' ', ''))))) END AS s
FROM n a JOIN n b ON a.block = b.block AND a.name < b.name) SELECT left_name, right_name, round(s, 6) AS similarity FROM p WHERE s >= 0.6""")
def fuzzy_block_match(spark: SparkSession, d: str) -> DataFrame:
    names = tables.table(spark, d, "part").select(F.col("p_name").alias("name")).distinct().withColumn("block", F.split("name", " ")[0])
    pairs = names.alias("a").join(names.alias("b"), (F.col("a.block") == F.col("b.block")) & (F.col("a.name") < F.col("b.name")))
    scored = pairs.select(F.col("a.name").alias("left_name"), F.col("b.name").alias("right_name"), text.issuer_similarity(F.col("a.name"), F.col("b.name")).alias("s"))
    return scored.where("s >= 0.6").select("left_name", "right_name", F.round("s", 6).alias("similarity"))


@query("""WITH c AS (SELECT p_brand AS k, p_name AS name, max(p_retailprice) AS score FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second FROM c WINDOW w AS (PARTITION BY k ORDER BY score DESC, name))
SELECT k, name, score, round(score - second, 6) AS gap, coalesce(score - second < 0.5, false) AS ambiguous FROM r WHERE rn = 1""")
def ambiguity_gap(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table(spark, d, "part").groupBy(F.col("p_brand").alias("k"), F.col("p_name").alias("name")).agg(F.max("p_retailprice").alias("score"))
    order = Window.partitionBy("k").orderBy(F.col("score").desc(), "name")
    ranked = rows.withColumns({"rn": F.row_number().over(order), "second": F.lead("score").over(order)}).where("rn = 1")
    gap = F.col("score") - F.col("second")
    return ranked.select("k", "name", "score", F.round(gap, 6).alias("gap"), F.coalesce(gap < 0.5, F.lit(False)).alias("ambiguous"))


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS customers, max(c_name) AS cname FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS suppliers, max(s_name) AS sname FROM supplier GROUP BY 1)
SELECT k, coalesce(cname, sname) AS name, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers, concat_ws('|', CASE WHEN cname IS NOT NULL THEN 'customer' END, CASE WHEN sname IS NOT NULL THEN 'supplier' END) AS sources FROM c FULL JOIN s USING (k)""")
def full_outer_reference(spark: SparkSession, d: str) -> DataFrame:
    c = tables.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"), F.max("c_name").alias("cname"))
    s = tables.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"), F.max("s_name").alias("sname"))
    none = F.lit(0).cast("long")
    sources = F.concat_ws("|", F.when(F.col("cname").isNotNull(), "customer"), F.when(F.col("sname").isNotNull(), "supplier"))
    return c.join(s, "k", "full").select("k", F.coalesce("cname", "sname").alias("name"), F.coalesce("customers", none).alias("customers"), F.coalesce("suppliers", none).alias("suppliers"), sources.alias("sources"))


@query("""SELECT s_nationkey AS k, 'new' AS origin, max(s_acctbal) AS value FROM supplier GROUP BY 1 UNION ALL
SELECT c_nationkey, 'old', max(c_acctbal) FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier) GROUP BY 1""")
def priority_merge(spark: SparkSession, d: str) -> DataFrame:
    new = tables.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("value")).withColumn("origin", F.lit("new"))
    old = tables.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("value")).withColumn("origin", F.lit("old"))
    return joins.priority_union(["k"], new, old).select("k", "origin", "value")


def _label_sql(rules: list[tuple[str, str]], of: str) -> str:
    return "coalesce(array_to_string(list_sort([x FOR x IN [" + ", ".join(f"CASE WHEN regexp_matches({of}, '{p}') THEN '{n}' END" for n, p in rules) + "] IF x IS NOT NULL]), '|'), '')"


@query(f"""WITH c AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '\\s+', ' ', 'g')) AS t FROM pages)
SELECT page_id, length(t) AS chars, md5(t) AS digest, {_label_sql(fixed.EVENT_TAGS, 'lower(t)')} AS tags, {_label_sql(fixed.EVENT_SECTORS, 'lower(t)')} AS sectors,
CASE WHEN regexp_matches(t, '{fixed.IMPORTANT_3}') THEN 3 WHEN regexp_matches(t, '{fixed.IMPORTANT_2}') THEN 2 ELSE 1 END AS importance FROM c""")
def tagged_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = tables.table(spark, d, "pages").select("page_id", text.clean_html(F.col("html")).alias("t"))
    return pages.select(
        "page_id", F.length("t").cast("long").alias("chars"), F.md5(F.col("t").cast("binary")).alias("digest"), F.array_join(text.labels_of(F.col("t"), fixed.EVENT_TAGS), "|").alias("tags"),
        F.array_join(text.labels_of(F.col("t"), fixed.EVENT_SECTORS), "|").alias("sectors"), text.importance_of(F.col("t")).alias("importance"),
    )


@query("""WITH h AS (SELECT p_brand AS ticker, sum(l_extendedprice) AS cost FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), q AS (SELECT p_brand AS ticker, max(p_retailprice) AS price, min(p_retailprice) AS previous_close FROM part GROUP BY 1)
SELECT round(sum(coalesce(cost / nullif(previous_close, 0) * price, cost)), 2) AS market_value, round(sum(cost), 2) AS cost, count(price) AS quoted, round(sum(coalesce(cost / nullif(previous_close, 0) * price, cost)) - sum(cost), 2) AS gain,
round((sum(coalesce(cost / nullif(previous_close, 0) * price, cost)) - sum(cost)) / sum(cost) * 100, 6) AS gain_pct FROM h LEFT JOIN q USING (ticker)""")
def market_join(spark: SparkSession, d: str) -> DataFrame:
    part = tables.table(spark, d, "part")
    held = tables.table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("ticker")).agg(F.sum("l_extendedprice").alias("cost"))
    quotes = part.groupBy(F.col("p_brand").alias("ticker")).agg(F.max("p_retailprice").alias("price"), F.min("p_retailprice").alias("previous_close"))
    totals = sectors.portfolio_totals(sectors.market_values(held, quotes))
    return totals.select(*(F.round(c, 2).alias(c) for c in ("market_value", "cost", "gain")), "quoted", F.round("gain_pct", 6).alias("gain_pct"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
c AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-Z][a-z]+ing') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS chunk FROM l)
SELECT doc_id, chunk::BIGINT AS chunk, count(*) AS lines, sum(length(line))::BIGINT AS chars, min(n)::INTEGER AS first_line FROM c GROUP BY ALL""")
def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    lines = documents.lines(tables.table(spark, d, "documents"))
    return documents.chunks(lines, F.col("line").rlike("^[A-Z][a-z]+ing"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
c AS (SELECT doc_id, n, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS around FROM l) SELECT doc_id, n::INTEGER AS n, md5(around) AS digest FROM c WHERE contains(lower(around), 'license')""")
def line_context(spark: SparkSession, d: str) -> DataFrame:
    found = documents.context(documents.lines(tables.table(spark, d, "documents")), 2).where(F.contains(F.lower("around"), F.lit("license")))
    return found.select("doc_id", "n", F.md5(F.col("around").cast("binary")).alias("digest"))


@query("SELECT event_type, count(*) AS n, sum((props::JSON->>'k')::BIGINT)::BIGINT AS k_sum, min((props::JSON->>'k')::BIGINT) AS k_min FROM events GROUP BY event_type")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table(spark, d, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k_sum"), F.min("p.k").alias("k_min"))


REVIEW = f"""{GROUPS}, r1 AS (SELECT 1 AS source, row_number() OVER (ORDER BY s_suppkey) AS seq, CASE WHEN s_acctbal < 0 THEN 'high' ELSE 'medium' END AS severity, 'source' AS kind, s_suppkey::VARCHAR AS related_id, s_name AS detail FROM supplier WHERE s_acctbal < 500),
r3 AS (SELECT 3, row_number() OVER (ORDER BY l_orderkey, l_linenumber), CASE WHEN confidence < 0.6 THEN 'high' ELSE 'medium' END, 'classification', id, description || ' | ' || array_to_string(flags, ', ') FROM tx WHERE len(flags) > 0 OR confidence < 0.7),
h2 AS (SELECT *, row_number() OVER (ORDER BY cmid DESC, transaction_count DESC, description, security_key) AS o FROM e), r4 AS (SELECT 4, row_number() OVER (ORDER BY o), 'low', 'baseline', security_key, description FROM h2 WHERE o <= 200 AND missing_baseline)"""  # fmt: skip


from rangeledger import disclosure_queries as _more, registry_queries as _registry  # noqa: E402, F401  register the rest
