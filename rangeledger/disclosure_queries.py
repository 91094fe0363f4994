"""Registered queries of ingest, enrichment, context, identities, pages and stored tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rangeledger import queries as q
from rangeledger.functions import calendar, fixed, instruments, money, text
from rangeledger.operators import context, enrichment, filters, holdings, ingest, resolution, sectors
from rangeledger.plans.api import Engine
from rangeledger.plans.joins import priority_union
from rangeledger.plans.stages import cut, scratch
from rangeledger.queries import GROUPS, INDEX, SQL, TX, _bracket_sql, _key_sql, _label_sql, _stable_sql, query
from rangeledger.sources import readers, sinks, tables

# Words dealt over the rows of a table where the texts of the tables have none of their kind.
NOTICES = ["Executive order on steel imports", "Customs notice &amp; <b>chips</b>", "Plain notice", "Harmonized tariff update", "Bank stock market remarks", "Interview on $ABC and $XYZ trade", "RT: oil and gas", ""]
KINDS = ["executive_order", "remarks", "interview", "proclamation", "press"]
#: Rows of a text or payload made of a table's rows.
DOCUMENT_ROWS = 200
PLACES = ["truth_social", "app", "factbase", "press", "twitter"]


def _pick(values: list[str], by: str) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.col(by) % len(values) + 1).cast("int"))


def _pick_sql(values: list[str], by: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({by} % {len(values)} + 1)::INTEGER]"


# Transactions as a source writes them


RAW_TYPES = ["Purchase", "sale (partial)", "EXCHANGE", " purchase ", "Gift"]


@query(f"""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS position, p_name || ' ' || {_pick_sql(q.CLASS_WORDS, 'l_partkey')} AS description, ' ' || lower(p_brand) || ' ' AS ticker, {_pick_sql(RAW_TYPES, 'l_orderkey')} AS raw, l_shipdate::DATE AS date,
{_bracket_sql('l_extendedprice', 0, "'unknown'")} AS amount, {_bracket_sql('l_extendedprice', 3, '0.0::DOUBLE')} AS mid FROM lineitem JOIN part ON l_partkey = p_partkey),
k AS (SELECT *, lower(trim(raw)) AS low, {q.NORMAL.format('description')} AS n FROM r), c AS (SELECT *, {q._class_sql('n')} AS c, CASE WHEN starts_with(low, 'purchase') THEN 'Purchase' WHEN starts_with(low, 'sale') THEN 'Sale' WHEN starts_with(low, 'exchange') THEN 'Exchange' ELSE 'Other' END AS type FROM k)
SELECT {_stable_sql("concat_ws('|', description, ticker, type, date::VARCHAR, amount, position::VARCHAR)")} AS id, upper(trim(ticker)) AS ticker, type, mid AS midpoint, c[1] AS asset_type, c[2] AS sector,
array_to_string([x FOR x IN [CASE WHEN c[2] IN ('Other', 'Unclassified Equity') OR c[3]::DOUBLE < 0.7 THEN 'Needs sector review' END, CASE WHEN c[1] = 'Other' AND c[2] <> 'Cash & Bank Accounts' THEN 'Needs asset-type review' END,
CASE WHEN mid = 0 THEN 'Unknown amount range' END, CASE WHEN type = 'Other' THEN 'Unexpected transaction type: ' || raw END] IF x IS NOT NULL], '; ') AS flags FROM c""")
def normalized_transactions(spark: SparkSession, d: str) -> DataFrame:
    words = F.element_at(F.array(*(F.lit(w) for w in q.CLASS_WORDS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    # A part has one description: it is classified once, not with each of its lines.
    parts = tables.table(spark, d, "part").select("p_partkey", "p_brand", F.concat_ws(" ", "p_name", words).alias("description"))
    parts = parts.withColumn("c", text.classified(F.col("description")))
    rows = tables.table(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    label = F.when(F.col("l_extendedprice") < 1001, "unknown").otherwise(money.bracket_of(F.col("l_extendedprice"))["label"])
    raw = rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), "description", "c", F.concat(F.lit(" "), F.lower("p_brand"), F.lit(" ")).alias("ticker"),
        _pick(RAW_TYPES, "l_orderkey").alias("type"), F.col("l_shipdate").cast("date").alias("date"), label.alias("amount"), F.lit(None).cast("boolean").alias("late"), F.lit(None).cast("string").alias("url"),
    )
    out = ingest.normalized(raw)
    return out.select("id", "ticker", "type", F.col("amount.midpoint").alias("midpoint"), "asset_type", "sector", F.array_join("flags", "; ").alias("flags"))


# Sources: orders stand for filed sources


FILING_TYPES = ["Annual 278e", "278-T", "Candidate 278e", "Termination 278e", "Other"]
RELIABILITY = ["official", "archived_copy", "metadata_only"]


def _sources(spark: SparkSession, d: str) -> DataFrame:
    o = tables.table(spark, d, "orders")
    key, date = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    url = F.when(key % 7 == 0, None).otherwise(F.concat(F.lit("https://r.example/"), key, F.when(key % 3 == 0, ".PDF?x=1").when(key % 3 == 1, ".pdf").otherwise(".html")))
    return o.select(
        key.alias("source_id"), F.concat_ws(" ", F.lit("Report"), F.year(date) - 1, "o_orderpriority").alias("title"), date.alias("filed_date"), (F.year(date) - (key % 2).cast("int")).alias("report_year"), _pick(FILING_TYPES, "o_orderkey").alias("filing_type"),
        _pick(RELIABILITY, "o_custkey").alias("reliability"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("ok").alias("status"), url.alias("url"),
    )


SOURCES = f"""src AS (SELECT o_orderkey AS source_id, 'Report ' || (year(o_orderdate) - 1) || ' ' || o_orderpriority AS title, o_orderdate::DATE AS filed_date, (year(o_orderdate) - o_orderkey % 2)::INTEGER AS report_year, {_pick_sql(FILING_TYPES, 'o_orderkey')} AS filing_type,
{_pick_sql(RELIABILITY, 'o_custkey')} AS reliability, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'ok' END AS status,
CASE WHEN o_orderkey % 7 <> 0 THEN 'https://r.example/' || o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '.PDF?x=1' WHEN 1 THEN '.pdf' ELSE '.html' END END AS url FROM orders)"""


@query(f"WITH {SOURCES} SELECT source_id FROM src WHERE (report_year = 1997 OR year(filed_date) = 1997) AND reliability = 'official'")
def source_filter(spark: SparkSession, d: str) -> DataFrame:
    return ingest.filtered_sources(_sources(spark, d), "1997", "official").select("source_id")


@query(f"WITH {SOURCES} SELECT source_id, year(filed_date)::INTEGER - 1 AS named FROM src WHERE filing_type IN ('Annual 278e', 'Candidate 278e', 'Termination 278e') AND regexp_matches(url, '(?i)\\.pdf($|\\?)') AND status <> 'failed'")
def parseable_sources(spark: SparkSession, d: str) -> DataFrame:
    return ingest.parseable_sources(_sources(spark, d)).select("source_id", ingest.year_named(F.col("title")).alias("named"))


@query(f"WITH {SOURCES} SELECT source_id, filed_date FROM src WHERE filing_type = 'Annual 278e' AND url IS NOT NULL AND status <> 'failed' ORDER BY filed_date DESC, CASE reliability WHEN 'official' THEN 3 WHEN 'archived_copy' THEN 2 ELSE 1 END DESC, source_id LIMIT 1")
def latest_annual_source(spark: SparkSession, d: str) -> DataFrame:
    return ingest.latest_source(_sources(spark, d), "Annual 278e").select("source_id", "filed_date")


@query(f"WITH {SOURCES}, c AS (SELECT c_custkey, c_name, c_mktsegment FROM customer) SELECT source_id FROM src JOIN orders ON source_id = o_orderkey JOIN c ON o_custkey = c_custkey WHERE regexp_matches(c_name, '(?i)customer#0*1') AND regexp_matches(filing_type, '(?i)278') AND filed_date >= DATE '1998-01-01'")
def supported_records(spark: SparkSession, d: str) -> DataFrame:
    names = tables.table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("filer"))
    of = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("source_id"), "o_custkey")
    records = _sources(spark, d).join(of, "source_id").join(names, F.col("o_custkey") == F.col("c_custkey")).withColumn("type", F.col("filing_type"))
    return ingest.supported_records(records, "customer#0*1", "278", "1998-01-01").select("source_id")


@query(f"""WITH {SOURCES}, a AS (SELECT l_orderkey AS source_id, count(*) FILTER (l_returnflag = 'A') AS assets, count(*) FILTER (l_returnflag = 'R') AS liabilities FROM lineitem GROUP BY 1)
SELECT source_id, coalesce(assets, 0) AS assets, coalesce(liabilities, 0) AS liabilities, CASE WHEN coalesce(assets, 0) + coalesce(liabilities, 0) > 0 THEN 'parsed' ELSE 'needs-review' END AS parser_status FROM src LEFT JOIN a USING (source_id) WHERE filing_type <> '278-T'""")
def disclosure_reports(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), "l_returnflag")
    found = ingest.reports(_sources(spark, d), rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'"))
    return found.select("source_id", "assets", "liabilities", "parser_status")


@query(f"WITH {SOURCES}, r AS (SELECT 'https://r.example/' || l_orderkey || '.pdf' AS url, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT url, n FROM r WHERE url NOT IN (SELECT url FROM src WHERE url IS NOT NULL)")
def unregistered_records(spark: SparkSession, d: str) -> DataFrame:
    records = tables.table(spark, d, "lineitem").groupBy(F.concat(F.lit("https://r.example/"), "l_orderkey", F.lit(".pdf")).alias("url")).agg(F.count("*").alias("n"))
    return ingest.unregistered(records, _sources(spark, d))


@query(f"WITH {TX}, {SOURCES} SELECT DISTINCT year::INTEGER AS year FROM (SELECT year(date) AS year FROM tx UNION ALL SELECT report_year FROM src)")
def available_years(spark: SparkSession, d: str) -> DataFrame:
    return ingest.available_years(tables.transactions(spark, d), _sources(spark, d))


@query("SELECT DISTINCT c AS cik FROM (SELECT unnest([CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey END, CASE WHEN l_partkey % 5 = 0 THEN l_partkey END]) AS c FROM lineitem) WHERE c IS NOT NULL")
def resolved_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table(spark, d, "lineitem").select(F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")).alias("resolved_cik"), F.when(F.col("l_partkey") % 5 == 0, F.col("l_partkey")).alias("issuer_cik"))
    return ingest.resolved_numbers(rows)


@query(f"WITH {TX}, {SOURCES} SELECT (SELECT count(*) FROM tx) AS transactions, (SELECT count(*) FROM tx WHERE late) AS late, (SELECT count(*) FROM src) AS sources, (SELECT count(*) FROM src WHERE reliability = 'official') AS official, (SELECT count(*) FROM events) AS events")
def cache_meta(spark: SparkSession, d: str) -> DataFrame:
    frames = {"transactions": tables.transactions(spark, d), "sources": _sources(spark, d), "events": tables.table(spark, d, "events")}
    return ingest.cache_meta(frames, {"late": ("transactions", "late"), "official": ("sources", "reliability = 'official'")})


@query(f"""SELECT {_stable_sql("concat_ws('|', 'baseline-holding', s_suppkey::VARCHAR, " + q.NORMAL.format('s_name') + ", " + _bracket_sql('s_acctbal', 0, "'None (or less than $1,001)'") + ")")} AS baseline_id, {_bracket_sql('s_acctbal', 3, '0.0::DOUBLE')} AS midpoint, least(0.5 + s_nationkey / 50.0, 0.74)::DOUBLE AS confidence FROM supplier WHERE s_acctbal >= 1001""")
def baseline_of_assets(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("description"), text.normal_description(F.col("s_name")).alias("normalized_description"), money.bracket_of(F.col("s_acctbal")).alias("value"), F.lit("Other").alias("asset_type"),
        F.lit("Other").alias("sector"), (F.lit(0.5) + F.col("s_nationkey") / 50).alias("confidence"), F.array(F.lit(fixed.BASELINE_FLAG)).alias("flags"),
    )
    return ingest.baseline_of_assets(rows).where(F.size("flags") == 1).select("baseline_id", F.col("value.midpoint").alias("midpoint"), "confidence")


# Enrichment


@query(f"""WITH {TX} SELECT {_key_sql('description')} AS security_key, coalesce(ticker, '') AS source_ticker, arg_min(description, (l_orderkey, l_linenumber)) AS description, count(*) AS transaction_count,
string_agg(DISTINCT asset_type, '|' ORDER BY asset_type) AS asset_types, sum(mid) AS midpoint, {_stable_sql("concat_ws('|', 'security-enrichment', " + _key_sql('description') + ", coalesce(ticker, ''))")} AS group_id FROM tx GROUP BY ALL""")
def security_groups(spark: SparkSession, d: str) -> DataFrame:
    return enrichment.security_groups(tables.transactions(spark, d)).withColumn("asset_types", F.array_join("asset_types", "|"))


LOOKED_UP = ["STANDARD", "PROMO"]
LOOKUP = f"""{TX}, g AS (SELECT {_key_sql('description')} AS security_key, arg_min(description, (l_orderkey, l_linenumber)) AS description, count(*) AS transaction_count, sum(mid) AS midpoint FROM tx WHERE asset_type IN ('STANDARD', 'PROMO') GROUP BY 1)"""


@query(f"WITH {LOOKUP} SELECT * FROM g")
def lookup_groups(spark: SparkSession, d: str) -> DataFrame:
    return enrichment.lookup_groups(tables.transactions(spark, d), LOOKED_UP)


CACHE = f"""ca AS (SELECT k AS security_key, any_value(st) AS status, any_value(CASE WHEN st = 'matched' THEN 'BBG' || upper(left(md5(k), 9)) END) AS figi, 1.0::DOUBLE AS midpoint, 1::BIGINT AS transaction_count
FROM (SELECT {_key_sql("p_name || ' ' || p_brand")} AS k, ['matched', 'failed', 'ambiguous'][(length({_key_sql("p_name || ' ' || p_brand")}) % 3 + 1)::INTEGER] AS st FROM part WHERE p_retailprice < 1500) GROUP BY k)"""


def _cache(spark: SparkSession, d: str) -> DataFrame:
    keys = tables.table(spark, d, "part").where("p_retailprice < 1500").select(text.security_key(F.concat_ws(" ", "p_name", "p_brand")).alias("security_key")).distinct()
    status = F.element_at(F.array(F.lit("matched"), F.lit("failed"), F.lit("ambiguous")), F.length("security_key") % 3 + 1)
    figi = F.when(F.col("status") == "matched", F.concat(F.lit("BBG"), F.upper(F.left(F.md5(F.col("security_key").cast("binary")), F.lit(9)))))
    return keys.withColumn("status", status).withColumn("figi", figi).withColumns({"midpoint": F.lit(1.0), "transaction_count": F.lit(1).cast("long")})


@query(f"""WITH {LOOKUP}, {CACHE}, w AS (SELECT g.*, row_number() OVER (ORDER BY g.midpoint DESC, g.transaction_count DESC, description, security_key) AS o FROM g LEFT JOIN ca USING (security_key) WHERE ca.status IS NULL OR ca.status = 'failed')
SELECT security_key, g.midpoint, g.transaction_count, ca.status, ca.figi FROM g JOIN ca USING (security_key) WHERE ca.status <> 'failed'
UNION ALL SELECT security_key, midpoint, transaction_count, CASE WHEN o > 40 THEN 'not_queried' WHEN length(security_key) % 2 = 0 THEN 'matched' ELSE 'failed' END, CASE WHEN o <= 40 AND length(security_key) % 2 = 0 THEN 'BBG000000000' END FROM w
UNION ALL SELECT security_key, midpoint, transaction_count, status, figi FROM ca WHERE security_key NOT IN (SELECT security_key FROM g)""")
def identifier_cache_merge(spark: SparkSession, d: str) -> DataFrame:
    groups = cut(enrichment.lookup_groups(tables.transactions(spark, d), LOOKED_UP))
    looked = groups.where(F.length("security_key") % 2 == 0).select("security_key", F.lit("matched").alias("status"), F.lit("BBG000000000").alias("figi"))
    return enrichment.merged_cache(groups, _cache(spark, d), looked, 40)


@query(f"""WITH {TX}, {CACHE}, t AS (SELECT id, asset_type, {_key_sql('description')} AS security_key, CASE WHEN l_linenumber = 1 THEN 'C' END AS cusip FROM tx)
SELECT id, CASE WHEN cusip IS NULL AND asset_type IN ('STANDARD', 'PROMO') AND ca.status = 'matched' THEN ca.figi END AS figi, CASE WHEN cusip IS NULL AND asset_type IN ('STANDARD', 'PROMO') AND ca.status = 'matched' THEN 'exact' ELSE 'needs_identifier' END AS reference_status,
CASE WHEN cusip IS NULL AND asset_type IN ('STANDARD', 'PROMO') AND ca.status = 'matched' THEN 'Other|{fixed.FIGI_FLAG}' ELSE 'Other|No CUSIP/ISIN parsed' END AS flags FROM t LEFT JOIN ca USING (security_key)""")
def identifiers_applied(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    tx = tables.transactions(spark, d).select("id", "description", "asset_type", F.when(F.col("ord.l_linenumber") == 1, "C").alias("cusip"), none.alias("isin"), none.alias("figi"), F.lit("needs_identifier").alias("reference_status"), F.array(F.lit("Other"), F.lit("No CUSIP/ISIN parsed")).alias("flags"))
    return enrichment.identifiers_applied(tx, _cache(spark, d), LOOKED_UP).select("id", "figi", "reference_status", F.array_join("flags", "|").alias("flags"))


@query("""SELECT p_partkey, CASE WHEN s_suppkey IS NOT NULL THEN s_nationkey::VARCHAR END AS sic, CASE WHEN s_suppkey IS NOT NULL THEN 'industry ' || s_nationkey ELSE 'own' END AS sic_description, CASE WHEN s_suppkey IS NOT NULL THEN s_name ELSE 'own sector' END AS sector FROM part LEFT JOIN supplier ON p_partkey % 300 = s_suppkey""")
def reference_industries(spark: SparkSession, d: str) -> DataFrame:
    reference = tables.table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 300).alias("cik"), F.lit("own").alias("sic_description"), F.lit("own sector").alias("sector"))
    industries = tables.table(spark, d, "supplier").select(F.col("s_suppkey").alias("cik"), F.col("s_nationkey").cast("string").alias("sic"), F.concat(F.lit("industry "), "s_nationkey").alias("sic_description"), F.col("s_name").alias("sector"))
    return enrichment.with_industry(reference, industries).select("p_partkey", "sic", "sic_description", "sector")


@query(f"""WITH {TX}, r AS (SELECT DISTINCT {_key_sql("p_name || ' ' || p_brand")} AS k FROM part), v AS (SELECT k, length(k) % 4 AS m FROM r),
t AS (SELECT id, {_key_sql('description')} AS k, CASE p_size % 3 WHEN 0 THEN 'Equity' WHEN 1 THEN 'Corporate Bond' ELSE 'ETF / Fund' END AS kind, CASE WHEN p_size % 2 = 0 THEN 'Unclassified Equity' ELSE 'Other' END AS sector FROM tx),
j AS (SELECT t.*, CASE WHEN m < 3 THEN 'R' || m END AS rs, [0.9, 0.77, 0.95, 0.5][m + 1]::DOUBLE AS mc FROM t JOIN v USING (k)), u AS (SELECT *, rs IS NOT NULL AND kind <> 'ETF / Fund' AND mc >= CASE WHEN kind = 'Equity' THEN 0.78 ELSE 0.75 END AS ok FROM j)
SELECT id, CASE WHEN ok THEN rs ELSE sector END AS sector, CASE WHEN ok THEN greatest(0.62, least(0.92, mc)) ELSE 0.62 END::DOUBLE AS confidence, CASE WHEN ok THEN 'Low-confidence issuer match' ELSE 'Needs sector review|Low-confidence issuer match' END AS flags FROM u""")
def resolutions_applied(spark: SparkSession, d: str) -> DataFrame:
    keys = tables.table(spark, d, "part").select(text.security_key(F.concat_ws(" ", "p_name", "p_brand")).alias("security_key")).distinct()
    m = F.length("security_key") % 4
    found = keys.select("security_key", F.when(m < 3, F.concat(F.lit("R"), m)).alias("resolved_sector"), F.lit("T").alias("resolved_ticker"), F.element_at(F.array(*(F.lit(x) for x in (0.9, 0.77, 0.95, 0.5))), m + 1).alias("match_confidence"), F.array(F.lit("Low-confidence issuer match")).alias("match_flags"))
    size = F.col("p_size")
    tx = tables.transactions(spark, d).select("id", "description", F.when(size % 3 == 0, "Equity").when(size % 3 == 1, "Corporate Bond").otherwise("ETF / Fund").alias("asset_type"), F.when(size % 2 == 0, "Unclassified Equity").otherwise("Other").alias("sector"), F.lit(0.62).alias("confidence"), F.array(F.lit("Needs sector review")).alias("flags"))
    return enrichment.applied(tx, found).select("id", "sector", "confidence", F.array_join("flags", "|").alias("flags"))


@query("""WITH r AS (SELECT a.s_suppkey, a.s_nationkey AS n1, b.s_nationkey AS n2 FROM supplier a LEFT JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1)
SELECT s_suppkey, coalesce(CASE WHEN n1 % 3 <> 0 THEN 'K' || n1 END, 'K' || n2) AS kind, CASE greatest(n1 % 4, coalesce(n2 % 4, 0)) WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'issuer_context_only' WHEN 2 THEN 'needs_identifier' ELSE 'exact' END AS status,
CASE greatest(n1 % 3, coalesce(n2 % 3, 0)) WHEN 0 THEN 'verified' WHEN 1 THEN 'needs_review' ELSE 'rejected' END AS review, greatest(n1, coalesce(n2, 0)) / 25.0::DOUBLE AS confidence, CASE WHEN n2 IS NULL OR n1 = n2 THEN 'F' || n1 ELSE 'F' || n1 || '|F' || n2 END AS flags FROM r""")
def merged_contexts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("s_nationkey")
    own = F.struct(
        F.when(n % 3 != 0, F.concat(F.lit("K"), n)).alias("kind"), F.element_at(F.array(*(F.lit(s) for s in instruments.STATUS)), n % 4 + 1).alias("status"), F.element_at(F.array(*(F.lit(s) for s in instruments.REVIEW)), n % 3 + 1).alias("review"),
        (n / 25).alias("confidence"), F.array(F.concat(F.lit("F"), n)).alias("flags"),
    )
    full = F.struct(F.concat(F.lit("K"), n).alias("kind"), *(own[c].alias(c) for c in ("status", "review", "confidence", "flags")))
    rows = tables.table(spark, d, "supplier")
    pairs = rows.select("s_suppkey", own.alias("a")).join(rows.select((F.col("s_suppkey") - 1).alias("s_suppkey"), full.alias("b")), "s_suppkey", "left")
    return pairs.select("s_suppkey", *enrichment.merged_context("a", "b", ["kind"])).withColumn("flags", F.array_join("flags", "|"))


BOND = "p_name || ' ' || CASE WHEN p_partkey % 3 = 0 THEN 'DUE 0' || (p_size % 9 + 1) || '/15/' || (20 + p_size) || ' ' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN (p_size % 9 + 1) || '.' || (100 + p_size) || '% ' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN 'CALLABLE 11/01/2031 AT 100.5 ' ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN 'CUSIP 12345678' || (p_size % 10) ELSE '' END"


def _bonds(spark: SparkSession, d: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    due = F.when(key % 3 == 0, F.concat(F.lit("DUE 0"), size % 9 + 1, F.lit("/15/"), size + 20, F.lit(" "))).otherwise("")
    coupon = F.when(key % 2 == 0, F.concat(size % 9 + 1, F.lit("."), size + 100, F.lit("% "))).otherwise("")
    call, cusip = F.when(key % 5 == 0, "CALLABLE 11/01/2031 AT 100.5 ").otherwise(""), F.when(key % 7 == 0, F.concat(F.lit("CUSIP 12345678"), size % 10)).otherwise("")
    return tables.table(spark, d, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(" "), due, coupon, call, cusip).alias("description"))


@query(f"""WITH b AS (SELECT p_partkey, upper({BOND}) AS t, p_size FROM part), x AS (SELECT p_partkey, nullif(regexp_extract(t, '\\bDUE\\s+(\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}})\\b', 1), '') AS due, TRY_CAST(nullif(regexp_extract(t, '\\b(\\d{{1,2}}(\\.\\d{{1,4}})?)\\s*%', 1), '') AS DOUBLE) AS coupon,
nullif(regexp_extract(t, '\\bCUSIP\\s*([A-Z0-9]{{9}})\\b', 1), '') AS cusip, t LIKE '%CALLABLE 11/01/2031%' AS call FROM b),
y AS (SELECT *, CASE WHEN due IS NOT NULL THEN (CASE WHEN split_part(due, '/', 3)::INT < 70 THEN 2000 ELSE 1900 END + split_part(due, '/', 3)::INT)::VARCHAR || '-' || lpad(split_part(due, '/', 1), 2, '0') || '-15' END AS maturity FROM x)
SELECT p_partkey, coupon, maturity, cusip, CASE WHEN call THEN '2031-11-01' END AS call_date, CASE WHEN call THEN 100.5::DOUBLE END AS call_price, CASE WHEN cusip IS NOT NULL THEN 'exact' ELSE 'needs_identifier' END AS status,
least(0.92, (64 + CASE WHEN coupon IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN maturity IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN call THEN 4 ELSE 0 END + CASE WHEN cusip IS NOT NULL THEN 14 ELSE 0 END) / 100.0)::DOUBLE AS confidence FROM y""")
def bond_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = _bonds(spark, d).select("p_partkey", instruments.parsed(F.col("description"), F.lit("Corporate Bond")).alias("p"))
    return rows.select("p_partkey", *(F.col(f"p.{c}").alias(c) for c in ("coupon", "maturity", "cusip", "call_date", "call_price", "status", "confidence")))


@query(f"""WITH b AS (SELECT p_partkey, upper(p_name) AS issuer, {BOND} AS t, p_partkey % 3 = 0 AS m, p_partkey % 2 = 0 AS c, p_partkey % 5 = 0 AS k, p_partkey % 7 = 0 AS u, p_size FROM part),
f AS (SELECT *, [x FOR x IN [CASE WHEN c THEN (p_size % 9 + 1) || '.' || regexp_replace((100 + p_size)::VARCHAR, '0+$', '') || '% coupon' END,
CASE WHEN m THEN 'due ' || (CASE WHEN 20 + p_size < 70 THEN 2000 ELSE 1900 END + 20 + p_size) || '-' || lpad((p_size % 9 + 1)::VARCHAR, 2, '0') || '-15' END, CASE WHEN k THEN 'callable 2031-11-01 at 100.5' END, CASE WHEN u THEN 'CUSIP 12345678' || (p_size % 10) END] IF x IS NOT NULL] AS facts FROM b)
SELECT p_partkey, 'Issuer corporate bond/note' || CASE WHEN len(facts) > 0 THEN ' (' || array_to_string(facts, '; ') || ')' ELSE '' END || '.' AS said FROM f""")
def instrument_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = _bonds(spark, d).select("p_partkey", instruments.parsed(F.col("description"), F.lit("Corporate Bond")).alias("p"))
    return rows.select("p_partkey", enrichment.instrument_sentence(F.lit("Issuer"), "p").alias("said"))


# Context documents and events: orders stand for documents


def _documents(spark: SparkSession, d: str) -> DataFrame:
    o, key = tables.table(spark, d, "orders"), F.col("o_orderkey")
    return o.select(
        key.alias("id"), _pick(PLACES, "o_orderkey").alias("source"), _pick(KINDS, "o_custkey").alias("doc_type"), _pick(NOTICES, "o_custkey").alias("title"), F.when(key % 3 == 0, "A. Speaker").otherwise("Other").alias("speaker"),
        F.concat_ws(" ", _pick(NOTICES, "o_orderkey"), "o_orderpriority", F.lit("https://x.example/a"), F.lit("end")).alias("full_text"), F.col("o_orderdate").cast("date").alias("doc_date"), F.when(key % 4 != 0, F.concat(F.lit("https://d.example/"), key)).alias("url"),
    )


DOCS = f"""dc AS (SELECT o_orderkey AS id, {_pick_sql(PLACES, 'o_orderkey')} AS source, {_pick_sql(KINDS, 'o_custkey')} AS doc_type, {_pick_sql(NOTICES, 'o_custkey')} AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'A. Speaker' ELSE 'Other' END AS speaker,
{_pick_sql(NOTICES, 'o_orderkey')} || ' ' || o_orderpriority || ' https://x.example/a end' AS full_text, o_orderdate::DATE AS doc_date, CASE WHEN o_orderkey % 4 <> 0 THEN 'https://d.example/' || o_orderkey END AS url FROM orders)"""
SAYS = "regexp_matches({0}, '(?i)" + "|".join(fixed.CONTEXT_WORDS) + "')"


@query(f"""WITH {DOCS} SELECT id FROM dc WHERE doc_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND source IN ('truth_social', 'twitter') AND speaker ILIKE '%speaker%' AND NOT title ILIKE 'RT:%' AND ({SAYS.format('title')} OR {SAYS.format('full_text')}) ORDER BY doc_date DESC, id DESC LIMIT 500""")
def social_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    return context.taken(docs, context.social_posts(docs, "speaker"), "doc_date", "1996-01-01", "1998-12-31", 500, "id").select("id")


_OFFICIAL = "', '".join(fixed.OFFICIAL_TYPES)


@query(f"""WITH {DOCS} SELECT id FROM dc WHERE doc_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND (source IN ('app', 'factbase') OR doc_type IN ('{_OFFICIAL}')) AND (speaker ILIKE '%speaker%' OR title ILIKE '%speaker%')
AND ({SAYS.format('title')} OR {SAYS.format('full_text')} OR doc_type IN ('executive_order', 'proclamation', 'memorandum')) ORDER BY doc_date DESC, id DESC LIMIT 450""")
def official_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    return context.taken(docs, context.official_documents(docs, "speaker"), "doc_date", "1996-01-01", "1998-12-31", 450, "id").select("id")


_CLEAN = "trim(regexp_replace(regexp_replace({0}, '\\s+', ' ', 'g'), 'https?://\\S+', '', 'g'))"
_TICKERS = "coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all({0}, '\\$([A-Z]{{1,5}})\\b', 1))), '|'), '')"


@query(f"""WITH {DOCS}, t AS (SELECT *, {_CLEAN.format("coalesce(nullif(title, ''), full_text)")} AS ct FROM dc), x AS (SELECT *, ct || ' ' || full_text AS tx FROM t WHERE ct <> '')
SELECT {_stable_sql("concat_ws('|', 'context', id::VARCHAR, doc_date::VARCHAR)")} AS event_id, doc_date AS date, CASE WHEN source IN ('truth_social', 'twitter') THEN 'truth-social' WHEN regexp_matches(concat_ws(' ', doc_type, title, tx), '(?i){fixed.INTERVIEW_WORDS}') THEN 'interview'
WHEN regexp_matches(tx, '(?i){fixed.MARKET_WORDS}') THEN 'market' ELSE 'white-house' END AS category, left(ct, 180) AS title, {_CLEAN.format('full_text')} AS summary,
CASE source WHEN 'truth_social' THEN 'Truth Social' WHEN 'twitter' THEN 'Twitter/X' WHEN 'factbase' THEN 'Factbase transcript' ELSE CASE doc_type WHEN 'executive_order' THEN 'White House executive order' WHEN 'proclamation' THEN 'White House proclamation' ELSE 'Archive' END END AS source_name,
coalesce(url, '') AS source_url, {_TICKERS.format('tx')} AS tickers, {_label_sql(fixed.EVENT_SECTORS, 'lower(tx)')} AS sectors,
array_to_string(list_sort(list_distinct(list_concat(list_filter(string_split({_label_sql(fixed.EVENT_TAGS, 'lower(tx)')}, '|'), lambda v: v <> ''), [doc_type, source]))), '|') AS tags,
CASE WHEN regexp_matches(lower(tx), '{fixed.CONTEXT_IMPORTANT}') OR doc_type IN ('executive_order', 'proclamation', 'memorandum') THEN 3 ELSE 2 END AS importance FROM x""")
def document_events(spark: SparkSession, d: str) -> DataFrame:
    found = context.document_events(_documents(spark, d)).drop("end_date")
    return found.withColumns({c: F.array_join(c, "|") for c in ("tickers", "sectors", "tags")})


TOPICS = ["N2:POTUS", "R:ABC.N", "MCC:OVR", "other"]


@query(f"""WITH {DOCS}, s AS (SELECT id, CASE WHEN id % 2 = 0 THEN title ELSE '' END AS headline, lower(replace(title, ' ', '-')) AS slug, left(full_text, 20) AS fragment, full_text AS body, doc_date, {_pick_sql(TOPICS, 'id')} AS topic FROM dc),
t AS (SELECT *, {_CLEAN.format("coalesce(nullif(headline, ''), slug)")} AS ct FROM s), x AS (SELECT *, ct || ' ' || slug || ' ' || fragment || ' ' || body AS tx FROM t WHERE ct <> '' AND ({SAYS.format('headline')} OR {SAYS.format('slug')} OR {SAYS.format('fragment')} OR {SAYS.format('body')} OR topic = 'N2:POTUS'))
SELECT {_stable_sql("concat_ws('|', 'wire', id::VARCHAR, doc_date::VARCHAR)")} AS event_id, ct AS title, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN topic = 'R:ABC.N' THEN ['ABC'] ELSE [] END, regexp_extract_all(tx, '\\$([A-Z]{{1,5}})\\b', 1)))), '|') AS tickers,
array_to_string(list_sort(list_distinct(list_filter(list_concat(list_filter(string_split({_label_sql(fixed.EVENT_TAGS, 'lower(tx)')}, '|'), lambda v: v <> ''), [slug, CASE WHEN topic <> 'other' THEN topic ELSE '' END]), lambda v: v <> ''))), '|') AS tags,
CASE WHEN regexp_matches(lower(tx), '{fixed.CONTEXT_IMPORTANT}') OR regexp_matches(tx, '(?i){fixed.WIRE_IMPORTANT}') THEN 3 ELSE 2 END AS importance FROM x""")
def story_events(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d)
    stories = rows.select(F.col("id").alias("uri"), F.when(F.col("id") % 2 == 0, F.col("title")).otherwise("").alias("headline"), F.lower(F.regexp_replace("title", " ", "-")).alias("slug"), F.left("full_text", F.lit(20)).alias("fragment"), F.col("full_text").alias("body_text"), F.col("doc_date").alias("created"), "url", F.array(_pick(TOPICS, "id")).alias("topic_codes"))
    found = context.story_events(stories.where(context.wire_stories()))
    return found.select("event_id", "title", F.array_join("tickers", "|").alias("tickers"), F.array_join("tags", "|").alias("tags"), "importance")


_HTML = "trim(regexp_replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '&amp;', '&'), '&quot;', '\"'), '&#39;', ''''), '\\s+', ' ', 'g'))"


@query(f"""WITH {DOCS}, t AS (SELECT *, {_HTML.format('title')} AS ct, {_HTML.format('full_text')} AS cb FROM dc), x AS (SELECT *, ct || ' ' || cb AS tx FROM t WHERE ct <> '' AND url IS NOT NULL), y AS (SELECT *, CASE WHEN regexp_matches(tx, '{fixed.IMPORTANT_3}') THEN 3 WHEN regexp_matches(tx, '{fixed.IMPORTANT_2}') THEN 2 ELSE 1 END AS importance FROM x)
SELECT {_stable_sql("concat_ws('|', 'federal-register', id::VARCHAR, doc_date::VARCHAR)")} AS event_id, doc_date AS date, ct AS title, cb AS summary, url AS source_url, {_label_sql(fixed.EVENT_SECTORS, 'lower(tx)')} AS sectors, {_label_sql(fixed.EVENT_TAGS, 'lower(tx)')} AS tags, importance FROM y WHERE importance >= 2""")
def register_events(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).select("title", F.col("full_text").alias("abstract"), F.col("doc_date").alias("date"), "url", F.col("id").alias("number"))
    found = context.register_events(docs)
    return found.select("event_id", "date", "title", "summary", "source_url", F.array_join("sectors", "|").alias("sectors"), F.array_join("tags", "|").alias("tags"), "importance")


@query(f"""SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'own' || n_nationkey ELSE {_stable_sql("concat_ws('|', 'manual-event', '2024-01-01', n_name, n_nationkey::VARCHAR)")} END AS event_id, 'ABC|' || upper(n_name) AS tickers, 'Energy' AS sectors, CASE WHEN n_nationkey >= 3 THEN 3 WHEN n_nationkey <= 1 THEN 1 ELSE 2 END AS importance FROM nation WHERE upper(n_name) > 'ABC'
UNION ALL SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'own' || n_nationkey ELSE {_stable_sql("concat_ws('|', 'manual-event', '2024-01-01', n_name, n_nationkey::VARCHAR)")} END, upper(n_name) || '|ABC', 'Energy', CASE WHEN n_nationkey >= 3 THEN 3 WHEN n_nationkey <= 1 THEN 1 ELSE 2 END FROM nation WHERE upper(n_name) <= 'ABC'""")
def manual_events(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    rows = tables.table(spark, d, "nation").select(F.when(n % 2 == 0, F.concat(F.lit("own"), n)).otherwise("").alias("event_id"), F.lit("2024-01-01").cast("date").alias("date"), F.col("n_name").alias("title"), n.alias("position"), F.array(F.lit(" abc "), F.lower("n_name"), F.lit("abc"), F.lit("")).alias("tickers"), F.array(F.lit("Energy"), F.lit(" Energy")).alias("sectors"), F.lit(None).cast("array<string>").alias("tags"), n.alias("importance"))
    found = context.manual_events(rows)
    return found.select("event_id", F.array_join("tickers", "|").alias("tickers"), F.array_join("sectors", "|").alias("sectors"), "importance")


_MEETINGS = ", ".join(f"('{a}', '{b}', {str(p).lower()})" for a, b, p in fixed.RATE_MEETINGS)


@query(f"""WITH m AS (SELECT *, CASE WHEN p THEN 'FOMC meeting with projections' ELSE 'FOMC meeting' END AS title FROM (VALUES {_MEETINGS}) v(a, b, p))
SELECT {_stable_sql("concat_ws('|', 'fomc', a, title)")} AS event_id, a::DATE AS date, b::DATE AS end_date, title, CASE WHEN p THEN 'FOMC|SEP' ELSE 'FOMC|meeting' END AS tags, CASE WHEN p THEN 3 ELSE 2 END AS importance FROM m""")
def rate_meetings(spark: SparkSession, d: str) -> DataFrame:
    return context.rate_meetings(spark).drop("category").withColumn("tags", F.array_join("tags", "|"))


@query("""WITH e AS (SELECT event_id::VARCHAR AS event_id, ts::DATE AS date, event_type AS title, (user_id % 3 + 1)::INTEGER AS importance FROM events) SELECT * FROM e ORDER BY importance DESC, date DESC, title, event_id LIMIT 140""")
def gravest_events(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("date").alias("date"), F.col("event_type").alias("title"), (F.col("user_id") % 3 + 1).cast("int").alias("importance"))
    return context.two_phase(rows, 140)


# Holdings, index and citations


@query(f"WITH {GROUPS} SELECT security_key FROM e WHERE sector = 'ASIA' AND contains(lower(concat_ws(' ', description, ticker, sector, asset_type)), 'red')")
def holding_filter(spark: SparkSession, d: str) -> DataFrame:
    return holdings.filtered_holdings(q._held(spark, d), sector="ASIA", query=" RED ").select("security_key")


@query(f"WITH {INDEX} SELECT security_key, score FROM s WHERE upper(ticker) = 'BRAND#3' AND contains(lower(description), 'bolt')")
def entry_filter(spark: SparkSession, d: str) -> DataFrame:
    return holdings.filtered_entries(holdings.scored(q._held(spark, d)), ticker="brand#3", issuer="Bolt ").select("security_key", "score")


@query(f"""WITH {INDEX} SELECT security_key, CASE WHEN prev > 0 THEN greatest(0, clo - phi + slo) ELSE 0 END::DOUBLE AS previous_min, CASE WHEN prev > 0 THEN greatest(0, chi - plo + shi) ELSE 0 END::DOUBLE AS previous_max, prev AS previous_mid FROM s""")
def previous_ranges(spark: SparkSession, d: str) -> DataFrame:
    return holdings.scored(q._held(spark, d)).select("security_key", "previous_min", "previous_max", "previous_mid")


@query(f"WITH {TX} SELECT {_key_sql('description')} AS security_key, count(*) AS n, min(date) AS first_seen, max(date) AS last_seen, count(DISTINCT id) AS ids FROM tx GROUP BY 1")
def holding_transactions(spark: SparkSession, d: str) -> DataFrame:
    held = q._held(spark, d).select("security_key")
    rows = holdings.holding_transactions(tables.transactions(spark, d))
    return held.join(rows, "security_key").groupBy("security_key").agg(F.count("*").alias("n"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"), F.countDistinct("id").alias("ids"))


CITED = f"""{TX}, c AS (SELECT {_key_sql('description')} AS security_key, (l_orderkey, l_linenumber) AS o, CASE WHEN l_linenumber < 7 THEN 'u' || (p_partkey % 97) END AS url FROM tx),
f AS (SELECT *, CASE WHEN url IS NULL THEN NULL WHEN substr(url, 2)::INT < 40 THEN 'h' || substr(url, 2) WHEN substr(url, 2)::INT < 70 THEN 'f' || substr(url, 2) END AS source_id FROM c),
k AS (SELECT *, coalesce(source_id, url, 'Structured transaction row') AS cite FROM f), o1 AS (SELECT security_key, cite, min(o) AS o FROM k GROUP BY ALL)"""


@query(f"WITH {CITED} SELECT security_key, row_number() OVER (PARTITION BY security_key ORDER BY o)::INTEGER AS rank, cite FROM o1 QUALIFY row_number() OVER (PARTITION BY security_key ORDER BY o) <= 5")
def holding_citations(spark: SparkSession, d: str) -> DataFrame:
    tx = tables.transactions(spark, d)
    rows = tx.select(text.security_key(F.col("description")).alias("security_key"), "ord", F.when(F.col("ord.l_linenumber") < 7, F.concat(F.lit("u"), F.col("p_partkey") % 97)).alias("url"))
    some = lambda low, high, tag: spark.range(low, high).select(F.concat(F.lit("u"), "id").alias("url"), F.concat(F.lit(tag), "id").alias("source_id"), F.concat(F.lit("t"), "id").alias("title"), F.lit("official").alias("reliability"), F.col("id").alias("ord"))
    found = holdings.cited(rows, some(0, 40, "h"), some(20, 70, "f"))
    return found.select("security_key", "rank", F.coalesce("source_id", "url", "label").alias("cite"))


@query("SELECT s_name AS security_key, s_nationkey AS source_id, CASE WHEN s_nationkey < 10 THEN 'H' || s_nationkey ELSE 'F' || s_nationkey END AS label, CASE WHEN s_nationkey < 10 THEN 'archived_copy' ELSE 'official' END AS reliability FROM supplier WHERE s_nationkey < 20")
def holding_sources(spark: SparkSession, d: str) -> DataFrame:
    held = tables.table(spark, d, "supplier").select(F.col("s_name").alias("security_key"), F.col("s_nationkey").alias("source_filing_id"))
    n = tables.table(spark, d, "nation").select(F.col("n_nationkey").alias("source_id"), F.col("n_nationkey").alias("ord"))
    historical = n.where("source_id < 10").select("*", F.concat(F.lit("H"), "source_id").alias("title"), F.lit("archived_copy").alias("reliability"))
    filed = n.where("source_id < 20").select("*", F.concat(F.lit("F"), "source_id").alias("title"), F.lit("official").alias("reliability"))
    return holdings.holding_sources(held, historical, filed)


# Identities: parts stand for instruments

CLASSES = tables.CLASSES


IDENTITIES = f"""en AS (SELECT p_partkey AS ord, p_name || ' ' || p_brand AS display, {_pick_sql(CLASSES, 'p_size')} AS asset_type, p_type AS sector, CASE WHEN p_size % 10 = 0 THEN upper(left(md5(p_name), 9)) END AS cusip, p_name AS issuer, p_size / 10.0::DOUBLE AS coupon, p_brand, p_size,
{_pick_sql(['metadata_only', 'archived_copy', 'official'], 'p_size')} AS reliability, p_retailprice / 20 AS score, p_retailprice * 100 AS mid FROM part),
ky AS (SELECT *, asset_type = 'Equity' AS eq, coalesce('cusip|' || cusip, CASE WHEN asset_type = 'Equity' THEN 'ticker|' || p_brand END, concat_ws('|', 'parsed', asset_type, {q.NORMAL.format('issuer')}, coupon::VARCHAR, '2035-11-15', {_key_sql('display')})) AS key FROM en),
st AS (SELECT *, CASE WHEN cusip IS NOT NULL THEN 3 WHEN NOT eq THEN 2 WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS sr FROM ky WHERE NOT eq OR cusip IS NOT NULL OR p_size % 3 = 0),
rv AS (SELECT *, CASE WHEN p_size = 50 THEN 2 WHEN sr = 2 THEN 1 ELSE 0 END AS rr, CASE reliability WHEN 'official' THEN 2 WHEN 'archived_copy' THEN 1 ELSE 0 END AS lr FROM st),
mg AS (SELECT key, arg_max(display, (score, -ord)) AS display, max(sr) AS sr, max(rr) AS rr, max(lr) AS lr, max(score) AS score, sum(mid) AS current_mid, sum(p_size)::BIGINT AS transaction_count, count(*) AS entries FROM rv GROUP BY key),
idn AS (SELECT {_stable_sql("'identity|' || key")} AS identity_id, key, display, ['not_applicable', 'issuer_context_only', 'needs_identifier', 'exact'][sr + 1] AS status, ['verified', 'needs_review', 'rejected'][rr + 1] AS review, ['metadata_only', 'archived_copy', 'official'][lr + 1] AS reliability, score, round(current_mid, 4) AS current_mid,
transaction_count, entries, floor((CASE WHEN sr = 2 THEN 45 WHEN rr = 1 THEN 25 ELSE 0 END + CASE lr WHEN 0 THEN 15 WHEN 1 THEN 8 ELSE 0 END + ln(1 + greatest(0, current_mid)) * 4 + ln(1 + transaction_count) * 8 + score) * 10 + 0.5) / 10 AS priority FROM mg)"""


@query(f"WITH {IDENTITIES} SELECT * FROM idn")
def instrument_identities(spark: SparkSession, d: str) -> DataFrame:
    found = resolution.identities(tables.instrument_entries(spark, d))
    return found.select("identity_id", "key", "display", "status", "review", "reliability", "score", F.round("current_mid", 4).alias("current_mid"), "transaction_count", "entries", "priority")


@query(f"WITH {IDENTITIES} SELECT key, priority FROM idn WHERE status = 'needs_identifier' OR review = 'needs_review' ORDER BY priority DESC, score DESC, current_mid DESC, display, key LIMIT 120")
def identity_review(spark: SparkSession, d: str) -> DataFrame:
    found = resolution.review_items(cut(resolution.identities(tables.instrument_entries(spark, d))))
    return found.orderBy(F.col("priority").desc(), F.col("score").desc(), F.round("current_mid", 4).desc(), "display", "key").limit(120).select("key", "priority")


@query(f"WITH {IDENTITIES} SELECT idn.key FROM idn WHERE reliability = 'official' AND contains(lower(display), 'gear') AND contains(lower(concat_ws(' ', display, status)), 'needs_identifier')")
def identity_filter(spark: SparkSession, d: str) -> DataFrame:
    return resolution.filtered_identities(resolution.identities(tables.instrument_entries(spark, d)), reliability="official", issuer="Gear", query="needs_identifier").select("key")


@query(f"""WITH {q.REVIEW}, {IDENTITIES}, i2 AS (SELECT *, row_number() OVER (ORDER BY priority DESC, score DESC, current_mid DESC, display, key) AS o FROM idn),
r5 AS (SELECT 5, row_number() OVER (ORDER BY o), CASE WHEN priority >= 130 THEN 'high' WHEN priority >= 95 THEN 'medium' ELSE 'low' END, 'identifier', identity_id, display FROM i2 WHERE o <= 200 AND (status = 'needs_identifier' OR review = 'needs_review'))
SELECT * FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4 UNION ALL SELECT * FROM r5) ORDER BY source, seq LIMIT 500""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark, d).review()


@query(f"""{q.ALL_CONFLICTS} SELECT indicator_id, severity, value FROM (SELECT * FROM pc UNION ALL SELECT * FROM fc) ORDER BY CASE severity WHEN 'high' THEN 3 ELSE 2 END DESC, evidence DESC, indicator_id LIMIT 100""")
def engine_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """The entry point on its rate and policy rules: its events name no sector here."""
    rows = tables.table(spark, d, "events").where("event_type = 'error'").select("event_id", F.col("ts").cast("date").alias("date"), F.lit("fed").alias("category"), F.lit("").alias("title"), F.lit("").alias("summary"))
    found = Engine(spark, d).conflicts(rows, policies=q._config(spark), sensitive=F.col("sector") == "EUROPE")
    return found["indicators"].select("indicator_id", "severity", "value")


# Reference lists


@query("""SELECT regexp_replace(upper(coalesce(a.t, b.t)), '[^A-Z0-9]', '', 'g') AS ticker_key, coalesce(a.t, b.t) AS ticker, coalesce(a.n, b.n) AS issuer_name, a.cik, coalesce(b.etf, false) AS is_etf, concat_ws('|', CASE WHEN a.t IS NOT NULL THEN 'companies' END, CASE WHEN b.t IS NOT NULL THEN 'directory' END) AS sources
FROM (SELECT 'T.' || s_suppkey AS t, s_name AS n, s_suppkey AS cik FROM supplier) a FULL JOIN (SELECT 'T-' || (c_custkey * 3) AS t, c_name AS n, c_nationkey % 2 = 0 AS etf FROM customer) b ON regexp_replace(a.t, '[^A-Z0-9]', '', 'g') = regexp_replace(b.t, '[^A-Z0-9]', '', 'g')""")
def reference_merge(spark: SparkSession, d: str) -> DataFrame:
    companies = tables.table(spark, d, "supplier").select(F.concat(F.lit("T."), "s_suppkey").alias("ticker"), F.col("s_name").alias("issuer_name"), F.col("s_suppkey").alias("cik"), F.lit("N").alias("exchange"))
    listed = tables.table(spark, d, "customer").select(F.concat(F.lit("T-"), F.col("c_custkey") * 3).alias("ticker"), F.col("c_name").alias("issuer_name"), (F.col("c_nationkey") % 2 == 0).alias("is_etf"), F.lit(False).alias("is_test"))
    found = resolution.reference_merge(companies, listed)
    return found.select("ticker_key", "ticker", "issuer_name", "cik", "is_etf", F.array_join("sources", "|").alias("sources"))


@query("SELECT upper(trim(' s' || s_suppkey)) AS ticker, s_name AS issuer_name FROM supplier WHERE s_nationkey <> 3")
def symbol_directory(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("s_nationkey")
    line = F.concat_ws("|", F.concat(F.lit(" s"), "s_suppkey"), F.when(n == 3, " ").otherwise(F.col("s_name")), F.lit("Q"), F.lit("N"))
    head = spark.createDataFrame([("Symbol|Security Name|Market|Test",), ("File Creation Time: 1|x",), ("no bars",)], "value string")
    return readers.symbol_directory(tables.table(spark, d, "supplier").select(line.alias("value")).unionByName(head)).select("ticker", "issuer_name")


@query("SELECT s_suppkey AS cik, s_name AS issuer_name, 'S' || s_suppkey AS ticker, 'N' AS exchange FROM supplier WHERE s_nationkey % 4 <> 0 AND s_nationkey % 5 <> 0")
def company_tickers(spark: SparkSession, d: str) -> DataFrame:
    n, key = F.col("s_nationkey"), F.col("s_suppkey").cast("string")
    cells = F.array(key, F.col("s_name"), F.when(n % 5 == 0, " ").otherwise(F.concat(F.lit(" s"), key)), F.lit("N"))
    rows = tables.table(spark, d, "supplier").select(F.when(n % 4 == 0, F.slice(cells, 1, 3)).otherwise(cells).alias("row"), n.alias("nation"), (F.col("s_suppkey") / DOCUMENT_ROWS).cast("long").alias("file"))
    return readers.company_tickers(rows.groupBy("nation", "file").agg(F.collect_list("row").alias("data")))  # DOCUMENT_ROWS rows at most


@query("""WITH n AS (SELECT event_type AS ticker, max(ts) AS newest FROM events GROUP BY 1), q AS (SELECT event_type AS ticker, arg_max(value, (ts, event_id)) AS price FROM events JOIN (SELECT max(ts) AS now FROM events) ON ts >= now - INTERVAL 5 MINUTE GROUP BY 1) SELECT n.ticker, price FROM n LEFT JOIN q USING (ticker)""")
def fresh_quotes(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table(spark, d, "events").select(F.col("event_type").alias("ticker"), F.col("ts").alias("fetched_at"), F.col("value").alias("price"), "event_id")
    now = rows.agg(F.max("fetched_at").alias("now"))
    return rows.select("ticker").distinct().join(sectors.fresh_quotes(rows.crossJoin(F.broadcast(now)), F.col("now")), "ticker", "left").select("ticker", "price")


# Stored tables


@query("SELECT n_nationkey, n_name, 2 AS copies FROM nation")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Rows appended twice as JSON lines and read back with their schema."""
    path, rows = scratch(spark, "json-lines"), tables.table(spark, d, "nation").select("n_nationkey", "n_name")
    for _ in range(2):
        sinks.append_json(rows, path)
    schema = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType())])
    return spark.read.schema(schema).json(path).groupBy("n_nationkey", "n_name").agg(F.count("*").cast("int").alias("copies"))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT NULL, 'missing: 0 rows'")
def json_or_default(spark: SparkSession, d: str) -> DataFrame:
    path, rows = scratch(spark, "json"), tables.table(spark, d, "region").select("r_regionkey", "r_name")
    rows.coalesce(1).write.option("ignoreNullFields", False).json(path)
    schema = T.StructType([T.StructField("r_regionkey", T.IntegerType()), T.StructField("r_name", T.StringType())])
    missing = readers.json_or_empty(spark, scratch(spark, "not-there"), schema).agg(F.concat(F.lit("missing: "), F.count("*"), F.lit(" rows")).alias("r_name"))
    return spark.read.schema(schema).json(path).unionByName(missing.select(F.lit(None).cast("int").alias("r_regionkey"), "r_name"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS origin, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS value FROM customer")
def upserted_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("old").alias("origin"), F.col("c_acctbal").alias("value"))
    return sinks.upserted(rows, rows.where("id % 3 = 0").withColumns({"origin": F.lit("new"), "value": F.col("value") + 1}), ["id"])


@query(f"WITH {TX} SELECT id, array_to_string(flags, '; ') AS flags, label AS amount_label, lo AS amount_min, hi AS amount_max, mid AS amount_midpoint FROM tx")
def sheet_rows(spark: SparkSession, d: str) -> DataFrame:
    """A sheet written as CSV and read back."""
    path = scratch(spark, "sheets")
    sinks.write_sheets({"transactions": tables.transactions(spark, d).select("id", "flags", "amount")}, path)
    found = spark.read.option("header", True).csv(f"{path}/transactions")
    return found.select("id", F.coalesce("flags", F.lit("")).alias("flags"), "amount_label", *(F.col(c).cast("double").alias(c) for c in ("amount_min", "amount_max", "amount_midpoint")))


# Pages


@query(f"WITH {TX} SELECT id, date FROM tx WHERE year(date) = 1997 ORDER BY date DESC, id LIMIT 1000")
def page_transactions(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark, d).page("transactions", {"year": " 1997 "})["transactions"].select("id", "date")


@query(f"WITH {INDEX} SELECT security_key, score FROM s ORDER BY score DESC, cmid DESC, icu_sort_key(description, 'en'), description, security_key LIMIT 600")
def page_index(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark, d).page("index", {})["index"].select("security_key", "score")


@query(f"WITH {INDEX} SELECT security_key, score FROM s ORDER BY score DESC, cmid DESC, icu_sort_key(description, 'en'), description, security_key LIMIT 80")
def bootstrap_index(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark, d).bootstrap()["index"].select("security_key", "score")


@query(f"{q.SECTORS} SELECT * FROM t")
def page_sectors(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark, d).page("sectors", {"sector": "All"})["sectors"]


@query(f"WITH {INDEX} SELECT {_stable_sql(chr(39) + 'entry|' + chr(39) + ' || security_key')} AS entry_id, score FROM s ORDER BY score DESC, cmid DESC, icu_sort_key(description, 'en'), description, security_key LIMIT 12")
def fact_entries(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark, d).facts({})["entries"].select("entry_id", "score")


@query(f"WITH {TX} SELECT year(date)::INTEGER AS year, count(*) AS n FROM tx GROUP BY 1 ORDER BY 1 DESC LIMIT 12")
def fact_years(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark, d).facts({})["years"]


@query(f"WITH {TX} SELECT sector, count(*) AS n FROM tx WHERE year(date) = 1998 AND late GROUP BY 1")
def request_parameters(spark: SparkSession, d: str) -> DataFrame:
    f = filters.Filters.from_params({"year": " 1998 ", "lateOnly": "true", "confidence": "none", "sector": "All", "query": "  "})
    return filters.filtered(tables.transactions(spark, d), f).groupBy("sector").agg(F.count("*").alias("n"))


# Orders and caps of what is shown


@query(f"WITH b AS ({SQL['equity_stocks']}) SELECT stock, purchase_midpoint FROM b ORDER BY purchase_midpoint DESC, transaction_count DESC, stock LIMIT 160")
def stock_order(spark: SparkSession, d: str) -> DataFrame:
    return sectors.stock_order(q.equity_stocks(spark, d)).select("stock", "purchase_midpoint")


@query(f"WITH {TX} SELECT coalesce(sum(mid) FILTER (type = 'Purchase'), 0) AS purchases, coalesce(sum(mid) FILTER (type = 'Sale'), 0) AS sales, count(*) FILTER (type = 'Purchase') AS purchase_count, count(*) FILTER (type = 'Sale') AS sale_count FROM tx WHERE late")
def page_totals(spark: SparkSession, d: str) -> DataFrame:
    return sectors.page_totals(tables.transactions(spark, d).where("late"))


@query(f"WITH w AS ({SQL['event_windows']}) SELECT w.event_id, window_days, transaction_count, net_midpoint, ts::DATE AS date, event_type AS category FROM w LEFT JOIN events USING (event_id)")
def window_export(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table(spark, d, "events").select("event_id", F.col("ts").cast("date").alias("date"), F.col("event_type").alias("category"))
    return q.event_windows(spark, d).select("event_id", "window_days", "transaction_count", "net_midpoint").join(rows, "event_id", "left")


@query(f"WITH {SOURCES} SELECT source_id, url FROM src ORDER BY url DESC NULLS LAST, source_id")
def sources_with_links_first(spark: SparkSession, d: str) -> DataFrame:
    return _sources(spark, d).orderBy(F.col("url").desc_nulls_last(), "source_id").select("source_id", "url")


@query(f"WITH {TX} SELECT id FROM tx ORDER BY strftime(date, '%Y-%m'), mid DESC, description, id LIMIT 250")
def marker_order(spark: SparkSession, d: str) -> DataFrame:
    from rangeledger.operators import timeline

    rows = tables.transactions(spark, d)
    return rows.orderBy(timeline.month("date"), F.col("amount.midpoint").desc(), "description", "id").limit(250).select("id")


@query("SELECT p_partkey, array_to_string([upper(left(w, 1)) || substr(w, 2) FOR w IN string_split(lower(p_name), ' ')], ' ') || ' LLC' AS titled FROM part")
def title_cases(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "part").select("p_partkey", text.title_case(F.concat(F.lit(" "), F.upper("p_name"), F.lit("  llc "))).alias("titled"))


@query("SELECT CASE s_suppkey % 3 WHEN 0 THEN 'Purchase' WHEN 1 THEN 'Sale' ELSE 'Exchange' END AS type, count(*) AS n FROM supplier GROUP BY 1")
def line_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return periodic_line_items(spark, d).groupBy("type").agg(F.count("*").alias("n"))


# Disclosure documents: a nation's suppliers and customers as lines of one document or of several of some hundred rows


def _document(nation: str, key: str) -> Column:
    """Number of the document that a nation's row stands in."""
    return F.col(nation) * 1_000_000 + (F.col(key) / DOCUMENT_ROWS).cast("long")


_DOC_S = "s_nationkey * 1000000 + s_suppkey // 200"


def _nation_documents(rows: DataFrame, nation: str, key: str, line: Column, head: str, tail: str = "", whole: bool = False) -> DataFrame:
    """Documents of each nation, of at most ``DOCUMENT_ROWS`` rows, or one ``whole`` document of all its rows: a line for each row, by key."""
    doc = F.col(nation) if whole else _document(nation, key)
    lines = rows.withColumn("line", line).groupBy(doc.alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(key, "line"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return lines.select("doc_id", F.concat(F.lit(head), body, F.lit(tail)).alias("text"))


def _supplier_label() -> Column:
    k = F.col("s_suppkey") % 4
    return F.when(k == 0, "$1,001 - $15,000").when(k == 1, "$15,001 - $50,000").when(k == 2, "Over $50,000,000").otherwise("None (or less than $1,001)")


def _asset_holdings(spark: SparkSession, d: str) -> DataFrame:
    from rangeledger.operators import documents

    key = F.col("s_suppkey")
    income = F.when(key % 3 == 0, "Dividends $201 - $1,000").when(key % 3 == 1, "None (or less than $201)").otherwise("Rent")
    line = F.concat(key + 1, F.lit(". "), F.col("s_name"), F.lit(" Acct."), F.when(key % 2 == 0, "\nLocation: a place").otherwise(""), F.lit(" N/A "), _supplier_label(), F.lit(" "), income, F.lit("\nPage Number"))
    docs = _nation_documents(tables.table(spark, d, "supplier"), "s_nationkey", "s_suppkey", line, "Some cover\nPart 6: Other Assets and Income\n# Description\n", "\nPart 7: Transactions\n1. not an asset $1,001 - $15,000")
    return documents.asset_holdings(documents.asset_rows(documents.lines(docs)))


@query(f"""SELECT {_DOC_S} AS source_id, (s_suppkey + 1)::VARCHAR AS number, s_name || ' Acct' AS description, CASE s_suppkey % 4 WHEN 0 THEN 8000.5 WHEN 1 THEN 32500.5 WHEN 2 THEN 50000001 ELSE 0 END::DOUBLE AS value, CASE s_suppkey % 3 WHEN 0 THEN 'Dividends' WHEN 2 THEN 'Rent' END AS income_type,
CASE s_suppkey % 3 WHEN 0 THEN 600.5 ELSE 0 END::DOUBLE AS income, CASE WHEN s_suppkey % 4 = 3 THEN 4 ELSE 3 END AS flags FROM supplier""")
def asset_holdings(spark: SparkSession, d: str) -> DataFrame:
    return _asset_holdings(spark, d).select("source_id", "number", "description", F.col("value.midpoint").alias("value"), "income_type", F.col("income.midpoint").alias("income"), F.size("flags").alias("flags"))


@query("""SELECT c_nationkey AS doc_id, c_name AS creditor, CASE WHEN c_custkey % 2 = 0 THEN 'Mortgage on a house' ELSE 'credit card' END AS type, CASE WHEN c_custkey % 3 = 0 THEN 8000.5 ELSE 75000.5 END::DOUBLE AS amount, CASE WHEN c_custkey % 4 <> 0 THEN (1990 + c_custkey % 30)::VARCHAR END AS year,
CASE WHEN c_custkey % 5 <> 0 THEN '4.5%' END AS rate, 'On demand ' || c_custkey AS term FROM customer""")
def liability_rows(spark: SparkSession, d: str) -> DataFrame:
    from rangeledger.operators import documents, liabilities

    key = F.col("c_custkey")
    body = F.when(key % 2 == 0, F.concat(F.col("c_name"), F.lit("\tMortgage on\ta house"))).otherwise(F.concat(F.col("c_name"), F.lit(" credit card")))
    line = F.concat(
        key + 1, F.lit(". "), body, F.when(key % 3 == 0, " $1,001 - $15,000").otherwise(" $50,001 - $100,000"), F.when(key % 4 != 0, F.concat(F.lit(" "), key % 30 + 1990)).otherwise(" N/A"), F.when(key % 5 != 0, "\n4.5%").otherwise("\nN/A"), F.lit(" On demand "), key, F.lit("\nPage 7")
    )
    docs = _nation_documents(tables.table(spark, d, "customer"), "c_nationkey", "c_custkey", line, "Part 8: Liabilities\n# Creditor\n", "\nPart 9: Gifts\n1. A gift $1,001 - $15,000 1999 N/A none", whole=True)
    return liabilities.liabilities(documents.lines(docs)).select("doc_id", "creditor", "type", F.col("amount.midpoint").alias("amount"), "year", "rate", "term")


@query("""SELECT s_nationkey AS doc_id, s_name AS creditor, CASE WHEN s_suppkey % 2 = 0 THEN 'Seven Springs loan' ELSE 'mortgage' END AS type, CASE s_suppkey % 4 WHEN 0 THEN 8000.5 WHEN 1 THEN 32500.5 WHEN 2 THEN 50000001 ELSE 0 END::DOUBLE AS amount, CASE WHEN s_suppkey % 3 <> 0 THEN (2000 + s_suppkey % 20)::VARCHAR END AS year,
'Prime + ' || s_suppkey AS rate, CASE WHEN s_suppkey % 2 = 1 THEN 'Matures in ' || s_suppkey END AS term FROM supplier""")
def liability_columns(spark: SparkSession, d: str) -> DataFrame:
    from rangeledger.operators import documents, liabilities

    key = F.col("s_suppkey")
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) % 90
    rows = tables.table(spark, d, "supplier").withColumn("at", place)
    amount = F.concat(F.col("at"), F.when(key % 5 == 0, ".\n").otherwise(". "), _supplier_label(), F.when(key % 3 != 0, F.concat(F.lit(" "), key % 20 + 2000)).otherwise(" N/A"), F.lit(" Prime +\n"), key, F.when(key % 2 == 1, F.concat(F.lit(" Matures in "), key)).otherwise(""))
    name = F.concat(F.col("s_name"), F.when(key % 2 == 0, "\nSeven Springs loan").otherwise(" mortgage"))
    left = _nation_documents(rows, "s_nationkey", "s_suppkey", amount, "# Amount Year Incurred Rate Term\n", "\nPart 8: Liabilities\nCreditor Name Type\n", whole=True)
    right = _nation_documents(rows, "s_nationkey", "s_suppkey", name, "", "\n* a note\nbehind it loan", whole=True).withColumnRenamed("text", "names")
    docs = left.join(right, "doc_id").select("doc_id", F.concat("text", "names").alias("text"))
    return liabilities.columnar_rows(documents.lines(docs)).select("doc_id", "creditor", "type", F.col("amount.midpoint").alias("amount"), "year", "rate", "term")


@query(f"""SELECT {_DOC_S} AS doc_id, s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' -mortgage' ELSE '' END AS creditor, CASE WHEN s_suppkey % 2 = 0 THEN 'Unspecified liability' ELSE 'litigation' END AS type, CASE s_suppkey % 4 WHEN 0 THEN 8000.5 WHEN 1 THEN 32500.5 WHEN 2 THEN 50000001 ELSE 0 END::DOUBLE AS amount,
CASE WHEN s_suppkey % 3 <> 0 THEN (2000 + s_suppkey % 20)::VARCHAR END AS year, CASE WHEN s_suppkey % 3 <> 0 THEN 0.68 ELSE 0.62 END::DOUBLE AS confidence FROM supplier""")
def liability_lines(spark: SparkSession, d: str) -> DataFrame:
    from rangeledger.operators import documents, liabilities

    key = F.col("s_suppkey")
    line = F.concat(F.col("s_name"), F.when(key % 2 == 0, " - ").otherwise(" litigation"), F.lit(" "), _supplier_label(), F.when(key % 3 != 0, F.concat(F.lit(" "), key % 20 + 2000)).otherwise(" N/A"), F.when(key % 2 == 0, "\nmortgage").otherwise(""), F.lit("\nRate"))
    docs = _nation_documents(tables.table(spark, d, "supplier"), "s_nationkey", "s_suppkey", line, "Part 8: Liabilities\n", "\n* note\nX litigation $1,001 - $15,000 2001")
    return liabilities.liabilities(documents.lines(docs)).where("layout = 'inline'").select("doc_id", "creditor", "type", F.col("amount.midpoint").alias("amount"), "year", "confidence")


@query("SELECT s_nationkey AS doc_id, DATE '2020-01-01' + (s_suppkey % 300)::INT AS date, CASE s_suppkey % 3 WHEN 0 THEN 'Purchase' WHEN 1 THEN 'Sale' ELSE 'Exchange' END AS type, s_name AS description, '$1,001 - $15,000' AS amount FROM supplier")
def periodic_line_items(spark: SparkSession, d: str) -> DataFrame:
    from rangeledger.operators import documents

    key = F.col("s_suppkey")
    line = F.concat_ws(" ", F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (key % 300).cast("int")), "M/d/yyyy"), F.when(key % 3 == 0, "P").when(key % 3 == 1, "S").otherwise("E"), F.col("s_name"), F.lit("$1,001 - $15,000"))
    docs = _nation_documents(tables.table(spark, d, "supplier"), "s_nationkey", "s_suppkey", line, "Transactions\n", "\n1/1/2020 X other $1,001 - $15,000", whole=True)
    return documents.line_items(documents.lines(docs)).drop("n")


@query("SELECT s_suppkey, 'Over $50,000,000 N/A (or) $' || s_suppkey % 7 + 1 || ',500,000' AS line FROM supplier")
def corrected_lines(spark: SparkSession, d: str) -> DataFrame:
    from rangeledger.operators import documents

    n = (F.col("s_suppkey") % 7 + 1).cast("string")
    raw = F.concat(F.lit("  Orer $50,000,000\tNIA {or) $ "), n, F.lit("500, 000"))
    return tables.table(spark, d, "supplier").select("s_suppkey", documents.corrected(raw).alias("line"))


# Scalar functions


@query("""SELECT o_orderkey, CASE WHEN day(o_orderdate) > day(last_day(o_orderdate + INTERVAL 1 MONTH)) THEN last_day(o_orderdate + INTERVAL 1 MONTH) ELSE (o_orderdate + INTERVAL 1 MONTH)::DATE END AS next_month, len(generate_series(date_trunc('month', o_orderdate), date_trunc('month', o_orderdate + INTERVAL 100 DAY), INTERVAL 1 MONTH))::INTEGER AS months,
(day(o_orderdate) - 1) / (day(last_day(o_orderdate)) - 1) AS fraction, greatest(o_orderdate::DATE, DATE '1997-01-01') AS clamped FROM orders""")
def calendar_marks(spark: SparkSession, d: str) -> DataFrame:
    date = F.col("o_orderdate").cast("date")
    return tables.table(spark, d, "orders").select(
        "o_orderkey", calendar.added_months(date, 1).alias("next_month"), F.size(calendar.months_between(date, F.date_add(date, 100))).alias("months"), calendar.month_fraction(date).alias("fraction"),
        calendar.clamped(date, F.lit("1997-01-01").cast("date"), F.lit("2100-01-01").cast("date")).alias("clamped"),
    )


def _jitter_sql(of: str) -> str:
    codes = f"list_transform(string_split({of}, ''), lambda c: ascii(c)::UBIGINT)"
    return f"((list_reduce(list_prepend(0::UBIGINT, {codes}), lambda h, c: (h * 31 + c) % 4294967296) % 10000)::DOUBLE / 10000 - 0.5) * 2 * 0.09"


@query(f"SELECT c_custkey, {_jitter_sql('c_name')} AS shift, (c_custkey % 100) % greatest(1, ceil(100 / 12.0))::INT = 0 OR c_custkey % 100 = 99 AS ticked FROM customer")
def jitter_and_ticks(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_custkey") % 100
    return tables.table(spark, d, "customer").select("c_custkey", calendar.signed_jitter(F.col("c_name"), F.lit(0.09)).alias("shift"), calendar.every_kth(n, F.lit(100), F.lit(12)).alias("ticked"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "part").select("p_partkey", text.slug(F.concat_ws(" & ", "p_name", "p_brand")).alias("slug"))


_EXCHANGES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.EXCHANGES.items())


@query(f"SELECT c_custkey, CASE upper(substr(c_mktsegment, 1, 1)) {_EXCHANGES} ELSE upper(substr(c_mktsegment, 1, 1)) END AS exchange, regexp_replace(upper(trim(' ' || c_name)), '[^A-Z0-9]', '', 'g') AS ticker_key FROM customer")
def exchange_names(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "customer").select("c_custkey", enrichment.exchange_name(F.upper(F.left("c_mktsegment", F.lit(1)))).alias("exchange"), resolution.ticker_key(F.concat(F.lit(" "), "c_name")).alias("ticker_key"))


INDUSTRIES = ["State Commercial Banks", "Crude Petroleum", "Retail-Eating Places", "Semiconductors", "Plain work", "Steel works"]
_SIC = "CASE " + " ".join(f"WHEN regexp_matches(n, '\\b({w})\\b') THEN '{s}'" for s, w in fixed.INDUSTRY_WORDS) + " " + " ".join(f"WHEN code BETWEEN {a} AND {b} THEN '{s}'" for a, b, s in fixed.INDUSTRY_CODES) + " END"


@query(f"WITH r AS (SELECT p_partkey, (p_partkey * 37 % 9000)::INT AS code, {q.NORMAL.format(_pick_sql(INDUSTRIES, 'p_partkey'))} AS n FROM part) SELECT p_partkey, {_SIC} AS sector FROM r")
def industry_sectors(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "part").select("p_partkey", instruments.industry_sector((F.col("p_partkey") * 37 % 9000).cast("string"), _pick(INDUSTRIES, "p_partkey")).alias("sector"))


@query("""SELECT p_partkey, CASE WHEN p_size / 50.0 >= 0.85 THEN 'High' WHEN p_size / 50.0 >= 0.7 THEN 'Medium' ELSE 'Low' END AS label, coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END, ''), p_name) AS shown FROM part""")
def labels_and_names(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return tables.table(spark, d, "part").select("p_partkey", text.confidence_label(size / 50).alias("label"), resolution.display_name(F.when(size % 2 == 0, "").otherwise(F.col("p_brand")), F.lit(None).cast("string"), F.col("p_name")).alias("shown"))


@query("""WITH v AS (SELECT o_orderkey, round(o_totalprice) * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE -1 END AS v FROM orders), w AS (SELECT *, abs(v) AS a FROM v),
u AS (SELECT *, CASE WHEN a >= 999950 THEN floor(a / 1000000 * 10 + 0.5) / 10 WHEN a >= 999.95 THEN floor(a / 1000 * 10 + 0.5) / 10 ELSE floor(a * 10 + 0.5) / 10 END AS x, CASE WHEN a >= 999950 THEN 'M' WHEN a >= 999.95 THEN 'K' ELSE '' END AS s FROM w)
SELECT o_orderkey, CASE WHEN v < 0 THEN '-$' ELSE '$' END || regexp_replace(printf('%.1f', x), '\\.0$', '') || s AS shown FROM u""")
def money_formats(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    value = F.round("o_totalprice") * F.when(key % 3 == 0, 1).when(key % 3 == 1, 1000).otherwise(-1)
    return tables.table(spark, d, "orders").select("o_orderkey", money.compact_money(value).alias("shown"))


@query(r"""SELECT page_id, regexp_matches(lower(url), 'openfigi\.com/search|emma\.msrb\.org/search|api\.openfigi\.com/v3/mapping/(id_|ticker|cusip|isin|bbg)') AS generic, nullif(regexp_extract(html, 'href=["'']([^"'']+)["'']', 1), '') AS link
FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://www.OpenFIGI.com/search?q=' || page_id ELSE url END AS url, html FROM pages)""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://www.OpenFIGI.com/search?q="), "page_id")).otherwise(F.col("url"))
    return tables.table(spark, d, "pages").select("page_id", instruments.is_generic_url(url).alias("generic"), ingest.link_of(F.col("html")).alias("link"))


@query(f"{q.SECTORS}, f AS (SELECT *, row_number() OVER (ORDER BY abs(net_midpoint) DESC, sector) AS o FROM t WHERE asset_type = 'All') SELECT sector, net_midpoint, net_midpoint > 0 AS bought FROM f WHERE o <= 3 AND net_midpoint <> 0")
def strongest_sectors(spark: SparkSession, d: str) -> DataFrame:
    return sectors.strongest(sectors.sector_summary(tables.transactions(spark, d)), first=3, n=4)


@query(f"WITH {TX}, m AS (SELECT sector, sum(mid) AS v, count(*) AS n FROM tx GROUP BY 1) SELECT sector, v / max(v) OVER () AS share, log10(v + 1) AS height, sqrt(n) AS width FROM m")
def display_ratios(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.transactions(spark, d).groupBy("sector").agg(F.sum("amount.midpoint").alias("value"), F.count("*").alias("activity"))
    return sectors.display_ratios(rows, "value", "activity").select("sector", "share", "height", "width")


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b\\d{4}-\\d{2}-\\d{2}\\b'))), '|') AS dates, len(regexp_extract_all(text, 'the')) AS mentions FROM documents")
def text_profiles(spark: SparkSession, d: str) -> DataFrame:
    from rangeledger.operators import documents

    return documents.profile(tables.table(spark, d, "documents"), "the").withColumn("dates", F.array_join("dates", "|"))


@query("SELECT n_nationkey AS k, 'seed' AS origin FROM nation WHERE n_nationkey < 5 UNION ALL SELECT DISTINCT c_nationkey, 'previous' FROM customer WHERE c_nationkey >= 5")
def seeded_registry(spark: SparkSession, d: str) -> DataFrame:
    """Curated rows before those of the previous cache."""
    seeds = tables.table(spark, d, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("k"), F.lit("seed").alias("origin"))
    return priority_union(["k"], seeds, tables.table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("previous").alias("origin")).distinct())
