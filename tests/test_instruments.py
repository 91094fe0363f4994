"""Bond descriptions, resolution, identifier matching and identities."""

from pyspark.sql import functions as F

from rangeledger.functions import instruments
from rangeledger.operators import documents, resolution


def parse(spark, description, kind):
    df = spark.createDataFrame([(description, kind)], "d string, k string")
    return df.select(instruments.parsed(F.col("d"), F.col("k")).alias("p")).first()["p"]


def test_corporate_bond(spark):
    p = parse(spark, "FIRST HORIZON BK MEMPHIS TENN DUE 05/01/2030 05.750% CALLABLE 02/01/2030 AT 100.000 YIELD 5.55% TO MATURITY", "Corporate Bond")
    assert (p["coupon"], p["maturity"], p["call_date"], p["call_price"]) == (5.75, "2030-05-01", "2030-02-01", 100.0)
    assert p["issuer"] == "FIRST HORIZON BANK" and p["status"] == "needs_identifier" and p["review"] == "needs_review"
    assert p["yield_to_maturity"] == 5.55 and p["callable"] and abs(p["confidence"] - 0.88) < 1e-9


def test_municipal_bonds(spark):
    p = parse(spark, "WASHINGTON ST HEALT 5% DUE 09/01/35", "Municipal Bond")
    assert (p["issuer"], p["state"], p["category"]) == ("WASHINGTON STATE HEALTH", "Washington", "Health care / hospital")
    assert (p["coupon"], p["maturity"]) == (5.0, "2035-09-01")
    known = parse(spark, "METROPOLITAN TRANSN 5% DUE 11/15/35", "Municipal Bond")
    assert (known["cusip"], known["isin"], known["figi"], known["review"]) == ("59261A6A0", "US59261A6A01", "BBG01XBJ54B6", "verified")


def test_equities_have_no_instrument(spark):
    p = parse(spark, "CLOUDFLARE INC CLASS A", "Equity")
    assert p["kind"] is None and p["issuer"] is None and p["status"] == "not_applicable" and p["confidence"] == 0


def test_dates_and_urls(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert [one(instruments.us_date(F.lit(d))) for d in ("2/31/70", "1/2/69", "13/1/20", "1/2/2031")] == ["1970-02-31", "2069-01-02", None, "2031-01-02"]
    assert [one(instruments.is_generic_url(F.lit(u))) for u in ("https://www.openfigi.com/search?q=x", "https://emma.msrb.org/Search", "https://emma.msrb.org/Security/Details/1", None)] == [True, True, False, False]
    assert one(instruments.industry_sector(F.lit("3571"), F.lit(""))) == "Information Technology"
    assert one(instruments.industry_sector(F.lit("3700"), F.lit(None).cast("string"))) is None
    assert one(instruments.industry_sector(F.lit("1311"), F.lit(""))) == "Energy"
    assert one(instruments.industry_sector(F.lit("x"), F.lit("State commercial banks"))) == "Financials"
    assert one(instruments.issuer_name(F.lit("ADVANCE AUTO PTS INC COM STK"))).startswith("ADVANCE AUTO PARTS")
    assert one(instruments.strongest(instruments.STATUS, F.lit("exact"), F.lit(None).cast("string"))) == "exact"


def reference(spark):
    companies = spark.createDataFrame([("NET", "Cloudflare, Inc.", 1, "NYSE"), ("AAP", "Advance Auto Parts, Inc.", 2, "NYSE"), ("ACMA", "Acme Inc", 3, "NYSE"), ("ACMB", "Acme Corp", 4, "NYSE")], "ticker string, issuer_name string, cik long, exchange string")
    directory = spark.createDataFrame([("NET", "Cloudflare, Inc. Class A Common Stock", False, False), ("VTI", "Vanguard Total", True, False), ("ZTEST", "Test Issue", False, True)], "ticker string, issuer_name string, is_etf boolean, is_test boolean")
    return resolution.reference_merge(companies, directory)


def test_reference_merge(spark):
    got = {r["ticker"]: r for r in reference(spark).collect()}
    assert got["NET"]["issuer_name"] == "Cloudflare, Inc." and got["NET"]["sources"] == ["companies", "directory"]
    assert got["VTI"]["is_etf"] and got["VTI"]["cik"] is None and got["AAP"]["clean_name"] == "ADVANCE AUTO PARTS"


def test_resolution(spark):
    rows = [("k1", "CLOUDFLARE INC CLASS A", None, "Equity"), ("k2", "ADVANCE AUTO PTS INC", None, "Equity"), ("k3", "ACME INC", None, "Equity"), ("k4", "NOBODY KNOWS LTD", None, "Equity"), ("k5", "whatever", "vti", "ETF / Fund"), ("k6", "VANGUARD TOTAL", None, "Equity")]
    securities = spark.createDataFrame(rows, "security_key string, description string, source_ticker string, asset_type string")
    got = {r["security_key"]: r for r in resolution.resolved(securities, resolution.candidates(securities, reference(spark))).collect()}
    assert got["k1"]["resolved_ticker"] == "NET" and got["k2"]["resolved_ticker"] == "AAP" and got["k2"]["resolved_cik"] == 2
    assert got["k3"]["resolved_ticker"] is None and got["k3"]["flags"] == ["Multiple possible tickers"]
    assert got["k4"]["flags"] == ["No public match"] and got["k5"]["resolved_ticker"] == "VTI" and got["k6"]["resolved_ticker"] is None


CANDIDATES = "array<struct<figi:string,ticker:string,name:string,market:string,security_type:string,text:string>>"


def test_identifier_cascade(spark):
    good = ("F1", "FHN 5.75 05/01/30", "FIRST HORIZON BANK", "Corp", "GLOBAL", "FHN 5 3/4 05/01/30")
    regs = ("F2", "FHN 5.75 05/01/30", "FIRST HORIZON BANK", "Corp", "EURO-DOLLAR", "FHN 5 3/4 05/01/30 REGS")
    other = ("F3", "FHN 4 05/01/30", "FIRST HORIZON BANK", "Corp", "GLOBAL", "FHN 4 05/01/30")
    muni = lambda i: (f"M{i}", None, "WASHINGTON ST HEALTH", "Muni", "X", "5% 09/01/35")
    d = "FIRST HORIZON BK MEMPHIS TENN DUE 05/01/2030 05.750%"
    rows = [
        ("a", d, "Corporate Bond", [good, regs, other]), ("b", d + " REGS", "Corporate Bond", [good, regs]), ("c", d, "Corporate Bond", [good, ("F9", *good[1:])]), ("d", d, "Corporate Bond", []),
        ("e", "WASHINGTON ST HEALT 5% DUE 09/01/35", "Municipal Bond", [muni(1), muni(2)]), ("f", "WASHINGTON ST HEALT 5% DUE 09/01/35", "Municipal Bond", [muni(1)]),
    ]
    got = {r["security_key"]: (r["status"], r["figi"]) for r in resolution.identifier_candidates(spark.createDataFrame(rows, f"security_key string, description string, asset_type string, candidates {CANDIDATES}")).collect()}
    assert got == {"a": ("matched", "F1"), "b": ("matched", "F2"), "c": ("ambiguous", None), "d": ("not_found", None), "e": ("ambiguous", None), "f": ("matched", "M1")}


def test_identities(spark):
    schema = "entry_id string, display string, asset_type string, sector string, cusip string, isin string, figi string, kind string, issuer string, coupon double, maturity string, ticker string, issuer_ticker string, status string, review string, reliability string, score double, current_mid double, transaction_count long, ord long"
    rows = [
        ("1", "Bond A", "Corporate Bond", "S1", "123456789", None, None, "corporate bond/note", "ISS", 5.0, "2030-01-01", None, None, None, None, "official", 10.0, 100.0, 1, 1),
        ("2", "Bond A2", "Corporate Bond", "S2", "123456789", None, None, "corporate bond/note", None, None, None, None, None, None, None, "archived_copy", 20.0, 50.0, 2, 2),
        ("3", "Muni", "Municipal Bond", "S3", None, None, None, "municipal bond", "WA", 5.0, "2035-01-01", None, None, None, None, "metadata_only", 5.0, 10.0, 1, 3),
        ("4", "Stock", "Equity", "S4", None, None, None, None, None, None, None, "NET", None, None, None, "official", 5.0, 10.0, 1, 4),
    ]
    got = {r["display"]: r for r in resolution.identities(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"Bond A2", "Muni"}
    bond = got["Bond A2"]
    assert (bond["sector"], bond["status"], bond["entries"], bond["current_mid"], bond["reliability"], bond["coupon"]) == ("S1", "exact", 2, 150.0, "official", 5.0)
    assert got["Muni"]["status"] == "needs_identifier" and got["Muni"]["review"] == "needs_review" and got["Muni"]["priority"] > 60
    assert [r["display"] for r in resolution.review_items(resolution.identities(spark.createDataFrame(rows, schema))).collect()] == ["Muni"]


def test_asset_rows(spark):
    text = """1. before any part $5
Part 2: Filer's Employment Assets & Income
1. FIRST CO
  more of it $1,001 - $15,000 Dividends $201 - $1,000
2 of pages
1.1 SECOND CO  Orer $50,000,000
Part 7: Transactions
still inside $2,500
Part 3: Filer's Employment Agreements
9. outside $1
Part 6: Other Assets and Income
4. LAST $15001 - $50 000
Part 8: Liabilities
5. outside"""
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = documents.asset_rows(documents.lines(docs)).orderBy("part", "row").collect()
    assert [(r["part"], r["number"], r["value"], r["income"]) for r in got] == [
        ("Part 2", "1", "$1,001 - $15,000", "$201 - $1,000"), ("Part 2", "1.1", "Over $50,000,000", "$2,500"), ("Part 6", "4", "$15,001 - $50", None),
    ]
    assert "2 of pages" in got[0]["text"]
