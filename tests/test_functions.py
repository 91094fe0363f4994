"""Money, text and join plans against values worked out by hand."""

import datetime

from pyspark.sql import functions as F

from rangeledger.functions import fixed, money, text
from rangeledger.operators import documents
from rangeledger.plans import joins


def one(spark, column, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, F.lit(value))
    return df.select(column.alias("x")).first()["x"]


def test_ranges(spark):
    parse = lambda v: one(spark, money.parse_range(F.col("v")), v=v)
    assert parse("$1,000,001 – $5,000,000")["midpoint"] == 3000000.5
    assert parse("Over $50,000,000")["midpoint"] == 50000001
    assert parse("us$ 2,000 - 4,000")["midpoint"] == 3000 and parse("us$ 2,000 - 4,000")["label"] == "$2,000-$4,000"
    assert parse("None (or less than $1,001)")["max"] == 0 and parse("None (or less than $1,001)")["label"].startswith("None")
    assert parse("")["label"] == "Unknown" and one(spark, money.parse_range(F.lit(None).cast("string")))["label"] == "Unknown"
    assert one(spark, money.bracket_of(F.lit(15000.0)))["label"] == "$1,001-$15,000"


def test_range_arithmetic(spark):
    left, right = money._range(F.lit("a"), F.lit(10.0), F.lit(20.0), F.lit(15.0)), money._range(F.lit("b"), F.lit(5.0), F.lit(30.0), F.lit(6.0))
    got = one(spark, money.minus_clamped(left, right, "c"))
    assert (got["min"], got["max"], got["midpoint"]) == (0, 15, 9)
    net = one(spark, money.net_range(left, right))
    assert (net["min"], net["max"], net["midpoint"]) == (-20, 15, 9)
    assert one(spark, money.round1(F.lit(-2.25))) == -2.2
    assert [one(spark, money.compact_money(F.lit(v))) for v in (0.0, 1500.0, 2e6, -3.14e9)] == ["$0", "$1.5K", "$2M", "-$3.1B"]


def test_security_text(spark):
    key = lambda v: one(spark, text.security_key(F.lit(v)))
    assert key("Cloudflare Inc Class A") == "CLOUDFLARE INC"
    assert key("FIRST BK 5% DUE 05/01/2030") == "FIRST BK 5%"
    assert one(spark, text.stock_key(F.lit("CLOUDFLARE INC CLASS A"))) == "CLOUDFLARE"
    assert one(spark, text.stock_key(F.lit("COMMON"))) == ""
    assert one(spark, text.stock_title(F.lit("ADMA BIOLOGICS CO"))) == "ADMA Biologics CO"
    assert one(spark, text.normal_description(F.lit("A&B, (C).  d"))) == "A AND B C D"


def classify(spark, description):
    got = one(spark, text.classified(F.lit(description)))["found"]
    return got["asset_type"], got["sector"], got["confidence"]


def test_classes(spark):
    assert classify(spark, "CLOUDFLARE INC CLASS A") == ("Equity", "Information Technology", 0.78)
    assert classify(spark, "WASHINGTON ST HEALT 5% DUE 09/01/35") == ("Municipal Bond", "Municipal Bonds", 0.9)
    assert classify(spark, "VANGUARD S&P 500 ETF") == ("ETF / Fund", "ETF / Funds", 0.88)
    assert classify(spark, "U S Bank Account") == ("Other", "Cash & Bank Accounts", 0.82)
    assert classify(spark, "gold watch") == ("Other", "Other", 0.55)
    assert one(spark, text.class_flags(F.lit("Other"), F.lit("Other"), F.lit(0.55))) == ["Needs sector review", "Needs asset-type review"]


def test_stable_id(spark):
    def by_hand(value):
        h = 0
        for c in value:
            h = (h * 31 + ord(c)) % 2**32
        return f"{h:08x}"

    for value in ("", "a", "holding|CLOUDFLARE INC", "ü" * 40):
        assert one(spark, text.stable_id(F.lit(value))) == by_hand(value)


def test_labels(spark):
    assert one(spark, text.labels_of(F.lit("Tariffs on STEEL vehicles from China"), fixed.EVENT_TAGS)) == ["Section 232", "autos", "country/trade partner"]
    assert one(spark, text.importance_of(F.lit("a Proclamation on x"))) == 3
    assert one(spark, text.importance_of(F.lit("customs notice"))) == 2
    assert one(spark, text.ticker_mentions(F.lit("$NET and $AAPL, $NET; $toolow"))) == ["AAPL", "NET"]
    assert one(spark, text.clean_html(F.lit("<p>a &amp;  b</p>"))) == "a & b"
    assert len(one(spark, text.summary_of(F.lit("x" * 300)))) == 260
    assert one(spark, text.confidence_label(F.lit(0.7))) == "Medium"


def test_similarity(spark):
    got = one(spark, text.issuer_similarity(F.lit("ADVANCE AUTO PARTS"), F.lit("ADVANCE AUTO")))
    assert abs(got - (0.84 + 0.08 * 12 / 18)) < 1e-12
    assert one(spark, text.issuer_similarity(F.lit("A"), F.lit(""))) == 0
    assert one(spark, text.issuer_similarity(F.lit("A B"), F.lit("AB"))) == 0.91


def test_interval_join_is_a_range_join(spark):
    day = datetime.date(2024, 1, 1)
    left = spark.createDataFrame([(i, day + datetime.timedelta(7 * i), day + datetime.timedelta(7 * i + i % 40)) for i in range(40)], "k int, lo date, hi date")
    right = spark.createDataFrame([(i, day + datetime.timedelta(3 * i)) for i in range(100)], "r int, at date")
    for days in (1, 5, 16):
        for how in ("inner", "left"):
            got = joins.interval_join(left, right, "lo", "hi", "at", days, how).where("r is not null").select("k", "r")
            want = left.join(right, F.col("at").between(F.col("lo"), F.col("hi")), "inner").select("k", "r")
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_either_null_safe(spark):
    left = spark.createDataFrame([("a", None), (None, "x"), ("b", "y"), (None, None)], "p string, q string")
    right = spark.createDataFrame([("a", "y"), (None, "x"), (None, None)], "r string, s string")
    for strict in (True, False):
        got = joins.either_null_safe(left, right, ("p", "r"), ("q", "s"), strict=strict)
        same = (F.col("p") == F.col("r")) | (F.col("q") == F.col("s")) if strict else F.col("p").eqNullSafe(F.col("r")) | F.col("q").eqNullSafe(F.col("s"))
        key = lambda rows: sorted(map(str, rows))
        assert key(got.collect()) == key(left.crossJoin(right).where(F.coalesce(same, F.lit(False))).collect())


def test_priority_and_last(spark):
    new = spark.createDataFrame([(1, "n")], "k int, v string")
    old = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string")
    assert sorted(map(tuple, joins.priority_union(["k"], new, old).collect())) == [(1, "n"), (2, "o")]
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, ord int, v string")
    assert joins.last_wins(rows, ["k"], F.col("ord")).first()["v"] == "b"


def test_lines(spark):
    docs = spark.createDataFrame([(1, "x\nHEAD a\nb\nHEAD c")], "doc_id long, text string")
    got = documents.chunks(documents.lines(docs), F.col("line").startswith("HEAD")).orderBy("chunk").collect()
    assert [(r["chunk"], r["lines"], r["first_line"]) for r in got] == [(0, 1, 1), (1, 2, 2), (2, 1, 4)]
    items = spark.createDataFrame([(1, "3/30/2026 P CLOUDFLARE INC $50,001 - $100,000\nno item")], "doc_id long, text string")
    row = documents.line_items(documents.lines(items)).first()
    assert (row["date"], row["type"], row["description"]) == (datetime.date(2026, 3, 30), "Purchase", "CLOUDFLARE INC")
