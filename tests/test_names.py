"""Similar names without all pairs of a first word, and families of candidates."""

import random

import pytest
from pyspark.sql import functions as F

from rangeledger.functions.text import issuer_similarity
from rangeledger.operators import resolution, similarity

FIRST = ["FIRST", "FIRST", "ACME", "A&B", "INTERNATIONAL"]
WORDS = ["FIRST", "BANK", "CORP", "OF", "TRUST", "NATIONAL", "ACME", "AB", "GROUP", "HOLDINGS", "FINANCIAL", "X", "INTERNATIONAL", "CO", "ONE", "TWO", "THREE", "FOUR"]


def misspelt(rnd, name):
    chars = list(name)
    for _ in range(rnd.randint(1, 3)):
        at, how = rnd.randrange(len(chars)), rnd.random()
        if how < 0.3:
            chars[at] = rnd.choice("ABCXYZ")
        elif how < 0.6:
            chars.insert(at, rnd.choice("ABCXYZ"))
        elif len(chars) > 2:
            del chars[at]
    return " ".join("".join(chars).split())


def names(rnd, n, most=5):
    plain = [" ".join([rnd.choice(FIRST), *(rnd.choice(WORDS) for _ in range(rnd.randint(0, most)))]) for _ in range(n)]
    return [misspelt(rnd, s) if rnd.random() < 0.5 else s for s in plain]


def frame(spark, some):
    return spark.createDataFrame([(n,) for n in some], "name string")


def block_pairs(left, right):
    other = right.distinct().withColumnRenamed("name", "other")
    return left.distinct().join(other, similarity.first_word(F.col("name")) == similarity.first_word(F.col("other")))


@pytest.mark.parametrize(("threshold", "most"), [(0.8, 4), (0.8, 12), (0.65, 5)])
def test_no_pair_of_the_block_join_is_lost(spark, threshold, most):
    rnd = random.Random(most)
    left, right = frame(spark, [*names(rnd, 250, most), "", "FIRST"]), frame(spark, [*names(rnd, 250, most), "", "FIRST", "X" * 60, "X" * 60 + " CO"])
    got = {tuple(r) for r in similarity.similar_names(left, right, threshold).select("left_name", "right_name").collect()}
    want = {tuple(r) for r in block_pairs(left, right).where((issuer_similarity(F.col("name"), F.col("other")) >= threshold) & (F.col("name") != "")).select("name", "other").collect()}
    assert got == want and len(want) > 50


def test_a_hot_first_word_makes_few_candidates(spark):
    rnd = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPRSTUVW"
    vocabulary = ["".join(rnd.choice(letters) for _ in range(rnd.randint(3, 9))) for _ in range(400)] + ["BANK", "TRUST", "GROUP"] * 30
    base = [" ".join(["FIRST", *(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 3)))]) for _ in range(600)]
    left, right = frame(spark, base), frame(spark, [n[:-1] if rnd.random() < 0.3 else " ".join(["FIRST", *(rnd.choice(vocabulary) for _ in range(2))]) for n in base])
    proposed, pairs, found = similarity.proposed_pairs(left, right).count(), block_pairs(left, right).count(), similarity.similar_names(left, right).count()
    assert found > 100 and proposed < 8 * found and proposed < pairs / 50


def test_bounds():
    assert [similarity.few_words(t) for t in (0.8, 0.6, 0.9)] == [7, 2, 17]
    assert [similarity.edits_allowed(n, 0.8) for n in (7, 8, 23, 48)] == [0, 1, 3, 6]


def test_thresholds_that_cannot_be(spark):
    for threshold in (0.4, 0.92):
        with pytest.raises(ValueError):
            similarity.proposed_pairs(frame(spark, ["A"]), frame(spark, ["A"]), threshold)


def test_families(spark):
    """A share class beside a preferred one, two issuers that are too near, one that resolves, none."""
    found = [
        ("bond", "Corporate Bond", "ZZZ-P", "Zed Preferred", "ZED", None, False, "clean", 0.93), ("bond", "Corporate Bond", "ZZZ", "Zed Inc", "ZED", 7, False, "clean", 0.93), ("bond", "Corporate Bond", "ZEB", "Zeb Inc", "ZEB", 9, False, "similar", 0.86),
        ("clear", "Municipal Bond", "CLR", "Clear", "CLEAR", 4, False, "clean", 0.93), ("clear", "Municipal Bond", "CLX", "Clearer", "CLEARER", 4, False, "similar", 0.82),
        ("odd", "Other", "ODD", "Odd Unit Trust", "ODD", None, False, "exact", 0.96), ("far", "Corporate Bond", "FAR", "Far", "FAR", 1, False, "similar", 0.7),
        ("share", "Equity", "SHR", "Share", "SHARE", 1, False, "exact", 0.96), ("fund", "ETF / Fund", "FND", "Fund", "FUND", None, True, "ticker", 1.0),
        ("tie", "Corporate Bond", "AA", "Aa", "AA", 1, False, "similar", 0.9), ("tie", "Corporate Bond", "BB", "Bb", "BB", 1, False, "similar", 0.9), ("tie", "Corporate Bond", "BC", "Bb", "BB", 1, False, "similar", 0.85),
    ]
    rows = spark.createDataFrame(found, "security_key string, asset_type string, ticker string, issuer_name string, clean_name string, cik long, is_etf boolean, how string, score double").withColumn("ticker_key", F.col("ticker"))
    securities = rows.select("security_key", "asset_type", F.lit(None).cast("string").alias("source_ticker")).distinct().union(spark.createDataFrame([("none", "Other", None), ("nothing", "Equity", None)], "security_key string, asset_type string, source_ticker string"))
    got = {r["security_key"]: r for r in resolution.resolved(securities, rows).collect()}
    note = "Issuer context only; not direct instrument ticker"
    bond = got["bond"]
    assert (bond["resolved_ticker"], bond["context_ticker"], bond["context_cik"], bond["context_source"], bond["context_confidence"]) == (None, "ZZZ", 7, "sec-issuer-context", 0.9)
    assert bond["flags"] == ["Multiple possible tickers", note] and bond["context_flags"] == [note, "Multiple issuer securities share this issuer name"] and bond["candidate_tickers"] == ["ZZZ", "ZZZ-P", "ZEB"]
    assert (got["clear"]["resolved_ticker"], got["clear"]["context_ticker"], got["clear"]["flags"]) == ("CLR", "CLR", [])
    assert (got["odd"]["resolved_ticker"], got["odd"]["context_ticker"], got["odd"]["flags"]) == (None, "ODD", [note]) and got["odd"]["context_flags"] == [note, "No SEC CIK for issuer context"]
    assert got["far"]["context_ticker"] is None and got["far"]["flags"] == ["Low-confidence issuer match"]
    assert got["share"]["context_ticker"] is None and got["share"]["resolved_ticker"] == "SHR" and got["fund"]["resolved_ticker"] == "FND"
    assert got["tie"]["context_ticker"] == "BB" and got["none"]["flags"] == [] and got["nothing"]["flags"] == ["No public match"]


def paired_match(left, right):
    """The rule of the unique match over all pairs."""
    out = {}
    for l_id, keys, kind, ticker, own in left:
        met = [r for r in right if set(keys) & set(r[1])]
        near = [r for r in met if (r[2] is not None and r[2] == kind) or (r[3] is not None and r[3] == ticker)]
        some = near or met
        exact = [r for r in some if r[4] is not None and r[4] == own]
        if len(some) == 1 or len(exact) == 1:
            out[l_id] = (some if len(some) == 1 else exact)[0][0]
    return out


def test_unique_match_equals_all_pairs(spark):
    from rangeledger.plans.joins import unique_match

    schema, rnd, hits = "id long, keys array<string>, kind string, ticker string, own string", random.Random(9), 0
    for seed in range(4):
        pick = lambda values: rnd.choice([*values, None])
        make = lambda n, spare: [(i, [rnd.choice(spare) for _ in range(rnd.randint(0, 3))], pick("ab"), pick("xyz"), pick("pqrst")) for i in range(n)]
        spare = [f"k{i}" for i in range(6 + 60 * seed)]
        left, right = make(120, spare), make(80, spare)
        got = unique_match(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema).withColumnRenamed("id", "rid"), "id", "rid", "keys", [("kind", "kind"), ("ticker", "ticker")], ("own", "own"))
        want = paired_match(left, right)
        hits += len(want)
        assert {r["id"]: r["rid"] for r in got.collect()} == want
    assert hits > 30


def test_a_hot_ticker_makes_no_pairs(spark):
    """Three thousand securities and two thousand baseline rows of one ticker."""
    from rangeledger.operators.holdings import estimated, grouped

    bracket = F.struct(F.lit("b").alias("label"), F.lit(1.0).alias("min"), F.lit(3.0).alias("max"), F.lit(2.0).alias("midpoint"))
    tx = spark.range(3000).select(F.concat(F.lit("NAME "), "id").alias("description"), F.lit("HOT").alias("ticker"), F.lit("Equity").alias("asset_type"), F.lit("s").alias("sector"), F.lit("Purchase").alias("type"), F.lit("2024-01-01").cast("date").alias("date"), bracket.alias("amount"), F.lit(False).alias("late"), F.col("id").alias("ord"))
    baseline = spark.range(1000, 3000).select(F.col("id").alias("baseline_id"), F.concat(F.lit("NAME "), "id").alias("description"), F.lit("HOT").alias("ticker"), F.lit("Equity").alias("asset_type"), bracket.alias("value"))
    found = estimated(grouped(tx), baseline)
    rows = found.groupBy("missing_baseline").count().collect()
    assert {r["missing_baseline"]: r["count"] for r in rows} == {True: 1000, False: 2000}
    # A left row meets one count for each of its probes, however many rows stand behind it.
    assert found.select("security_key").distinct().count() == 3000
