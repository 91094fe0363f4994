"""Joins that Spark has no operator for, as plans of those it has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def interval_join(left: DataFrame, right: DataFrame, low: str, high: str, at: str, days: int, how: str = "inner", also: Column | None = None) -> DataFrame:
    """Rows of ``left`` with the rows of ``right`` whose date ``at`` lies in [low, high].

    Dates fall into buckets of ``days`` days; a left row is copied to the buckets
    its interval meets, a right row has one, so the join is by equality on the
    bucket and no pair comes twice.  ``how`` is inner or left; left rows need a
    key of their own (``_row``) only for left joins, which is added here."""
    bucket = lambda c: F.floor(F.unix_date(c) / days)
    spread = left.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    keyed = right.withColumn("_at_bucket", bucket(F.col(at)))
    on = (F.col("_bucket") == F.col("_at_bucket")) & F.col(at).between(F.col(low), F.col(high))
    if also is not None:
        on = on & also
    return spread.join(keyed, on, how).drop("_bucket", "_at_bucket")


def either_null_safe(left: DataFrame, right: DataFrame, first: tuple[str, str], second: tuple[str, str], also: Column | None = None, strict: bool = False) -> DataFrame:
    """Inner join on ``first`` or ``second`` pair being the same, null equal to null.

    An OR of equalities would be a nested loop; two joins by equality, the second
    without the pairs of the first, are not.  ``strict`` leaves nulls unmatched."""
    same = [F.col(a) == F.col(b) if strict else F.col(a).eqNullSafe(F.col(b)) for a, b in (first, second)]
    rest = F.lit(True) if also is None else also
    one = left.join(right, same[0] & rest)
    two = left.join(right, same[1] & rest).where(~F.coalesce(same[0], F.lit(False)))
    return one.unionByName(two)


def priority_union(key: list[str], *frames: DataFrame, order: Column | None = None) -> DataFrame:
    """Rows of all frames, of each key the one of the earliest frame (then ``order``)."""
    ranked = reduce(DataFrame.unionByName, [f.withColumn("_prio", F.lit(i)) for i, f in enumerate(frames)])
    window = Window.partitionBy(*key).orderBy("_prio", *([order] if order is not None else []))
    return ranked.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_prio", "_rn")


def last_wins(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """Of each key the last row in the given order."""
    fields = F.struct(*(F.col(c) for c in df.columns))
    return df.groupBy(*key).agg(F.max_by(fields, F.struct(*order)).alias("_row")).select("_row.*")


def match_probes(rows: DataFrame, keys: str, alike: list[str], exact: str) -> Column:
    """What a row is looked up by: each of its typed keys alone (all), with each column
    of ``alike`` (near), with the exact one (same), and with both (both).  Lists on both
    sides name their columns in one order; what is null makes no probe."""
    none = F.array().cast("array<struct<what:string,at:bigint>>")
    probe = lambda what, *parts: F.struct(F.lit(what).alias("what"), F.xxhash64(F.lit(what), *parts).alias("at"))

    def of(k: Column) -> Column:
        found = [F.array(probe("all", k)), F.when(F.col(exact).isNotNull(), F.array(probe("same", k, F.col(exact))))]
        for n, c in enumerate(alike):
            found.append(F.when(F.col(c).isNotNull(), F.array(probe("near", k, F.lit(n), F.col(c)))))
            found.append(F.when(F.col(c).isNotNull() & F.col(exact).isNotNull(), F.array(probe("both", k, F.lit(n), F.col(c), F.col(exact)))))
        return F.concat(*(F.coalesce(f, none) for f in found))

    return F.flatten(F.transform(F.array_distinct(keys), of))


def unique_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: str, alike: list[tuple[str, str]], exact: tuple[str, str]) -> DataFrame:
    """Left id with the one right row it can mean, by any of several typed keys.

    ``keys`` is an array column on both sides.  Candidates that are equal in one of the
    pairs of ``alike`` replace the others where there are any; a single one is taken,
    else the single one that is equal in ``exact``, else none.

    Nothing is paired: right rows are counted under each key, and under each key and
    value, with their least id.  The candidates of a kind are one row if every count
    that a left row meets is 1 and all name the same id.  So a key that thousands share
    costs one row on the right and one for each left row."""
    spread = lambda df, id_col, names, same: df.select(id_col, F.explode(match_probes(df, keys, names, same)).alias("p")).select(id_col, "p.*")
    counted = spread(right, right_id, [r for _, r in alike], exact[1]).groupBy("what", "at").agg(F.count("*").alias("n"), F.min(right_id).alias(right_id))
    met = spread(left, left_id, [c for c, _ in alike], exact[0]).join(counted, ["what", "at"])
    of = lambda what, value: F.when(F.col("what") == what, value)
    kinds = ("all", "near", "same", "both")
    stats = met.groupBy(left_id).agg(
        *(F.max(of(k, F.col("n"))).alias(f"n_{k}") for k in kinds), *(F.min(of(k, F.col(right_id))).alias(f"low_{k}") for k in kinds), *(F.max(of(k, F.col(right_id))).alias(f"high_{k}") for k in kinds)
    )
    one = lambda k: (F.col(f"n_{k}") == 1) & (F.col(f"low_{k}") == F.col(f"high_{k}"))
    narrowed = F.col("n_near").isNotNull()
    chosen = F.when(narrowed & one("near"), F.col("low_near")).when(narrowed & one("both"), F.col("low_both"))
    chosen = chosen.when(~narrowed & one("all"), F.col("low_all")).when(~narrowed & one("same"), F.col("low_same"))
    return stats.select(left_id, chosen.alias(right_id)).where(F.col(right_id).isNotNull())
