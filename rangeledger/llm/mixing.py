"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words.  Its documents are taken whole:
first ``floor(target / source words)`` certain copies of each, then a sample of
one further copy.  For the sample a document's rank is its random odds
``u / (1 - u)`` divided by its inclusion odds ``p / (1 - p)``, where ``p`` is the
fraction still wanted of its source, tilted by an optional weight per document;
the lowest ranks are taken until the words wanted are reached; then, in the order of
their ranks again, documents that fit into what is left, and up to ``CLOSING`` more,
each the one whose size comes nearest to what is left then.

The sampled size is fixed in words.  No source is ever sorted: ranks are
mapped to 36-bit places and the place where a source is full is found by three
rounds of sums over 4096 bins, each over what the round before left open.

Defined cases: a null text has no words; a null source is a source of its own,
sorted last; an empty table gives no rows; documents without words take none;
repeated rows share their rank and are taken or left together; columns other
than ``doc_id``, ``source`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeledger.llm.common import WORD_PATTERN, cut, cut_small, join_bounded

BIN_BITS = 12
LEVELS = 3
CLOSING = 2
PLACES = 1 << (BIN_BITS * LEVELS)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Per source: source_no, source_size, target.

    ``share`` of all words is dealt by weight, each target stopping at ``most``
    times its source; what is above is dealt again among the others.  That is
    the water level ``L`` with ``sum(least(cap, L * weight))`` = the share: with
    sources ordered by cap / weight, the first whose cap is not reached by the
    level of it and its followers sets the level.  The windows run over one row
    per source, not over documents."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = totals.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    numbered = numbered.withColumn("weight", F.element_at(cycle, (F.col("source_no") - 1) % len(weights) + 1))
    numbered = numbered.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levelled = numbered.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    levelled = levelled.withColumn("level", F.first(fits, ignorenulls=True).over(whole))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return levelled.select("source", "source_no", "source_size", target.alias("target"))


def _uniform(seed: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def _full_at(ranked: DataFrame) -> DataFrame:
    """Per source_no: ``full_at`` (places below it are taken) and ``left`` (words still wanted)."""
    found = None
    for level in range(LEVELS):
        shift = BIN_BITS * (LEVELS - 1 - level)
        here = ranked
        if found is not None:
            here = join_bounded(ranked.drop("rest"), found, "source_no").where(F.shiftright("place", shift + BIN_BITS) == F.col("prefix"))
        else:
            here = here.withColumn("prefix", F.lit(0).cast("long"))
        bins = here.groupBy("source_no", "prefix", "rest", F.shiftright("place", shift).alias("bin")).agg(F.sum("size").alias("words"))
        # At most 4096 rows per source.
        running = Window.partitionBy("source_no").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bins = bins.withColumn("upto", F.sum("words").over(running))
        over = F.col("upto") > F.col("rest")
        end = (F.col("prefix") + 1) * (1 << BIN_BITS)
        found = bins.groupBy("source_no", "prefix", "rest").agg(
            F.min(F.when(over, F.col("bin"))).alias("at"), F.coalesce(F.max(F.when(~over, F.col("upto"))), F.lit(0)).alias("below")
        )
        found = cut_small(found.select("source_no", F.coalesce("at", end).alias("prefix"), (F.col("rest") - F.col("below")).alias("rest")))
    return found.select("source_no", F.col("prefix").alias("full_at"), F.col("rest").alias("left"))


def _sized(docs: DataFrame, tilt: str | Column | None) -> DataFrame:
    """``docs`` with ``_size`` (words) and ``_tilt``."""
    sized = docs.withColumn("_size", word_count(F.col("text")))
    if isinstance(tilt, Column):
        return sized.withColumn("size", F.col("_size")).withColumn("_tilt", tilt.cast("double"))
    return sized.withColumn("_tilt", F.col(tilt).cast("double") if tilt else F.lit(1.0))


def _placed(rows: DataFrame, seed: int) -> DataFrame:
    """Rows of id, size, tilt and their source's target with ``whole`` certain
    copies, the words ``rest`` wanted besides, and ``place``, the mapped rank."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(ratio + 1e-12)).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    part = F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0)
    u = _uniform(seed)
    odds = F.greatest(F.lit(1e-300), part / (1 - part) * F.col("tilt"))
    rank = u / (1 - u) / odds
    place = F.least(F.lit(PLACES - 1), F.floor(rank / (1 + rank) * PLACES))
    return rows.withColumn("place", place.cast("long"))


def mix_plan(sizes: DataFrame, weights: Sequence[float], share: float, most: float, seed: int) -> DataFrame:
    """From doc_id, source, size and tilt: a row per source with its target and
    where its ranks are cut.  All of the mix that is not a document's own."""
    targets = cut_small(source_targets(sizes, weights, share, most))
    small = join_bounded(sizes, targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("source", "of")
    ranked = cut(_placed(small, seed).select("doc_id", "source_no", "size", "rest", "place").where((F.col("rest") > 0) & (F.col("size") > 0)))
    full = _full_at(ranked)
    fits = (F.col("place") >= F.col("full_at")) & (F.col("size") <= F.col("left"))
    second = join_bounded(ranked.drop("rest"), full, "source_no").where(fits).select("doc_id", "source_no", "size", F.col("left").alias("rest"), "place")
    second = _full_at(second).select("source_no", F.col("full_at").alias("second_at"), F.col("left").alias("second_left"))
    full = cut_small(full.join(second, "source_no", "left").withColumn("fits", F.col("left")).withColumn("left", F.coalesce("second_left", "left")).drop("second_left"))
    left, last = full, None
    for _ in range(CLOSING):
        outside = join_bounded(ranked, left, "source_no").where(~_taken() & (F.col("left") > 0) & (F.col("size") < 2 * F.col("left")))
        if last is not None:
            gone = last.select(F.col("source_no").alias("s"), F.col("place").alias("p"), F.col("doc_id").alias("d"))
            outside = join_bounded(outside, gone, (F.col("source_no") == F.col("s")) & (F.col("place") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_anti")
        nearest = outside.groupBy("source_no", "full_at", "second_at", "fits", "left").agg(F.min(F.struct(F.abs(F.col("left") - F.col("size")).alias("gap"), "place", "doc_id", "size")).alias("last"))
        left = cut_small(nearest.withColumn("left", F.col("left") - F.col("last.size")))
        found = left.select("source_no", "last.place", "last.doc_id")
        last = found if last is None else last.unionByName(found)
    closing = last.groupBy("source_no").agg(F.collect_list(F.struct("place", "doc_id")).alias("last"))
    return cut_small(targets.join(full.drop("left").join(closing, "source_no", "left"), "source_no", "left"))


def _taken() -> Column:
    return (F.col("place") < F.col("full_at")) | ((F.col("size") <= F.col("fits")) & (F.col("place") < F.coalesce("second_at", F.lit(0))))


def with_copies(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, tilt: str | Column | None = None, keep: bool = True) -> DataFrame:
    """``docs`` (or their ids) with size, source_size, target and copies.

    Documents meet one row of their source, so that no text is shuffled; their
    words are counted once for the plan and once for the result.  Columns of these
    four names are replaced.  ``share`` is the mix's size in words as a part of all
    words, ``most`` the copies a document can have.  ``tilt``, a positive column of
    ``docs`` or an expression over ``size``, multiplies a document's inclusion odds
    (1 without it)."""
    held = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row") if keep else F.lit(0).alias("_row")
    sized = _sized(docs, tilt).select("doc_id", "source", F.col("_size").alias("size"), F.col("_tilt").alias("tilt"), held)
    plan = mix_plan(cut(sized.drop("_row")), weights, share, most, seed)
    found = _placed(join_bounded(sized, plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))), seed)
    closes = F.coalesce(F.exists("last", lambda x: (x.place == F.col("place")) & x.doc_id.eqNullSafe(F.col("doc_id"))), F.lit(False))
    sampled = (F.col("size") > 0) & (F.col("rest") > 0) & F.coalesce(_taken() | closes, F.lit(False))
    copies = (F.col("whole") + sampled.cast("long")).cast("long")
    own = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("size", "source_size", "target", "copies")] if keep else ["doc_id"]
    return found.select(*own, "size", "source_size", "target", copies.alias("copies"))


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, tilt: str | Column | None = None
) -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies, taken; parameters as
    of :func:`with_copies`."""
    found = with_copies(docs, weights, share, most, seed, tilt, keep=False)
    return found.withColumn("taken", F.col("size") * F.col("copies"))
