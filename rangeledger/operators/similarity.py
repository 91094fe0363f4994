"""Names that are alike, joined without comparing all names of one first word.

Only names of one first word can be alike.  Within it a pair reaches the threshold
in one of four ways, and each leaves keys that both names must share: one name
within the other (the whole name, among the substrings of the longer one that
begin with the first word), shared words (all of them but the one that either may
lack; of names of many words, one of the rarest), few edits (one of several segments of what follows
the first word, at a place that edits can reach), or the same letters.  A join by
equality on those keys proposes pairs; only they are scored.  No pair at the
threshold is lost, and a common word makes no pairs by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeledger.functions.text import issuer_similarity

#: Edit distance counts for names of up to so many letters, and weighs so much (fixed values).
EDIT_CHARS, EDIT_WEIGHT = 48, 0.92
#: Least length of names of which one may lie within the other (fixed value).
INSIDE_CHARS = 5


def first_word(name: Column) -> Column:
    return F.split(name, r"\s+")[0]


def _compact(name: Column) -> Column:
    return F.regexp_replace(F.upper(name), "[^A-Z0-9]", "")


def _key(kind: str, *parts: Column) -> Column:
    return F.xxhash64(F.lit(kind), *parts)


def _keys(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: _key(kind, v))


def _within(name: Column, word: Column) -> Column:
    """Substrings that begin with the word and are long enough, as keys."""
    starts = F.filter(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(name, i, F.length(word)) == word)
    ends = lambda i: F.filter(F.sequence(i, F.length(name)), lambda e: (e - i + 1 >= INSIDE_CHARS) & (e - i + 1 >= F.length(word)))
    return F.flatten(F.transform(starts, lambda i: F.transform(ends(i), lambda e: F.substring(name, i, e - i + 1))))


def _edits(longest: Column, threshold: float) -> Column:
    """Most edits between names of which the longer one has so many letters."""
    return F.floor(longest * (1 - threshold / EDIT_WEIGHT) + 1e-9).cast("int")


def _segments(letters: Column, threshold: float) -> Column:
    """One more than the edits that the longest partner of such a name allows."""
    return _edits(F.least(F.lit(EDIT_CHARS), F.floor(letters / (threshold / EDIT_WEIGHT) + 1e-9)), threshold) + 1


def _cut(n: Column, length: Column, of: Column) -> Column:
    return F.floor(n * length / of).cast("int")


def _own_segments(letters: Column, rest: Column, threshold: float) -> Column:
    parts = _segments(letters, threshold)
    each = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: _key("edit", letters, i, F.substring(rest, _cut(i, F.length(rest), parts) + 1, _cut(i + 1, F.length(rest), parts) - _cut(i, F.length(rest), parts))))
    return F.when(letters > EDIT_CHARS, F.array().cast("array<bigint>")).when(F.length(rest) < parts, F.array(_key("short", letters))).otherwise(each)


def _sought_segments(letters: Column, rest: Column, threshold: float) -> Column:
    """Keys under which :func:`_own_segments` files every name within reach of this one."""
    reach = _edits(F.lit(EDIT_CHARS), threshold)
    head = letters - F.length(rest)
    others = F.filter(F.sequence(F.greatest(F.lit(1), head, letters - reach), F.least(F.lit(EDIT_CHARS), letters + reach)), lambda m: F.abs(m - letters) <= _edits(F.greatest(m, letters), threshold))

    def sought(m: Column) -> Column:
        parts, length, away, most = _segments(m, threshold), m - head, letters - m, _edits(F.greatest(m, letters), threshold)

        def places(i: Column) -> Column:
            start = _cut(i, length, parts)
            size = _cut(i + 1, length, parts) - start
            # What is before a segment and what is behind it differ by as many letters as it is moved.
            moves = F.filter(F.sequence(-most, most), lambda d: (F.abs(d) + F.abs(away - d) <= most) & (start + d >= 0) & (start + d + size <= F.length(rest)))
            return F.transform(moves, lambda d: _key("edit", m, i, F.substring(rest, start + d + 1, size)))

        return F.when(length < parts, F.array(_key("short", m))).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), parts - 1), places)))

    return F.when((letters > EDIT_CHARS) | (letters < 1) | (F.least(F.lit(EDIT_CHARS), letters + reach) < F.greatest(head, letters - reach)), F.array().cast("array<bigint>")).otherwise(F.flatten(F.transform(others, sought)))


def _overlap(a: Column | int, b: Column | int, threshold: float) -> Column:
    """Least number of shared words of names of a and b words."""
    return F.ceil((a + b) * (threshold / (1 + threshold)) - 1e-9).cast("int")


def few_words(threshold: float) -> int:
    """Most words of a name that, with every name alike, lacks at most one word on either side."""
    need = lambda a, b: math.ceil(threshold * (a + b) / (1 + threshold) - 1e-9)
    n = 0
    while all(max(n + 1, b) - need(n + 1, b) <= 1 for b in range(1, 3 * (n + 1) + 3) if min(n + 1, b) >= threshold * max(n + 1, b) - 1e-9):
        n += 1
    return n


def _but_one(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.filter(words, lambda w: w != F.element_at(words, i)))


def _own_words(words: Column) -> Column:
    n = F.size(words)
    return F.concat(F.array(_key("words", n, F.lit(0), words)), F.transform(_but_one(words), lambda some: _key("words", n, F.lit(1), some)))


def _sought_words(words: Column, threshold: float) -> Column:
    n, none = F.size(words), F.array().cast("array<bigint>")
    others = F.sequence(F.ceil(n * threshold - 1e-9).cast("int"), F.floor(n / threshold + 1e-9).cast("int"))

    def sought(m: Column) -> Column:
        lacks, lacked = n - _overlap(n, m, threshold), m - _overlap(n, m, threshold)
        return F.when(lacked > 1, none).when(lacks == 0, F.array(_key("words", m, lacked, words))).when(lacks == 1, F.transform(_but_one(words), lambda some: _key("words", m, lacked, some))).otherwise(none)

    return F.flatten(F.transform(others, sought))


def _rarest(names: DataFrame, threshold: float) -> DataFrame:
    """name, rare: of names of many words the rarest, one more than it may lack."""
    words = names.select("name", F.explode(F.array_distinct(F.split("name", " "))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    many = words.withColumn("of", F.count("*").over(Window.partitionBy("name"))).where(F.col("of") > few_words(threshold))
    ranked = many.join(counts, "word").withColumn("at", F.row_number().over(Window.partitionBy("name").orderBy("n", "word")))
    few = ranked.where(F.col("at") <= F.col("of") - F.ceil(F.col("of") * threshold - 1e-9) + 1)
    return few.groupBy("name").agg(F.collect_list("word").alias("rare"))


def proposed_pairs(left: DataFrame, right: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Distinct pairs of names (left_name, right_name) that may reach the threshold.

    ``left`` and ``right`` have a column ``name``: names, not texts, trimmed, of
    words with single spaces."""
    if not 0.5 <= threshold < EDIT_WEIGHT:
        raise ValueError("a threshold of 0.5 up to below 0.92")
    left, right = (side.select("name").where("name <> ''").distinct() for side in (left, right))
    rare = _rarest(left.union(right).distinct(), threshold)

    def keyed(side: DataFrame, seeks: bool) -> DataFrame:
        rows = side.join(rare, "name", "left").withColumns({"word": first_word(F.col("name")), "letters": _compact(F.col("name")), "rare": F.coalesce("rare", F.array().cast("array<string>"))})
        rows = rows.withColumn("words", F.array_sort(F.array_distinct(F.split("name", " "))))
        rows = rows.withColumns({"size": F.length("letters"), "rest": F.substring("letters", F.length(_compact(F.col("word"))) + 1, F.length("letters"))})
        rows = rows.withColumn("size", F.col("size").cast("int"))
        whole = F.when(F.length("name") >= INSIDE_CHARS, F.array("name")).otherwise(F.array().cast("array<string>"))
        within = F.when(F.length("name") >= INSIDE_CHARS, _within(F.col("name"), F.col("word"))).otherwise(F.array().cast("array<string>"))
        holds, held = (("in right", whole), ("in left", within)) if seeks else (("in right", within), ("in left", whole))
        keys = F.concat(
            _keys(*holds), _keys(*held), F.transform("rare", lambda w: _key("word", w)), F.array(_key("letters", F.col("letters"))),
            _sought_words(F.col("words"), threshold) if seeks else _own_words(F.col("words")),
            (_sought_segments if seeks else _own_segments)(F.col("size"), F.col("rest"), threshold),
        )
        return rows.select("name", "word", F.explode(F.array_distinct(F.transform(keys, lambda k: F.xxhash64(k, "word")))).alias("key"))

    a = keyed(left, True).select(F.col("name").alias("left_name"), "word", "key")
    b = keyed(right, False).select(F.col("name").alias("right_name"), F.col("word").alias("right_word"), F.col("key").alias("right_key"))
    return a.join(b, (F.col("key") == F.col("right_key")) & (F.col("word") == F.col("right_word"))).select("left_name", "right_name").distinct()


def similar_names(left: DataFrame, right: DataFrame, threshold: float = 0.8) -> DataFrame:
    """left_name, right_name, score of all pairs of one first word at the threshold or above."""
    scored = proposed_pairs(left, right, threshold).withColumn("score", issuer_similarity(F.col("left_name"), F.col("right_name")))
    return scored.where(F.col("score") >= threshold)


def edits_allowed(letters: int, threshold: float) -> int:
    """Edits between names of so many letters, for tests and estimates."""
    return math.floor(letters * (1 - threshold / EDIT_WEIGHT) + 1e-9)
