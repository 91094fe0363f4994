"""Documents as lines: chunks, context and line items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeledger.functions import fixed, money
from rangeledger.functions.text import class_flags, classified, named_symbol, replaced, squeezed


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, n (from 1) and line of every line."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return rows.select("doc_id", (F.col("p") + 1).alias("n"), "line")


def chunks(rows: DataFrame, starts: Column) -> DataFrame:
    """Lines put together from each line that starts a chunk; those before the
    first are chunk 0.  A window holds one document's lines."""
    running = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumn("chunk", F.sum(F.when(starts, 1).otherwise(0)).over(running))
    return marked.groupBy("doc_id", "chunk").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"), F.min("n").alias("first_line"))


def context(rows: DataFrame, reach: int) -> DataFrame:
    """Each line with ``reach`` lines before and behind it."""
    near = Window.partitionBy("doc_id").orderBy("n").rowsBetween(-reach, reach)
    return rows.withColumn("around", F.array_join(F.collect_list("line").over(near), "\n"))


ITEM = r"^(\d{1,2}/\d{1,2}/\d{4})\s+(P|S|E)\s+(.+?)\s+(\$[\d,]+\s*-\s*\$[\d,]+|Over \$[\d,]+)$"


def line_items(rows: DataFrame) -> DataFrame:
    """Date, type, description and amount of lines of the form of a reported trade."""
    parts = [F.regexp_extract("line", ITEM, i) for i in range(1, 5)]
    kind = F.when(parts[1] == "P", "Purchase").when(parts[1] == "S", "Sale").when(parts[1] == "E", "Exchange")
    found = rows.where(F.col("line").rlike(ITEM))
    return found.select("doc_id", "n", F.try_to_date(parts[0], "M/d/yyyy").alias("date"), kind.alias("type"), F.trim(parts[2]).alias("description"), parts[3].alias("amount"))


def reported_trades(rows: DataFrame) -> DataFrame:
    """Lines that report a trade in words, with or without a row's number: doc_id, n,
    date, type, description, amount (null if there is none), late and ticker.

    A line without a number needs a description of 4 to 99 characters that is no
    heading."""
    line = F.trim(F.regexp_replace("line", r"[\t\r\f\x0B\x{A0}]", " "))
    marked = rows.withColumn("line", line).withColumns({"numbered": F.col("line").rlike(fixed.NUMBERED_TRADE), "bare": F.col("line").rlike(fixed.BARE_TRADE)}).where("numbered or bare")
    part = lambda i: F.when(F.col("numbered"), F.regexp_extract("line", fixed.NUMBERED_TRADE, i + 1)).otherwise(F.regexp_extract("line", fixed.BARE_TRADE, i))
    found = marked.withColumns({"raw": part(1), "kind": part(2), "day": part(3), "late_word": part(4), "sum": part(5)})
    fits = F.col("numbered") | ((F.length("raw") > 3) & (F.length("raw") < 100) & ~F.col("raw").rlike(fixed.HEADING_WORDS))
    return found.where(fits).select(
        "doc_id", "n", F.try_to_date("day", "M/d/yyyy").alias("date"), F.initcap("kind").alias("type"), F.trim("raw").alias("description"), F.nullif(squeezed(F.col("sum")), F.lit("")).alias("amount"),
        (F.lower("late_word") == "yes").alias("late"), named_symbol(F.col("raw"), fixed.LINE_SYMBOLS, fixed.LINE_NAMES).alias("ticker"),
    )


def corrected(line: Column) -> Column:
    """A line with misread words put right, white space squeezed, and sums of money
    regrouped by thousands."""
    plain = replaced(squeezed(line), *fixed.MISREAD)
    # Digits of a sum run together first, then commas go before each third from its end.
    closed = F.regexp_replace(plain, r"(?<=\$)\s+(?=\d)", "")
    joined = F.regexp_replace(closed, r"(\$\d+|(?!^)\G\d+)\s*[,.]\s*(?=\d)", "$1")
    return F.regexp_replace(joined, r"(?<=\$\d{1,12})(?=(\d{3})+(?!\d))", ",")


def asset_rows(rows: DataFrame) -> DataFrame:
    """Numbered rows of the asset parts of a document, each with its further lines.

    A part is open from its heading to the heading that ends it; a row runs to the
    next row's number.  The states are running maxima over a document's lines."""
    lines_ = rows.withColumn("line", corrected(F.col("line"))).where((F.col("line") != "") & ~F.col("line").rlike(fixed.SKIPPED_LINE))
    upto = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.lit(None).cast("string")
    for part, pattern in fixed.PART_STARTS.items():
        start = F.when(F.col("line").rlike(pattern), part).otherwise(start)
    marked = lines_.withColumn("start", start)
    opened = F.max(F.when(F.col("start").isNotNull(), F.struct("n", "start"))).over(upto)
    marked = marked.withColumn("opened", opened)
    for part, pattern in fixed.PART_ENDS.items():
        marked = marked.withColumn(f"end {part}", F.max(F.when(F.col("line").rlike(pattern), F.col("n"))).over(upto))
    ended = F.lit(False)
    for part in fixed.PART_ENDS:
        ended = ended | ((F.col("opened.start") == part) & (F.coalesce(F.col(f"end {part}"), F.lit(-1)) > F.col("opened.n")))
    active = F.col("opened").isNotNull() & ~ended & F.col("start").isNull()
    inside = marked.where(active).select("doc_id", "n", "line", F.col("opened.start").alias("part"), F.col("opened.n").alias("part_at"))
    number = F.regexp_extract("line", fixed.ROW_START, 1)
    begins = (number != "") & ~F.regexp_extract("line", fixed.ROW_START, 2).rlike(fixed.NO_ROW)
    in_part = Window.partitionBy("doc_id", "part_at").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = inside.withColumn("row", F.sum(F.when(begins, 1).otherwise(0)).over(in_part)).where("row > 0")
    chunk = numbered.groupBy("doc_id", "part", "part_at", "row").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), " ")
    amounts = F.regexp_extract_all(text, F.lit(fixed.DISCLOSED_AMOUNT), F.lit(1))
    chunk = chunk.withColumns({"text": text, "amounts": amounts})
    income = F.when(F.size("amounts") > 1, F.element_at("amounts", -1))
    return chunk.select("doc_id", "part", "row", F.regexp_extract("text", fixed.ROW_START, 1).alias("number"), "text", F.get("amounts", F.lit(0)).alias("value"), income.alias("income"))


def asset_holdings(found: DataFrame) -> DataFrame:
    """Rows of :func:`asset_rows` as holdings: description, class, value, income type
    and income, each once per document.  Rows without a value or a description are none.

    The first amount of a row is its value, the last behind it its income."""
    bare = F.regexp_replace("text", r"^\d+(?:\.\d+)?\.?\s+", "")
    split = rf"(?i)^(.*?){fixed.DISCLOSED_AMOUNT}(.*)$"
    rows = found.where("value is not null").withColumn("bare", bare).withColumns({"head": F.trim(F.regexp_extract("bare", split, 1)), "rest": F.trim(F.regexp_extract("bare", split, 3))})
    name = reduce(lambda t, p: F.trim(F.regexp_replace(t, p, "")), fixed.DESCRIPTION_CUTS, F.col("head"))
    name = F.regexp_replace(squeezed(name), r"[;:,.\s]+$", "")
    last = rf"(?i)^(.*?){fixed.DISCLOSED_AMOUNT}(?!.*{fixed.DISCLOSED_AMOUNT})"
    kind = F.trim(F.when(F.col("rest").rlike(last), F.regexp_extract("rest", last, 1)).otherwise(F.col("rest")))
    kind = F.when(kind.rlike(r"(?i)^None \(or less than \$201\)$"), None).otherwise(F.nullif(kind, F.lit("")))
    rows = rows.withColumns({"description": name, "income_type": kind, "worth": money.parse_range(F.col("value")), "earned": money.parse_range(F.coalesce("income", F.lit("")))})
    rows = rows.where((F.col("description") != "") & ~F.col("description").rlike("(?i)^N/A$")).withColumn("c", classified(F.col("description")))
    first = F.row_number().over(Window.partitionBy("doc_id", "part", "number", "description", "worth.label", "earned.label").orderBy("row"))
    rows = rows.withColumn("rn", first).where("rn = 1")
    flags = F.concat(
        class_flags(F.col("c.found.asset_type"), F.col("c.found.sector"), F.col("c.found.confidence")), F.array(F.concat(F.lit("Parsed from "), "part", F.lit(" text; verify PDF row before publication."))),
        F.when(F.col("worth.midpoint") == 0, F.array(F.lit("No disclosed value range parsed"))).otherwise(F.array().cast("array<string>")),
    )
    return rows.select(
        F.col("doc_id").alias("source_id"), "part", "number", "description", F.col("c.normalized_description").alias("normalized_description"), F.col("worth").alias("value"), "income_type", F.col("earned").alias("income"),
        F.col("c.found.asset_type").alias("asset_type"), F.col("c.found.sector").alias("sector"), F.least(F.lit(fixed.ASSET_CAP), "c.found.confidence").alias("confidence"), F.array_distinct(flags).alias("flags"),
    )


def profile(docs: DataFrame, name: str) -> DataFrame:
    """Distinct dates of each text, sorted, and how often it says ``name``."""
    dates = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1))))
    return docs.select("doc_id", dates.alias("dates"), F.regexp_count("text", F.lit(name)).cast("long").alias("mentions"))
