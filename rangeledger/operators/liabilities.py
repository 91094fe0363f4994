"""Liabilities of disclosure documents, in the three layouts they come in.

Rows are lines (doc_id, n, line) of ``documents.lines``.  A layout's state (which
part is open, which row a line belongs to) is a running count over a document's
lines; a window holds one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeledger.functions import fixed, money
from rangeledger.functions.text import squeezed
from rangeledger.operators.documents import corrected
from rangeledger.plans.stages import cut

AMOUNT = fixed.DISCLOSED_AMOUNT
TAIL = rf"(?i)\s{AMOUNT}\s+(\d{{4}}|N/A)\s+([0-9.]+%|N/A)\s+(.+)$"


def _upto(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _between(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Lines behind the first that matches ``start``, to the next that matches ``end``."""
    seen = rows.withColumn("opened", F.sum(F.col("line").rlike(start).cast("int")).over(_upto("doc_id")))
    seen = seen.where("opened > 0").withColumn("closed", F.sum((F.col("line").rlike(end)).cast("int")).over(_upto("doc_id")))
    return seen.where((F.col("closed") == 0) & ~F.col("line").rlike(start)).drop("opened", "closed")


def _joined(rows: DataFrame, by: str, sep: str = " ") -> DataFrame:
    """Lines of one row put together, in order, with the first line's number."""
    found = rows.groupBy("doc_id", by).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"), F.min("n").alias("n"))
    return found.withColumn("text", F.array_join(F.transform("lines", lambda x: x["line"]), sep)).drop("lines")


def creditor_and_type(value: Column, filer: str | None = None) -> tuple[Column, Column]:
    """A creditor and what is owed: cut where a known property (or the filer) is
    named, else before the word of the liability."""
    clean = F.trim(F.regexp_replace(value, r"\s+-\s+", " - "))
    markers = ([f" {filer} "] if filer else []) + fixed.PROPERTY_MARKERS
    places = F.filter(F.array(*(F.instr(clean, m) for m in markers)), lambda p: p > 1)
    at = F.array_min(places)
    inferred = F.coalesce(F.nullif(F.trim(F.regexp_extract(clean, fixed.CREDITOR_ENDS, 1)), F.lit("")), clean)
    name = F.when(at.isNotNull(), F.trim(F.substring(clean, F.lit(1), at - 1))).otherwise(inferred)
    rest = F.when(at.isNotNull(), F.trim(F.substring(clean, at, F.length(clean)))).otherwise(F.trim(F.substring(clean, F.length(inferred) + 1, F.length(clean))))
    return name, F.coalesce(F.nullif(rest, F.lit("")), F.lit(fixed.NO_LIABILITY_TYPE))


def _known(text: Column) -> Column:
    return F.nullif(F.nullif(text, F.lit("N/A")), F.lit(""))


def part_rows(rows: DataFrame, filer: str | None = None) -> DataFrame:
    """Numbered rows of the part, each ending with amount, year, rate and term."""
    lines = _between(rows, fixed.LIABILITIES_START, fixed.LIABILITIES_END).withColumn("line", F.trim("line"))
    lines = lines.where((F.col("line") != "") & ~F.col("line").rlike(fixed.LIABILITY_SKIPPED))
    starts = F.col("line").rlike(fixed.LIABILITY_ROW) | F.col("line").rlike(fixed.LIABILITY_NAMED_ROW)
    chunks = _joined(lines.withColumn("row", F.sum(starts.cast("int")).over(_upto("doc_id"))), "row")
    text = F.trim(F.regexp_replace("text", " +", " "))
    before = F.trim(F.regexp_replace(F.regexp_extract(text, rf"^(.*?){TAIL}".replace("(?i)", "", 1), 1), r"^\d+\.\s*", ""))
    rows_ = chunks.withColumn("text", text).where(F.col("text").rlike(TAIL)).withColumn("before", before)
    parts = F.filter(F.transform(F.split("before", r"\t+"), lambda p: F.trim(p)), lambda p: p != "")
    plain = F.regexp_replace("before", r"\t+", " ")
    name, kind = creditor_and_type(plain, filer)
    several = F.size("parts") > 1
    shaped = rows_.withColumn("parts", parts).select(
        "doc_id", "n", F.when(several, F.get("parts", F.lit(0))).otherwise(name).alias("creditor"), F.when(several, F.array_join(F.slice("parts", 2, 1000), " ")).otherwise(kind).alias("type"),
        money.parse_range(F.regexp_extract("text", TAIL, 1)).alias("amount"), _known(F.regexp_extract("text", TAIL, 2)).alias("year"), _known(F.regexp_extract("text", TAIL, 3)).alias("rate"),
        F.trim(F.regexp_extract("text", TAIL, 4)).alias("term"), F.lit(0.78).alias("confidence"), F.lit("part").alias("layout"),
    )
    return shaped.where("creditor <> ''")


def columnar_rows(rows: DataFrame, filer: str | None = None) -> DataFrame:
    """Amounts listed before the part and names behind its heading, put together by
    their position."""
    kept = rows.withColumn("line", corrected(F.col("line"))).where((F.col("line") != "") & ~F.col("line").rlike(fixed.SKIPPED_LINE))
    amounts = _between(kept, fixed.AMOUNT_COLUMNS, fixed.LIABILITIES_START)
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("n"))
    amounts = amounts.withColumn("number", F.when(before.rlike(r"^\d{1,2}\.$"), before)).where(~F.col("line").rlike(r"^\d{1,2}\.$"))
    begins = F.col("line").rlike(rf"(?i)^\d{{1,2}}\.\s+{AMOUNT}\s+(\d{{4}}|N/A)\b") | (F.col("number").isNotNull() & F.col("line").rlike(rf"(?i)^{AMOUNT}\s+(\d{{4}}|N/A)\b"))
    amounts = amounts.withColumn("row", F.sum(begins.cast("int")).over(_upto("doc_id"))).withColumn("line", F.when(F.col("number").isNotNull() & begins, F.concat_ws(" ", "number", "line")).otherwise(F.col("line")))
    row = rf"(?i)^\d{{1,2}}\.\s+{AMOUNT}\s+(\d{{4}}|N/A)\s+(.+)$"
    found = _joined(amounts, "row").where(F.col("text").rlike(row))
    rest = F.trim(F.regexp_extract("text", row, 3))
    term = F.nullif(F.regexp_extract(rest, "(?i)(" + fixed.TERM_WORDS.replace("(?i)", "") + ".*)$", 1), F.lit(""))
    rate = F.nullif(F.trim(F.when(term.isNotNull(), F.substring(rest, F.lit(1), F.length(rest) - F.length(term))).otherwise(rest)), F.lit(""))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("n"))
    found = found.select("doc_id", place.alias("k"), F.regexp_extract("text", row, 1).alias("label"), _known(F.regexp_extract("text", row, 2)).alias("year"), rate.alias("rate"), term.alias("term"))
    names = _between(kept, fixed.LIABILITIES_START, fixed.NAME_COLUMNS_END).where(~F.col("line").rlike(fixed.NAME_COLUMNS_HEAD))
    names = names.withColumn("stop", F.sum(F.col("line").startswith("*").cast("int")).over(_upto("doc_id"))).where("stop = 0")
    ends = F.col("line").rlike(fixed.LIABILITY_WORDS)
    names = names.withColumn("row", F.sum(ends.cast("int")).over(_upto("doc_id")) - ends.cast("int"))
    named = _joined(names, "row").where(F.col("text").rlike(fixed.LIABILITY_WORDS)).select("doc_id", "n", place.alias("k"), squeezed(F.col("text")).alias("name"))
    creditor, kind = creditor_and_type(F.col("name"), filer)
    both = named.join(found, ["doc_id", "k"])
    return both.select("doc_id", "n", creditor.alias("creditor"), kind.alias("type"), money.parse_range(F.col("label")).alias("amount"), "year", "rate", "term", F.lit(0.7).alias("confidence"), F.lit("columnar").alias("layout"))


def inline_rows(rows: DataFrame, filer: str | None = None) -> DataFrame:
    """Lines that hold a creditor and an amount; a line that breaks off behind a dash
    goes on with the next."""
    lines = _between(rows.withColumn("line", corrected(F.col("line"))).where("line <> ''"), fixed.LIABILITIES_START, fixed.LIABILITIES_END)
    lines = lines.withColumn("stop", F.sum(F.col("line").startswith("*").cast("int")).over(_upto("doc_id"))).where("stop = 0")
    lines = lines.withColumn("next", F.coalesce(F.lead("line").over(Window.partitionBy("doc_id").orderBy("n")), F.lit("")))
    amount = rf"(?i)\s{AMOUNT}(?:\s+(\d{{4}}|N/A)\b)?"
    fine = lines.where(~F.col("line").rlike(fixed.SKIPPED_LINE) & ~F.col("line").rlike(fixed.INLINE_SKIPPED) & ~F.col("line").rlike(r"^\d{1,2}\.?$") & F.col("line").rlike(amount))
    head = F.regexp_extract("line", rf"(?i)^(.*?)\s{AMOUNT}", 1)
    broken = head.rlike(r"-\s*$") & F.col("next").rlike(fixed.INLINE_CONTINUED)
    before = F.trim(F.regexp_replace(F.when(broken, F.concat(head, "next")).otherwise(head), r"^\d{1,2}\.\s*", ""))
    name, kind = creditor_and_type(before, filer)
    year = _known(F.regexp_extract("line", amount, 2))
    found = fine.select("doc_id", "n", name.alias("creditor"), kind.alias("type"), money.parse_range(F.regexp_extract("line", amount, 1)).alias("amount"), year.alias("year"), F.lit(None).cast("string").alias("rate"), F.lit(None).cast("string").alias("term"), F.when(year.isNotNull(), 0.68).otherwise(0.62).alias("confidence"), F.lit("inline").alias("layout"))
    return found.where((F.col("creditor") != "") & ~F.col("creditor").rlike(r"^\d{4}$"))


def liabilities(rows: DataFrame, filer: str | None = None) -> DataFrame:
    """All liabilities of the documents: rows of the part and those in columns; lines
    with an amount only where a document has no rows of the part.  Of rows alike in
    creditor, type, amount and year the first layout's first one stays.

    The lines and the rows of the part are computed once, and lines are searched for
    amounts only in the documents that need it."""
    rows = cut(rows)
    part = cut(part_rows(rows, filer))
    inline = inline_rows(rows.join(part.select("doc_id").distinct(), "doc_id", "left_anti"), filer)
    every = part.unionByName(inline).unionByName(columnar_rows(rows, filer))
    order = F.when(F.col("layout") == "part", 0).when(F.col("layout") == "inline", 1).otherwise(2)
    first = F.row_number().over(Window.partitionBy("doc_id", "creditor", "type", "amount.label", F.coalesce("year", F.lit(""))).orderBy(order, "n"))
    return every.withColumn("rn", first).where("rn = 1").drop("rn")
