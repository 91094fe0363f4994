"""Paged sources: requests by offset and length, and what their answers hold.

``PagedRest`` is a data source (``spark.read.format("paged_rest")``) whose tasks ask
for runs of pages; it returns answers as they come, a row a page.  Such rows, from
the source or landed before in any store, become records by :func:`records`, which
ends at the first page that is empty, failed or missing, or after the page that
reaches the total it names; a failure of the very first page is an error.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rangeledger.functions import instruments
from rangeledger.plans.stages import cut

#: A row a page: offset, answer as text, and what went wrong if there is none.
PAGES = "start long, body string, error string"

# Answers of the sources that are known (fixed values: names of their fields).
SOURCE_RECORD = "name string, title string, agency string, type string, docDate string, amended string"
SUBMISSION = "sic string, sicDescription string"
DOCUMENT = "title string, publication_date string, html_url string, abstract string, document_number string, agencies array<struct<name:string,raw_name:string>>"


class PageRun(InputPartition):
    """Offsets that one task asks for."""

    def __init__(self, starts: list[int]) -> None:
        self.starts = starts


class PagedRest(DataSource):
    """Options: url, length (rows a page), pages_per_task, pause_s, timeout_s, and the
    names of the answer's fields for rows and total (rows_field, total_field)."""

    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.length = options["url"], int(options.get("length", "100"))
        self.run, self.pause, self.timeout = int(options.get("pages_per_task", "16")), float(options.get("pause_s", "0")), float(options.get("timeout_s", "30"))
        self.rows_field, self.total_field = options.get("rows_field", "data"), options.get("total_field", "recordsTotal")
        if self.length < 1 or self.run < 1:
            raise ValueError("length and pages_per_task must be 1 or more")

    def ask(self, start: int) -> str:
        mark = "&" if "?" in self.url else "?"
        with urllib.request.urlopen(f"{self.url}{mark}{urllib.parse.urlencode({'start': start, 'length': self.length})}", timeout=self.timeout) as answer:
            return answer.read().decode("utf-8")

    def partitions(self) -> list[PageRun]:
        """The first page names the total; only numbers of pages stand here."""
        first = json.loads(self.ask(0))
        total = int(first.get(self.total_field) or len(first.get(self.rows_field) or []))
        starts = range(0, max(total, 1), self.length)
        return [PageRun(list(starts[i : i + self.run])) for i in range(0, len(starts), self.run)]

    def read(self, partition: PageRun) -> Iterator[tuple[int, str | None, str | None]]:
        """Pages of a run up to its first failure or empty page."""
        for start in partition.starts:
            try:
                body = self.ask(start)
                rows = json.loads(body).get(self.rows_field)
            except Exception as error:  # any failure ends the run; it is told, not hidden
                yield start, None, f"{type(error).__name__}: {error}"[:500]
                return
            yield start, body, None
            if not rows:
                return
            if self.pause:
                time.sleep(self.pause)


def answers(pages: DataFrame, record: str, rows_field: str = "data", total_field: str = "recordsTotal") -> DataFrame:
    """start, rows (array of records), total and failed of each page."""
    schema = f"{rows_field} array<struct<{_typed(record)}>>, {total_field} long, _bad string"
    parsed = F.from_json("body", schema, {"columnNameOfCorruptRecord": "_bad"})
    rows = pages.select("start", "body", parsed.alias("p"))
    failed = F.col("body").isNull() | F.col("p").isNull() | F.col("p._bad").isNotNull()
    found = F.coalesce(F.col("p")[rows_field], F.array().cast(f"array<struct<{_typed(record)}>>"))
    return rows.select("start", F.when(~failed, found).alias("rows"), F.when(~failed, F.coalesce(F.nullif(F.col("p")[total_field], F.lit(0)), F.size(found).cast("long"))).alias("total"), failed.alias("failed"))


def _typed(record: str) -> str:
    """name type, ... as name:type, ... of a struct."""
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(record).fields)


def records(pages: DataFrame, record: str, length: int, rows_field: str = "data", total_field: str = "recordsTotal") -> DataFrame:
    """The records of all pages that count, with the offset and place of each.

    A page's rows are bounded by its length; where reading ends is one number."""
    found = cut(answers(pages, record, rows_field, total_field))
    after = F.col("start") + length
    ends = found.select(F.when(F.col("failed") | (F.size("rows") == 0), F.col("start")).when(after >= F.col("total"), after).alias("end"))
    # A page that nobody landed ends it like one that failed.
    missing = found.where(~F.col("failed")).select(after.alias("start")).join(found.select("start"), "start", "left_anti").select(F.col("start").alias("end"))
    first = found.agg(F.min(F.when(F.col("start") == 0, F.col("failed"))).alias("first_failed"), F.count("*").alias("n"))
    end = ends.unionByName(missing).agg(F.min("end").alias("end")).crossJoin(F.broadcast(first))
    broken = (F.col("n") > 0) & F.coalesce(F.col("first_failed"), F.lit(True))
    end = end.select(F.when(broken, F.raise_error(F.lit("the first page is missing or failed")).cast("long")).otherwise(F.col("end")).alias("end"))
    kept = found.crossJoin(F.broadcast(end)).where(F.col("start") < F.col("end"))
    return kept.select("start", F.posexplode("rows").alias("place", "r")).select("start", "place", "r.*")


def submissions(landed: DataFrame) -> DataFrame:
    """Number and text of landed company answers as cik, sic, description and sector."""
    rows = landed.select("cik", F.from_json("body", SUBMISSION).alias("p"))
    sic, words = F.nullif(F.col("p.sic"), F.lit("")), F.nullif(F.trim("p.sicDescription"), F.lit(""))
    return rows.select("cik", sic.alias("sic"), words.alias("sic_description"), instruments.industry_sector(sic, words).alias("sector"))


def document_search(landed: DataFrame) -> DataFrame:
    """Found documents of landed searches (asked, body), one of each number, the last
    asked; those without a number go by date and title."""
    rows = landed.select("asked", F.posexplode(F.from_json("body", f"results array<struct<{_typed(DOCUMENT)}>>")["results"]).alias("place", "r"))
    date = F.try_to_date("r.publication_date", "yyyy-MM-dd")
    key = F.coalesce(F.nullif(F.col("r.document_number"), F.lit("")), F.concat_ws("|", F.coalesce("r.publication_date", F.lit("")), F.coalesce("r.title", F.lit(""))))
    one = rows.withColumn("key", key).groupBy("key").agg(F.max_by("r", F.struct("asked", "place")).alias("r"))
    return one.select(F.col("r.document_number").alias("number"), F.col("r.title").alias("title"), date.alias("date"), F.col("r.html_url").alias("url"), F.col("r.abstract").alias("abstract"), F.transform("r.agencies", lambda a: F.coalesce(a["name"], a["raw_name"])).alias("agencies"))
