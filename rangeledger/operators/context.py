"""Context documents: which are taken, and the dated events made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeledger.functions import fixed, order
from rangeledger.functions.text import clean_html, importance_of, labels_of, stable_id, ticker_mentions

WORDS = "(?i)" + "|".join(fixed.CONTEXT_WORDS)


def says(*columns: str) -> Column:
    """Whether any of the texts has a word of the context list."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(c, F.lit("")).rlike(WORDS)
    return found


def social_posts(docs: DataFrame, speaker: str) -> Column:
    """Posts of a speaker that are no repeats and touch the context words."""
    return F.col("source").isin(fixed.SOCIAL_SOURCES) & F.coalesce("speaker", F.lit("")).ilike(f"%{speaker}%") & ~F.coalesce("title", F.lit("")).ilike("RT:%") & says("title", "full_text")


def official_documents(docs: DataFrame, speaker: str) -> Column:
    """Official sources or types that name the speaker; orders whatever they say."""
    kind = F.col("doc_type")
    named = F.coalesce("speaker", F.lit("")).ilike(f"%{speaker}%") | F.coalesce("title", F.lit("")).ilike(f"%{speaker}%")
    official = F.coalesce(F.col("source").isin(fixed.OFFICIAL_SOURCES), F.lit(False)) | F.coalesce(kind.isin(fixed.OFFICIAL_TYPES), F.lit(False))
    return official & named & (says("title", "full_text") | F.coalesce(kind.isin(fixed.ORDER_TYPES), F.lit(False)))


def wire_stories() -> Column:
    """Stories that touch the context words or carry a topic of the list."""
    topics = F.arrays_overlap(F.coalesce("topic_codes", F.array().cast("array<string>")), F.array(*(F.lit(t) for t in fixed.WIRE_TOPICS)))
    return says("headline", "slug", "fragment", "body_text") | F.coalesce(topics, F.lit(False))


def taken(docs: DataFrame, when: Column, date: str, low: str, high: str, limit: int, key: str) -> DataFrame:
    """Documents of a span of dates under a condition, the newest first, at most ``limit``."""
    inside = F.col(date).between(F.lit(low).cast("date"), F.lit(high).cast("date"))
    return docs.where(inside & when).orderBy(F.col(date).desc(), F.col(key).desc()).limit(limit)


def category_of(text: Column) -> Column:
    """Posts, interviews, market talk, else official."""
    head = F.concat_ws(" ", F.coalesce("doc_type", F.lit("")), F.coalesce("title", F.lit("")), text)
    return F.when(F.col("source").isin(fixed.SOCIAL_SOURCES), "truth-social").when(head.rlike("(?i)" + fixed.INTERVIEW_WORDS), "interview").when(text.rlike("(?i)" + fixed.MARKET_WORDS), "market").otherwise("white-house")


def source_name() -> Column:
    name = F.lit("Archive")
    for kind, label in reversed(fixed.TYPE_NAMES.items()):
        name = F.when(F.col("doc_type") == kind, label).otherwise(name)
    for source, label in reversed(fixed.SOURCE_NAMES.items()):
        name = F.when(F.col("source") == source, label).otherwise(name)
    return name


def context_importance(text: Column, doc_type: Column, source: Column) -> Column:
    grave = F.lower(text).rlike(fixed.CONTEXT_IMPORTANT) | F.coalesce(doc_type.isin(fixed.ORDER_TYPES), F.lit(False)) | ((source == "reuters") & text.rlike("(?i)" + fixed.WIRE_IMPORTANT))
    return F.when(F.coalesce(grave, F.lit(False)), 3).otherwise(2)


def without_links(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"https?://\S+", ""))


def summary(text: Column, fallback: Column) -> Column:
    clean = without_links(text)
    short = F.when(F.length(clean) > 260, F.concat(F.trim(F.left(clean, F.lit(257))), F.lit("..."))).otherwise(clean)
    return F.coalesce(F.nullif(short, F.lit("")), F.concat(fallback, F.lit(" context item.")))


def clean_set(values: Column, upper: bool = False) -> Column:
    """Trimmed, distinct, sorted; empty ones out."""
    plain = F.transform(values, lambda v: F.upper(F.trim(v)) if upper else F.trim(v))
    return F.array_sort(F.array_distinct(F.filter(plain, lambda v: F.coalesce(v, F.lit("")) != "")))


def register_events(docs: DataFrame) -> DataFrame:
    """Register documents (title, abstract, date, url, number) as tariff events; those
    without a title, date or link, or of no importance, are none."""
    title, body = clean_html(F.coalesce("title", F.lit(""))), clean_html(F.coalesce("abstract", F.lit("")))
    text = F.concat_ws(" ", "clean_title", "clean_body")
    rows = docs.withColumns({"clean_title": title, "clean_body": body})
    rows = rows.where(F.col("date").isNotNull() & (F.col("clean_title") != "") & F.col("url").isNotNull()).withColumn("importance", importance_of(text)).where("importance >= 2")
    key = F.concat_ws("|", F.lit("federal-register"), F.coalesce(F.col("number").cast("string"), "clean_title"), F.col("date").cast("string"))
    none = F.array().cast("array<string>")
    return rows.select(
        stable_id(key).alias("event_id"), "date", F.lit(None).cast("date").alias("end_date"), F.lit("tariff").alias("category"), F.col("clean_title").alias("title"),
        F.coalesce(F.nullif("clean_body", F.lit("")), F.lit("Federal Register trade or tariff-related document.")).alias("summary"), F.lit("Federal Register").alias("source_name"), F.col("url").alias("source_url"),
        none.alias("tickers"), labels_of(text, fixed.EVENT_SECTORS).alias("sectors"), labels_of(text, fixed.EVENT_TAGS).alias("tags"), "importance",
    )


def document_events(docs: DataFrame) -> DataFrame:
    """Documents (id, source, doc_type, title, doc_date, url, full_text) as events."""
    body = F.coalesce("full_text", F.lit(""))
    title = without_links(F.coalesce(F.nullif("title", F.lit("")), body))
    rows = docs.withColumns({"clean_title": title, "text": F.concat_ws(" ", title, body)}).where(F.col("doc_date").isNotNull() & (F.col("clean_title") != ""))
    text, name = F.col("text"), source_name()
    tags = clean_set(F.concat(labels_of(text, fixed.EVENT_TAGS), F.array(F.coalesce("doc_type", F.lit("")), F.coalesce("source", F.lit("")))))
    key = F.concat_ws("|", F.lit("context"), F.col("id").cast("string"), F.col("doc_date").cast("string"))
    return rows.select(
        stable_id(key).alias("event_id"), F.col("doc_date").alias("date"), F.lit(None).cast("date").alias("end_date"), category_of(text).alias("category"), F.left("clean_title", F.lit(180)).alias("title"),
        summary(F.coalesce("full_text", "clean_title"), name).alias("summary"), name.alias("source_name"), F.coalesce("url", F.lit("")).alias("source_url"), ticker_mentions(text).alias("tickers"),
        labels_of(text, fixed.EVENT_SECTORS).alias("sectors"), tags.alias("tags"), context_importance(text, F.col("doc_type"), F.col("source")).alias("importance"),
    )


def topic_tickers(codes: Column) -> Column:
    """Tickers of ``R:`` topic codes, without what follows a dot."""
    named = F.transform(codes, lambda c: F.regexp_extract(c, r"(?i)^R:([A-Z0-9.:-]+)", 1))
    return F.transform(F.filter(named, lambda n: n != ""), lambda n: F.upper(F.regexp_replace(n, r"\..*$", "")))


def story_events(stories: DataFrame) -> DataFrame:
    """Wire stories (uri, headline, slug, fragment, body_text, created, url, topic_codes) as events."""
    slug = F.coalesce("slug", F.lit(""))
    title = without_links(F.coalesce(F.nullif("headline", F.lit("")), slug))
    codes = F.coalesce("topic_codes", F.array().cast("array<string>"))
    rows = stories.withColumns({"clean_title": title, "codes": F.filter(codes, lambda c: c.rlike("(?i)^N2:|^R:|^MCC:|^subj:"))}).withColumn("text", F.concat_ws(" ", "clean_title", slug, F.coalesce("fragment", F.lit("")), F.coalesce("body_text", F.lit(""))))
    rows = rows.where(F.col("created").isNotNull() & (F.col("clean_title") != ""))
    text = F.col("text")
    tags = clean_set(F.concat(labels_of(text, fixed.EVENT_TAGS), F.array(slug), F.slice("codes", 1, 12)))
    key = F.concat_ws("|", F.lit("wire"), F.col("uri").cast("string"), F.col("created").cast("string"))
    return rows.select(
        stable_id(key).alias("event_id"), F.col("created").alias("date"), F.lit(None).cast("date").alias("end_date"), F.lit("reuters").alias("category"), F.left("clean_title", F.lit(180)).alias("title"),
        summary(F.coalesce(F.nullif("fragment", F.lit("")), F.nullif("body_text", F.lit("")), "clean_title"), F.lit("Wire")).alias("summary"), F.lit("Reuters").alias("source_name"), F.coalesce("url", F.lit("")).alias("source_url"),
        F.array_sort(F.array_distinct(F.concat(topic_tickers(F.col("codes")), ticker_mentions(text)))).alias("tickers"), labels_of(text, fixed.EVENT_SECTORS).alias("sectors"), tags.alias("tags"),
        context_importance(text, F.lit("reuters_story"), F.lit("reuters")).alias("importance"),
    )


def manual_events(rows: DataFrame) -> DataFrame:
    """Entered events with what is missing filled in: id, arrays, an importance of 1 to 3."""
    key = F.concat_ws("|", F.lit("manual-event"), F.col("date").cast("string"), "title", F.col("position").cast("string"))
    none = F.array().cast("array<string>")
    return rows.withColumns({
        "event_id": F.coalesce(F.nullif("event_id", F.lit("")), stable_id(key)), "tickers": clean_set(F.coalesce("tickers", none), upper=True), "sectors": clean_set(F.coalesce("sectors", none)),
        "tags": clean_set(F.coalesce("tags", none)), "importance": F.when(F.col("importance") >= 3, 3).when(F.col("importance") <= 1, 1).otherwise(2),
    })


def rate_meetings(spark: SparkSession) -> DataFrame:
    """Scheduled meetings as events; those with projections weigh more."""
    rows = spark.createDataFrame(fixed.RATE_MEETINGS, "date string, end_date string, projections boolean").withColumns({c: F.col(c).cast("date") for c in ("date", "end_date")})
    title = F.when(F.col("projections"), "FOMC meeting with projections").otherwise("FOMC meeting")
    return rows.select(
        stable_id(F.concat_ws("|", F.lit("fomc"), F.col("date").cast("string"), title)).alias("event_id"), "date", "end_date", F.lit("fed").alias("category"), title.alias("title"),
        F.array(F.lit("FOMC"), F.when(F.col("projections"), "SEP").otherwise("meeting")).alias("tags"), F.when(F.col("projections"), 3).otherwise(2).alias("importance"),
    )


def two_phase(events: DataFrame, limit: int) -> DataFrame:
    """The gravest ``limit`` events, then in the order of their dates."""
    gravest = events.orderBy(F.col("importance").desc(), F.col("date").desc(), *order.visible("title"), "event_id").limit(limit)
    return gravest.orderBy(*order.event_order())


