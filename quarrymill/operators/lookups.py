"""Lookups over facts, calendars, seminars, guides and search pages; each answers a table of requests, or all groups at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import FEW, beside, first_of_each, written

#: The key figures of a tax year, in the order in which they are shown.
KEY_FIGURES = ["residency_days", "exemption_{year}", "salary_deduction_{year}", "standard_single_{year}", "nr_salary_rate", "nr_threshold_{year}", "special_talent_threshold"]
#: Words read in a minute, and the least minutes of a guide.
WORDS_A_MINUTE, LEAST_MINUTES = 220, 2
#: Fixed value: listings taken from the pages of one keyword.
IDS_OF_KEYWORD = 25


def find_facts(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """(q, columns of ``facts``): the facts (id, topics, year) that each request (q, ids, topic, year) is for.

    What a request leaves open (null, an empty list, an empty topic or the year 0) doesn't bind. A fact without a year is one of every
    year. Requests meet facts by what binds them most: ids, else the topic, else the year; only a request for nothing in
    particular meets all facts, which are its answer.
    """
    text = lambda kind, c: F.concat(F.lit(kind), c.cast("string"))
    given = asked.select("q", F.array_distinct(F.coalesce("ids", F.array().cast("array<string>"))).alias("ids"), F.when(F.col("topic") != "", F.col("topic")).alias("of_topic"), F.when(F.col("year") != 0, F.col("year")).alias("of_year"))
    keys = (
        F.when(F.size("ids") > 0, F.transform("ids", lambda i: text("i:", i))).when(F.col("of_topic").isNotNull(), F.array(text("t:", F.col("of_topic"))))
        .when(F.col("of_year").isNotNull(), F.array(text("y:", F.col("of_year")), F.lit("y"))).otherwise(F.array(F.lit("a")))
    )
    given = given.withColumn("_key", F.explode(F.array_compact(keys))).drop("ids")
    topics = F.array_distinct(F.coalesce("topics", F.array().cast("array<string>")))
    own = F.concat(F.array(text("i:", F.col("id"))), F.transform(topics, lambda t: text("t:", t)), F.array(F.coalesce(text("y:", F.col("year")), F.lit("y")), F.lit("a")))
    wanted = given.select("_key").distinct()
    keyed = beside(facts.withColumn("_key", F.explode(F.array_compact(own))), wanted, "_key")
    met = beside(keyed, given, "_key")
    topic_fits = F.col("of_topic").isNull() | F.coalesce(F.array_contains("topics", F.col("of_topic")), F.lit(False))
    year_fits = F.col("of_year").isNull() | F.col("year").isNull() | (F.col("year") == F.col("of_year"))
    return met.filter(topic_fits & year_fits).select("q", *facts.columns)


def calendar(items: DataFrame, today: Column, by: list[str]) -> DataFrame:
    """``items`` (``by``, date, end, pos, any others) with ``label`` (past, next or upcoming), and for the next item of each calendar
    ``days`` (until it; below zero once it has begun) and ``when_label``.

    The next item is the first by date, then by pos, of those that haven't ended. An item without an end ends on its date, one without a
    date is neither past nor next. It is found by an aggregate, so a calendar of any length is no one task's.
    """
    over = F.coalesce(F.coalesce("end", "date") < today, F.lit(False))
    going = items.filter(~over & F.col("date").isNotNull())
    top = going.groupBy(*by).agg(F.min(F.struct("date", "pos")).alias("_next"))
    rows = beside(items, top, by, "left")
    is_next = F.coalesce((F.col("date") == F.col("_next.date")) & (F.col("pos") == F.col("_next.pos")), F.lit(False))
    days = F.datediff("date", today)
    when = (
        F.when(F.col("end").isNotNull() & (F.col("date") <= today), "Happening now").when(days == 0, "Today").when(days == 1, "Tomorrow")
        .when(days < 60, F.concat(F.lit("In "), days.cast("string"), F.lit(" days"))).otherwise(F.date_format("date", "d MMM yyyy"))
    )
    return rows.select(*items.columns, F.when(over, "past").when(is_next, "next").otherwise("upcoming").alias("label"), F.when(is_next, days).alias("days"), F.when(is_next, when).alias("when_label"))


def of_tag(listings: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag, part, uid, starts_at): of each of ``tags`` (tag) the open listings (part ``open``: upcoming or ongoing) and the latest that
    has ended (part ``last``: the last by start, then the least uid; without a start it comes last). Listings hold a tag once."""
    each = listings.select(F.explode(F.array_distinct("tags")).alias("tag"), "uid", "starts_at", "status")
    each = beside(each, tags.select("tag").distinct(), "tag")
    ended = each.filter("status = 'expired'").withColumn("at", F.coalesce("starts_at", F.lit("")))
    last = first_of_each(ended, ["tag"], [F.desc("at"), F.asc("uid")], 1)
    return each.filter("status in ('upcoming', 'ongoing')").select("tag", F.lit("open").alias("part"), "uid", "starts_at").unionByName(last.select("tag", F.lit("last").alias("part"), "uid", "starts_at"))


def key_figures(facts: DataFrame, years: DataFrame, ids: list[str] = KEY_FIGURES) -> DataFrame:
    """(year, place, columns of ``facts``): the facts (id and others) that ``ids`` name, for each of ``years`` (year), in order; ids
    that aren't there are passed over and count for no place."""
    named = F.array(*[F.replace(F.lit(i), F.lit("{year}"), F.col("year").cast("string")) for i in ids])
    wanted = years.select("year").distinct().select(F.col("year").alias("of_year"), F.posexplode(named).alias("pos", "id"))
    found = beside(facts, wanted, "id")
    place = F.row_number().over(Window.partitionBy("of_year").orderBy("pos"))  # as many rows as ids
    return found.withColumn("place", place).select(F.col("of_year").alias("year"), "place", *facts.columns)


def strings_in(value: Column, kind: T.DataType) -> Column:
    """All strings that a value of a nested type holds, at any depth, as an array without nulls."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        return F.array_compact(F.array(value))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda x: strings_in(x, kind.elementType))), none)
    if isinstance(kind, T.StructType) and kind.fields:
        return F.coalesce(F.concat(*[strings_in(value[f.name], f.dataType) for f in kind.fields]), none)
    return none


def reading_minutes(guides: DataFrame) -> DataFrame:
    """(slug, words, minutes): the words of all strings in a guide's ``sections``, and the minutes that they take, rounded half to even."""
    kind = guides.schema["sections"].dataType
    words = F.aggregate(strings_in(F.col("sections"), kind), F.lit(0).cast("long"), lambda n, s: n + F.regexp_count(s, F.lit(r"(?U)\S+")))
    return guides.select("slug", words.alias("words")).withColumn("minutes", F.greatest(F.lit(LEAST_MINUTES), F.bround(F.col("words") / WORDS_A_MINUTE)).cast("long"))


def resolved_share(rows: DataFrame, found: Column, weight: Column, by: list[str] | None = None) -> DataFrame:
    """(``by``, total, resolved, percent): the summed ``weight`` of all rows and of those where ``found`` is true, and its whole percent. A
    null weight counts for nothing; a total of zero has no percent."""
    sums = rows.groupBy(*(by or [])).agg(F.coalesce(F.sum(weight), F.lit(0)).cast("long").alias("total"), F.coalesce(F.sum(F.when(found, weight)), F.lit(0)).cast("long").alias("resolved"))
    return sums.withColumn("percent", F.expr("CASE WHEN total <> 0 THEN resolved * 100 div total END"))


def keyword_union(scenarios: DataFrame) -> DataFrame:
    """(pos, keyword): the different keywords of ``scenarios`` (pos, keywords) in the order in which they first appear, without empty ones."""
    each = scenarios.select(F.col("pos").alias("scenario"), F.posexplode("keywords").alias("nth", "keyword")).filter("keyword <> ''")
    first = each.groupBy("keyword").agg(F.min(F.struct("scenario", "nth")).alias("at"))
    return first.select((F.row_number().over(Window.orderBy("at")) - 1).alias("pos"), "keyword")  # as many rows as keywords


def discovered(pages: DataFrame, pattern: str, most: int = IDS_OF_KEYWORD) -> DataFrame:
    """(id, keywords): the listing ids that ``pattern`` (its first group) finds in the search pages (pos, keyword, page, html), and the
    keywords that found each, in order of pos. Of each keyword the first ``most`` different ids count, page by page.

    A page with ``most`` different ids is the last of its keyword that counts, so later pages are left out before their ids become
    rows. Ids are reduced to their first place before they are ranked, and ranked by parts, so no keyword is one task's. The place is
    one number where pages are numbers: its minimum is hashed, that of a struct would sort every row first.
    """
    ids = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(pattern), F.lit(1))
    full = pages.filter(F.col("page").isNotNull() & (F.size(F.array_distinct(ids)) >= most))
    full = written(full.groupBy("pos", "keyword").agg(F.min("page").alias("_last")), "discovered-last")
    if full.count() <= FEW:
        pages = pages.join(F.broadcast(full), ["pos", "keyword"], "left").filter(F.col("page").isNull() | F.col("_last").isNull() | (F.col("page") <= F.col("_last")))
    each = pages.select("pos", "keyword", "page", F.posexplode(ids).alias("at", "id"))
    place = F.struct("page", "at")
    if isinstance(pages.schema["page"].dataType, T.IntegralType):  # a null comes first, as in a struct
        place = F.coalesce(F.col("page").cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)")) * F.lit(1 << 31).cast("decimal(10,0)") + F.col("at")
    each = each.groupBy("pos", "keyword", "id").agg(F.min(place).alias("first"))
    hits = first_of_each(each, ["pos", "keyword"], [F.asc("first")], most, by="id")
    return hits.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "keyword"))), lambda x: x["keyword"]).alias("keywords"))
