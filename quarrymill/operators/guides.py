"""Guides: their search index, texts and references.

A guide has slug, title, kind, keywords, sources, related and sections; a section has id, heading, keywords and blocks; a block
is one of several kinds (GUIDE). Texts hold inline marks: bold, links, code, {{fact:id}} and [[guide:slug|label]].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import let
from .joins import beside, skewed_join

BLOCK = (
    "struct<p:string,list:array<string>,steps:array<struct<title:string,text:string>>,callout:struct<title:string,text:string>,table:struct<head:array<string>,rows:array<array<string>>>,"
    "stats:array<struct<label:string,value:string>>,faq:array<struct<q:string,a:string>>,facts:array<string>,cite:array<string>>"
)
GUIDE = f"slug string, pos long, title string, kind string, keywords array<string>, sources array<string>, related array<string>, sections array<struct<id:string,heading:string,keywords:array<string>,blocks:array<{BLOCK}>>>"
FACT, LINKED = r"\{\{fact:([a-z0-9_]+)\}\}", r"\[\[guide:([a-z0-9-]+)(?:\|[^\]]*)?\]\]"
#: What is marked in a text, in the order in which it is tried at a place. Its first letter is looked at before all else, as few places have one.
MARK = r"(?=[*\[{`])(?:\*\*[^*]+\*\*|\[\[guide:[a-z0-9-]+(?:\|[^\]]*)?\]\]|\[[^\]]+\]\([^)\s]+\)|\{\{fact:[a-z0-9_]+\}\}|`[^`]+`)"


def plain(text: Column, names: Column, depth: int = 3) -> Column:
    """A text without its marks: facts as ``names`` (a map of id and display) has them, else a dash; guides by label. Bold words
    and links may hold other marks; no mark can hold its own kind, so three levels are all there are."""
    tidy = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    text = F.coalesce(text, F.lit(""))
    if not depth:
        return tidy(text)

    def spelled(m: Column) -> Column:
        known = let(F.regexp_extract(m, FACT, 1), lambda k: F.coalesce(F.try_element_at(names, k), F.lit("—")))
        named = F.split(F.substring(m, F.lit(9), F.length(m) - 10), r"\|", -1)
        label = F.coalesce(F.get(named, F.lit(1)), F.lit(""))
        return (
            F.when(m.startswith("**"), plain(F.substring(m, F.lit(3), F.length(m) - 4), names, depth - 1)).when(m.startswith("`"), F.substring(m, F.lit(2), F.length(m) - 2)).when(m.startswith("{{fact:"), known)
            .when(m.startswith("[[guide:"), F.when(label != "", label).otherwise(F.get(named, F.lit(0)))).otherwise(plain(F.regexp_extract(m, r"^\[([^\]]+)\]", 1), names, depth - 1))
        )

    between = F.split(text, MARK, -1)
    marks = F.transform(F.regexp_extract_all(text, F.lit(MARK), F.lit(0)), spelled)
    return tidy(F.when(F.instr(text, "*") + F.instr(text, "[") + F.instr(text, "{") + F.instr(text, "`") == 0, text).otherwise(F.array_join(F.zip_with(between, marks, lambda x, m: F.concat(x, F.coalesce(m, F.lit("")))), "")))


def with_names(rows: DataFrame, facts: DataFrame, key: list[str], texts: Column) -> DataFrame:
    """``rows`` with ``names``: id and display of the facts (id, display) that their ``texts`` (an array) refer to, and of no others."""
    refs = rows.select(*key, F.explode(F.array_distinct(F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(FACT), F.lit(1)))))).alias("id"))
    maps = beside(refs, facts.select("id", "display"), "id").groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("id", "display"))).alias("names"))
    return rows.join(maps, key, "left").withColumn("names", F.coalesce("names", F.create_map().cast("map<string,string>")))


def _pieces(b: Column) -> Column:
    """What a block reads as: (lead, text) pieces, of which the texts hold marks."""
    piece = lambda text, lead=F.lit(""): F.struct(lead.cast("string").alias("lead"), text.cast("string").alias("text"))
    none = F.coalesce
    gap = lambda x: F.concat(none(x, F.lit("")), F.lit(" "))
    cells = F.concat(none(b["table"]["head"], F.array().cast("array<string>")), F.flatten(none(b["table"]["rows"], F.array().cast("array<array<string>>"))))
    return (
        F.when(none(b["p"], F.lit("")) != "", F.array(piece(b["p"]))).when(b["list"].isNotNull(), F.transform(b["list"], lambda x: piece(x)))
        .when(b["steps"].isNotNull(), F.transform(b["steps"], lambda s: piece(s["text"], F.concat(none(s["title"], F.lit("")), F.lit(". ")))))
        .when(b["callout"].isNotNull(), F.array(piece(b["callout"]["text"], gap(b["callout"]["title"])))).when(b["table"].isNotNull(), F.transform(cells, lambda x: piece(x)))
        .when(b["stats"].isNotNull(), F.transform(b["stats"], lambda s: piece(s["value"], gap(s["label"])))).otherwise(F.array(piece(F.lit(""))))
    )


def guide_index(guides: DataFrame, facts: DataFrame) -> DataFrame:
    """(entry, slug, section_id, title, kind, heading, text, keywords, faq): an entry for each question and each section of guides.

    ``entry`` numbers them in the order of guides (pos), sections and blocks, a section after its questions: it fits a long for
    up to a million sections of a guide and as many questions of a section. Facts that are cited in an entry come to it by a join.
    """
    words = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    secs = guides.select("slug", "pos", "title", "kind", words(F.col("keywords")).alias("keys"), F.posexplode("sections").alias("nth", "sec")).withColumn("_at", F.col("pos") * 1_000_000 + F.col("nth"))
    blocks = F.coalesce("sec.blocks", F.array().cast(f"array<{BLOCK}>"))
    asked = F.flatten(F.transform(F.filter(blocks, lambda b: b["faq"].isNotNull()), lambda b: b["faq"]))
    said = F.transform(F.filter(blocks, lambda b: b["faq"].isNull()), _pieces)
    one = lambda x: F.array(F.array(F.struct(F.lit("").alias("lead"), x["a"].alias("text"))))
    questions = F.transform(asked, lambda x: F.struct(x["q"].alias("heading"), one(x).alias("blocks"), F.array_join("keys", " ").alias("keywords"), F.lit(True).alias("faq")))
    section = F.array(F.struct(F.col("sec.heading").alias("heading"), said.alias("blocks"), F.array_join(F.concat("keys", words(F.col("sec.keywords"))), " ").alias("keywords"), F.lit(False).alias("faq")))
    rows = secs.select("slug", F.col("sec.id").alias("section_id"), "title", "kind", "_at", F.posexplode(F.concat(questions, section)).alias("_n", "e"))
    rows = rows.select((F.col("_at") * 1_000_000 + F.col("_n")).alias("entry"), "slug", "section_id", "title", "kind", "e.*")
    rows = with_names(rows, facts, ["entry"], F.transform(F.flatten("blocks"), lambda x: x["text"]))
    spell = lambda b: F.array_join(F.transform(b, lambda x: F.concat(F.coalesce(x["lead"], F.lit("")), plain(x["text"], F.col("names")))), " ")
    return rows.select("entry", "slug", "section_id", "title", "kind", F.coalesce("heading", F.lit("")).alias("heading"), F.array_join(F.transform("blocks", spell), " ").alias("text"), "keywords", "faq")


def broken_references(guides: DataFrame, facts: DataFrame, sources: DataFrame, fact_sources: DataFrame) -> DataFrame:
    """(slug, kind, target) of what guides refer to and what isn't there: fact and guide marks in any string, sources, related guides, and the facts and
    cited sources of blocks; and, with a null slug and kind unnamed, the sources that are shown and have no English title.

    ``sources`` has id, parent and title_en; shown are those that guides or blocks cite, that facts rest on (``fact_sources``: id, source), and roots.
    """
    whole = guides.select("slug", F.to_json(F.struct(*[c for c in guides.columns if c != "pos"])).alias("all"), "sources", "related", F.flatten(F.transform("sections", lambda s: F.coalesce(s["blocks"], F.array().cast(f"array<{BLOCK}>")))).alias("blocks"))
    marks = lambda p: F.regexp_extract_all("all", F.lit(p), F.lit(1))
    of = lambda c: F.flatten(F.transform("blocks", lambda b: F.coalesce(b[c], F.array().cast("array<string>"))))
    refs = lambda kind, col: whole.select("slug", F.lit(kind).alias("kind"), F.explode(F.array_distinct(col)).alias("target"))
    missing = lambda rows, there, c="id": skewed_join(rows, there.select(F.col(c).alias("target"), F.lit(True).alias("_there")).distinct(), "target", "left").filter("_there is null").drop("_there")
    cited = refs("source", F.col("sources")).unionByName(refs("cite", of("cite")))
    bad = missing(refs("fact", marks(FACT)).unionByName(refs("block fact", of("facts"))), facts)
    bad = bad.unionByName(missing(refs("guide", marks(LINKED)).unionByName(refs("related", F.col("related"))), guides, "slug"))
    bad = bad.unionByName(missing(cited, sources))
    shown = cited.select("target").unionByName(fact_sources.select(F.col("source").alias("target"))).unionByName(sources.filter("parent is null").select(F.col("id").alias("target"))).distinct()
    unnamed = shown.join(sources.filter("coalesce(title_en, '') = ''").select(F.col("id").alias("target")), "target")
    return bad.select("slug", "kind", "target").unionByName(unnamed.select(F.lit(None).cast("string").alias("slug"), F.lit("unnamed").alias("kind"), "target"))


META = ["title", "title_en", "publisher", "url"]


def fact_sources(facts: DataFrame, sources: DataFrame, more: list[str] | None = None) -> DataFrame:
    """(id, pos, source, there, columns of ``sources``): the different sources of each fact's evidence, in order, with their metadata;
    those that the index doesn't have stay, with nulls."""
    ev = facts.select("id", F.posexplode("evidence").alias("pos", "e")).groupBy("id", F.col("e.source").alias("source")).agg(F.min("pos").alias("pos"))
    meta = sources.select(F.col("id").alias("source"), *(more or META), F.lit(True).alias("there"))
    out = skewed_join(ev, meta, "source", "left")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    return out.withColumn("pos", nth).withColumn("there", F.coalesce("there", F.lit(False)))


def section_sources(guides: DataFrame, of_facts: DataFrame, sources: DataFrame, most: int = 5, fallback: int = 4) -> DataFrame:
    """(slug, section_id, nth, columns META): the official sources of each section: those of the facts that it refers to, then those that its
    blocks cite, one of each address, ``most`` at most; a section without any has the first ``fallback`` of its guide.

    ``of_facts`` has id, pos and source (``fact_sources``). Sources without an address don't count for a section.
    """
    secs = guides.select("slug", "sources", F.explode("sections").alias("sec")).select("slug", F.col("sec.id").alias("section_id"), "sources", F.to_json("sec").alias("all"), F.flatten(F.transform(F.coalesce("sec.blocks", F.array().cast(f"array<{BLOCK}>")), lambda b: F.coalesce(b["cite"], F.array().cast("array<string>")))).alias("cites"))
    key = ["slug", "section_id"]
    facts = secs.select(*key, F.posexplode(F.regexp_extract_all("all", F.lit(FACT), F.lit(1))).alias("a", "id"))
    own = beside(facts, of_facts.filter("source is not null").select("id", F.col("pos").alias("b"), "source"), "id").select(*key, F.struct(F.lit(0).alias("k"), "a", F.col("b").cast("int").alias("b")).alias("at"), "source")
    cited = secs.select(*key, F.posexplode("cites").alias("a", "source")).select(*key, F.struct(F.lit(1).alias("k"), "a", F.lit(0).alias("b")).alias("at"), "source")
    meta = sources.select(F.col("id").alias("source"), *META)
    both = beside(own.unionByName(cited), meta, "source").filter("coalesce(url, '') <> ''")
    both = both.groupBy(*key, "url").agg(F.min_by(F.struct(*META), "at").alias("m"), F.min("at").alias("at"))
    ranked = lambda rows, n: rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("at"))).filter(F.col("nth") <= n).select(*key, "nth", "m.*")
    found = ranked(both.drop("url"), most)
    bare = secs.join(found.select(*key).distinct(), key, "left_anti").select(*key, F.posexplode("sources").alias("at", "source"))
    rest = beside(bare, meta, "source").select(*key, "at", F.struct(*META).alias("m"))
    return found.unionByName(ranked(rest, fallback))
