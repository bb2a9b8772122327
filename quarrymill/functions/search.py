"""Search phrases to conditions, and token search, for tables of phrases and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalize import first_of, let

#: Phrases for times, in the order in which they are tried; words without meaning for a search; synonyms.
WHEN = [
    (r"\b(tonight)\b|今晚", "tonight"), (r"\b(today)\b|今天", "today"), (r"\b(tomorrow)\b|明天", "tomorrow"), (r"\bnext weekend\b|下週末|下周末", "nextWeekend"),
    (r"\b(this )?weekend\b|週末|周末", "weekend"), (r"\bnext week\b|下週|下周", "nextWeek"), (r"\bthis week\b|這週|本週|這周|本周", "week"),
    (r"\bthis month\b|這個月|本月", "month"),
]
STOP = [
    "events", "event", "in", "at", "the", "a", "an", "for", "and", "with", "near", "things", "thing", "to", "do", "what", "whats", "what's", "where", "how", "is",
    "are", "i", "my", "me", "find", "show", "any", "some", "of", "on", "about", "can", "should", "does", "need", "活動", "的", "有", "什麼", "哪裡", "嗎", "please",
    "taiwan",
]
SYNONYMS = {
    "183": ["183", "resident", "residency", "days"], "resident": ["resident", "residency", "183"], "residency": ["residency", "resident", "183", "days"],
    "days": ["days", "183", "arrival", "departure"], "refund": ["refund", "refunds", "退稅"],
    "gold card": ["gold card", "special professional", "就業金卡", "incentive"], "gold": ["gold card"], "rsu": ["rsu", "stock", "shares", "equity", "esop"],
    "esop": ["esop", "stock", "shares", "rsu"], "stock": ["stock", "shares", "rsu"], "withholding": ["withholding", "withheld", "18%", "6%", "扣繳"],
    "withheld": ["withheld", "withholding"], "deadline": ["deadline", "filing period", "may", "june"], "file": ["file", "filing", "return"],
    "filing": ["filing", "file", "return"], "leave": ["leave", "leaving", "departure", "離境"], "leaving": ["leaving", "departure", "leave"],
    "overseas": ["overseas", "foreign income", "basic income", "amt"], "amt": ["basic income tax", "amt", "minimum tax"], "rent": ["rent", "rental"],
    "children": ["children", "child", "dependent", "dependents"], "kids": ["children", "child", "dependent"], "dependents": ["dependent", "dependents", "exemption"],
    "penalty": ["penalty", "penalties", "late", "fine"], "rate": ["rate", "rates", "bracket", "progressive"], "rates": ["rate", "rates", "bracket"],
    "bracket": ["bracket", "brackets", "rate", "progressive"], "freelance": ["professional fees", "freelance", "contractor"],
    "spouse": ["spouse", "married", "joint"], "married": ["married", "spouse", "joint"], "salary": ["salary", "wage"], "報稅": ["file", "filing", "報稅", "申報"],
    "退稅": ["refund", "退稅"], "金卡": ["gold card", "就業金卡"], "扣繳": ["withholding", "扣繳"],
}
FREE, ENGLISH, IN_PERSON = r"\bfree\b|免費", r"\benglish(-| )?(friendly|speaking)?\b|英文|英語", r"\bin[- ]person\b|\boffline\b|實體"
NEW_TAIPEI, TAIPEI = r"\bnew taipei( city)?\b|新北市?", r"\btaipei( city)?\b|臺北市|台北市|台北|臺北"
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
TAX_WORDS = [
    "tax", "taxes", "183", "resident", "residency", "refund", "withholding", "withheld", "gold card", "rsu", "esop", "stock", "deduction", "deductions",
    "exemption", "bracket", "brackets", "filing", "file", "return", "amt", "overseas income", "salary", "income", "nhi", "departure", "leaving", "稅", "報稅",
    "退稅", "扣繳", "居留", "金卡", "所得", "申報", "免稅", "扣除",
]
#: Words that name a topic or sub-topic, in the order in which they are tried.
TOPIC_WORDS = [
    (["hiking", "hike", "trail", "登山", "健行", "爬山"], "outdoors", "hiking"), (["climbing", "bouldering", "攀岩", "抱石"], "outdoors", "climbing"),
    (["diving", "kayak", "潛水", "溯溪", "獨木舟"], "outdoors", "water"), (["outdoor", "outdoors", "戶外"], "outdoors", None),
    (["running", "yoga", "fitness", "sport", "sports", "運動", "路跑", "瑜伽"], "outdoors", "fitness"),
    (["language exchange", "language", "exchange", "語言交換", "語言交流"], "social", "exchange"),
    (["networking", "social", "meetup", "meet people", "friends", "交朋友", "社交"], "social", None), (["jazz", "爵士"], "music", "jazz"),
    (["concert", "classical", "音樂會"], "music", "classical"), (["music", "live", "gig", "band", "音樂", "演唱"], "music", None),
    (["exhibition", "exhibitions", "museum", "gallery", "art", "展覽", "美術館"], "arts", "exhibitions"), (["festival", "festivals", "節慶"], "arts", "festivals"),
    (["market", "markets", "flea", "市集"], "markets", "markets"), (["coffee", "tea", "咖啡", "手沖"], "markets", "coffee"),
    (["food", "dinner", "wine", "tasting", "brunch", "美食", "品酒"], "markets", "food"), (["workshop", "workshops", "工作坊"], "talks", "workshops"),
    (["talk", "talks", "lecture", "seminar", "講座"], "talks", "talks"),
]
#: Between a letter, digit or line of ASCII and anything else: phrases mix scripts without spaces.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
PUNCTUATION = "[?!.,，。？！]"


def edged(pattern: str) -> str:
    return pattern.replace(r"\b", EDGE)


def word(w: str) -> str:
    """The pattern that finds a word: as a whole word if it is of ASCII, else anywhere."""
    return f"{EDGE}{w}{EDGE}" if w.isascii() else w


def month_pattern() -> str:
    """A month's name; that of May, which is a verb as well, only after "in" or beside a day."""
    names = "|".join(m for m in MONTHS if m != "may")
    return edged(rf"\b(in )?({names})\b|\bin may\b|\bmay \d{{1,2}}\b|\b\d{{1,2}} may\b")


def taken(q: Column, pattern: str) -> Column:
    """The first match of the pattern in ``q``, else the empty string."""
    return F.regexp_extract(q, f"({pattern})", 1)


def once(q: Column, pattern: str) -> Column:
    """``q`` with the first match of the pattern blanked."""
    at = F.regexp_instr(q, F.lit(pattern))
    hit = taken(q, pattern)
    return F.when(at > 0, F.concat(F.substring(q, F.lit(1), at - 1), F.lit(" "), F.substring(q, at + F.length(hit), F.lit(1 << 20)))).otherwise(q)


def kept_words(q: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(q, PUNCTUATION, " "), r"\s+", " ")), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(STOP))


def parse_queries(queries: DataFrame, raw: str = "raw", topics: bool = True) -> DataFrame:
    """``queries`` with what each phrase asks for: when_key (a window's name or month:<name>), free, english, in_person, city, tax, topic, sub,
    tokens (the words that are left), guide_tokens (all words that mean something) and chips (key and the letters taken).

    A phrase is scanned for one kind of condition after the other, and what is found is taken out of it. A phrase about taxes has
    no topic; without ``topics`` none has, and topic words stay tokens.
    """
    rows = queries.withColumn("_q", F.concat(F.lit(" "), F.lower(F.trim(F.coalesce(raw, F.lit("")))), F.lit(" ")))
    chips: list[tuple[str, str]] = []

    def take(rows: DataFrame, key: str, pattern: Column | str) -> DataFrame:
        chips.append((key, f"_raw_{key}"))
        cases = pattern if isinstance(pattern, list) else [(F.col("_q").rlike(pattern), pattern)]
        found = first_of([(when, taken(F.col("_q"), p)) for when, p in cases])
        rows = rows.withColumn(f"_raw_{key}", found)
        return rows.withColumn("_q", first_of([(when, once(F.col("_q"), p)) for when, p in cases], F.col("_q")))

    month = month_pattern()
    keys = [(F.col("_q").rlike(edged(p)), F.lit(k)) for p, k in WHEN]
    names = first_of([(taken(F.col("_q"), month).contains(m), F.lit(f"month:{m}")) for m in MONTHS])
    rows = rows.withColumn("when_key", first_of([*keys, (F.col("_q").rlike(month), names)]))
    rows = take(rows, "when", [*[(F.col("when_key") == k, edged(p)) for p, k in WHEN], (F.col("when_key").startswith("month:"), month)])
    for name, key, pattern in (("free", "free", FREE), ("english", "english", ENGLISH), ("in_person", "inPerson", IN_PERSON)):
        rows = take(rows.withColumn(name, F.col("_q").rlike(edged(pattern))), key, edged(pattern))
    rows = rows.withColumn("city", F.when(F.col("_q").rlike(edged(NEW_TAIPEI)), F.lit("新北市")))
    rows = take(rows, "city", edged(NEW_TAIPEI))
    rows = rows.withColumn("_q", F.when(F.col("city").isNull(), F.regexp_replace("_q", edged(TAIPEI), " ")).otherwise(F.col("_q")))
    rows = rows.withColumn("tax", F.col("_q").rlike("|".join(word(w) for w in TAX_WORDS)))
    hit = first_of([(F.col("_q").rlike(word(w)), F.struct(F.lit(t).alias("topic"), F.lit(s).cast("string").alias("sub"), F.lit(w).alias("word"))) for ws, t, s in TOPIC_WORDS for w in ws])
    rows = rows.withColumn("_topic", F.when(~F.col("tax") & F.lit(topics), hit))
    at = F.expr("locate(_topic.word, _q)")
    left = F.concat(F.substring(F.col("_q"), F.lit(1), at - 1), F.lit(" "), F.substring(F.col("_q"), at + F.length("_topic.word"), F.lit(1 << 20)))
    rows = rows.withColumn("_q", F.when(F.col("_topic").isNotNull(), left).otherwise(F.col("_q")))
    made = [F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("key"), F.trim(c).alias("raw"))) for k, c in chips]
    made.append(F.when(F.col("_topic").isNotNull(), F.struct(F.lit("topic").alias("key"), F.col("_topic.word").alias("raw"))))
    rows = rows.withColumn("chips", F.array_compact(F.array(*made))).withColumn("topic", F.col("_topic.topic")).withColumn("sub", F.col("_topic.sub"))
    rows = rows.withColumn("tokens", kept_words(F.col("_q"))).withColumn("guide_tokens", kept_words(F.lower(F.coalesce(raw, F.lit("")))))
    return rows.drop("_q", "_topic", *[c for _, c in chips])


def without_chip(raw: Column, chips: Column, key: str) -> Column:
    """The phrase without the letters that a condition was found in; as it is, if there is none of that key."""
    phrase = F.trim(raw)
    chip = F.get(F.filter(chips, lambda c: (c["key"] == key) & (c["raw"] != "")), F.lit(0))["raw"]
    at = F.position(F.lower(chip), F.lower(phrase))
    rest = F.concat(F.substring(phrase, F.lit(1), at - 1), F.lit(" "), F.substring(phrase, at + F.length(chip), F.lit(1 << 20)))
    return F.when(chip.isNull(), phrase).otherwise(F.trim(F.regexp_replace(F.when(at > 0, rest).otherwise(phrase), r"\s+", " ")))


def expand(tokens: Column) -> Column:
    """The tokens with their synonyms before them; a key of several words is looked for in the joined text."""
    joined = F.array_join(tokens, " ")
    none = F.array().cast("array<string>")
    more = [F.when(joined.contains(k) if " " in k else F.array_contains(tokens, k), F.array(*[F.lit(v) for v in vs])).otherwise(none) for k, vs in SYNONYMS.items()]
    return F.array_distinct(F.concat(*more, tokens))


def hits(blob: Column, title: Column, tokens: Column) -> Column:
    """2 if every token is in the blob and one in the title, 1 if only the former, else null."""
    return F.when(F.forall(tokens, lambda t: blob.contains(t)), F.when(F.exists(tokens, lambda t: title.contains(t)), 2).otherwise(1))


def capped(hay: Column, token: Column, most: int = 3) -> Column:
    """How often a token stands in a text without overlap, at most ``most``."""
    return F.least(F.lit(most), ((F.length(hay) - F.length(F.replace(hay, token, F.lit("")))) / F.length(token)).cast("int"))


def counted(hay: Column, token: Column, most: int = 3) -> Column:
    """What ``capped`` is for a text and a token that are not null or empty: the text is read up to that place only."""
    step = lambda a, p: F.struct(F.when(p > 0, p + F.length(token)).otherwise(F.lit(0)).alias("at"), (a["n"] + (p > 0).cast("int")).alias("n"))
    found = lambda a: let(F.when(a["at"] > 0, F.position(token, hay, a["at"])).otherwise(F.lit(0)), lambda p: step(a, p))
    return F.aggregate(F.array_repeat(F.lit(0), most), F.struct(F.lit(1).alias("at"), F.lit(0).alias("n")), lambda a, _: found(a), lambda a: a["n"])


def section_score(heading: Column, title: Column, keywords: Column, text: Column, faq: Column, tokens: Column) -> Column:
    """Weighted capped counts over the tokens, more for more different ones, a little more for a question."""
    one = lambda t: capped(heading, t) * 4 + capped(title, t) * 1.5 + capped(keywords, t) * 2 + capped(text, t)
    scores = F.transform(tokens, lambda t: one(t).cast("double"))
    total = F.aggregate(scores, F.lit(0.0), lambda a, b: a + b)
    found = F.size(F.filter(scores, lambda s: s > 0))
    return total * (1 + found / F.size(tokens)) * F.when(faq, 1.1).otherwise(1.0)


def snippet(text: Column, tokens: Column, radius: int = 110) -> Column:
    at = let(F.lower(text), lambda low: F.array_min(F.filter(F.transform(tokens, lambda t: F.when(low.contains(t), F.position(t, low))), lambda p: p > 0))) - 1
    start = F.greatest(F.lit(0), at - radius)
    end = F.least(F.length(text), at + radius)
    dots = lambda c: F.when(c, F.lit("…")).otherwise(F.lit(""))
    inside = F.concat(dots(start > 0), F.trim(F.substring(text, start + 1, end - start)), dots(end < F.length(text)))
    return F.when(at.isNull(), F.concat(F.substring(text, 1, 2 * radius), dots(F.length(text) > 2 * radius))).otherwise(inside)
