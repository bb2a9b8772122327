"""Column expressions that turn what sources give into listing columns. Unknown stays null; nothing is guessed."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

TAIPEI = "+08:00"
DATE_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm", "yyyy/MM/dd", "yyyy.MM.dd", "yyyyMMdd"]
HAN = "[\u3400-\u9fff\uf900-\ufaff]"


def any_word(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def first_of(cases: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first condition that holds."""
    if not cases:
        return otherwise if otherwise is not None else F.lit(None)
    chain = reduce(lambda chain, case: chain.when(*case), cases[1:], F.when(*cases[0]))
    return chain if otherwise is None else chain.otherwise(otherwise)


def instant(iso: Column) -> Column:
    """The instant of an ISO string with an offset; null if it is none."""
    return F.when(iso.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d[+-]\d\d:\d\d$"), F.try_to_timestamp(iso))


def taipei_iso(value: Column, end_of_day: bool = False) -> Column:
    """An ISO string in Taipei time of a date or time in one of the usual spellings, with or without offset.

    Times without offset are Taipei's. ``end_of_day`` turns midnight into the day's last second, as written in the source.
    """
    zoned_end = r"T?\d\d:\d\d(:\d\d(\.\d+)?)?[+-]\d\d:?\d\d$"

    def shift(local: Column, s: Column) -> Column:
        zone = F.regexp_extract(s, r"([+-]\d\d:?\d\d)$", 1)
        sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
        off = sign * (F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, -2, 2).cast("int"))
        at = F.when(s.rlike(zoned_end), F.timestamp_seconds(F.unix_timestamp(local) + (480 - off) * 60)).otherwise(local)
        return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(TAIPEI))

    def read(s: Column) -> Column:
        bare = F.regexp_replace(F.when(s.rlike(zoned_end), F.regexp_replace(s, r"[+-]\d\d:?\d\d$", "")).otherwise(s), r"(:\d\d)\.\d+$", "$1")
        local = let(bare, lambda x: F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in DATE_FORMATS]))
        if end_of_day:
            local = let(local, lambda t: F.when(F.date_format(t, "HH:mm:ss") == "00:00:00", F.timestamp_seconds(F.unix_timestamp(t) + 86399)).otherwise(t))
        return let(local, lambda t: shift(t, s))

    s = F.regexp_replace(F.trim(value), "Z", "+00:00")
    return F.when(F.trim(value) != "", let(s, read))


def classify(title: Column, *texts: Column) -> Column:
    """The first type with a word in the title, else the first with a word in all texts, else ``other``."""
    blob = F.lower(F.concat_ws(" ", title, *texts))
    head = F.lower(F.coalesce(title, F.lit("")))
    tries = lambda b: first_of([(b.rlike(any_word(words)), F.lit(kind)) for kind, words in rules.TYPE_WORDS.items()])
    return F.coalesce(let(head, tries), let(blob, tries), F.lit("other"))


def language_tags(*texts: Column) -> Column:
    blob = F.lower(F.concat_ws(" ", *texts))
    return let(blob, lambda b: F.array_compact(F.array(*[F.when(b.rlike(any_word(words)), F.lit(f"lang:{code}")) for code, words in rules.LANGUAGE_WORDS.items()])))


def is_latin(title: Column) -> Column:
    """Whether a title is in Latin letters: none of them Han, at least 8 letters."""
    return F.coalesce(~title.rlike(HAN) & (F.regexp_count(title, F.lit("[A-Za-z]")) >= 8), F.lit(False))


def site_tags(tags: Column, title: Column, title_en: Column) -> Column:
    """The tags, and ``lang:en`` after them if it isn't there and the title is Latin or there is an English one."""
    english = is_latin(title) | F.coalesce(F.trim(title_en) != "", F.lit(False))
    return F.when(english & ~F.array_contains(tags, "lang:en"), F.concat(tags, F.array(F.lit("lang:en")))).otherwise(tags)


def city_of(district: Column, evidence: Column) -> Column:
    """The home city of a district; null if the name is shared and the evidence names another city."""
    other = evidence.rlike(any_word(rules.OTHER_CITIES)) | evidence.rlike(_other_city_en())
    return first_of([
        (district.isin(rules.SHARED_DISTRICTS) & other, F.lit(None).cast("string")), (district.isin(list(rules.TAIPEI)), F.lit("臺北市")),
        (district.isin(list(rules.NEW_TAIPEI)), F.lit("新北市")),
    ])


def _other_city_en() -> str:
    return rf"(?i)\b(?:{'|'.join(rules.OTHER_CITIES_EN)})\s+(?:City|County)\b"


def _home_token() -> str:
    return r"(?i)新北市|臺北市|台北市|New\s+Taipei(\s+City)?|Taipei\s+City"


def _district_en(name: str) -> str:
    gap = r"[\s.\-_'\u2018\u2019\u02bc]*"
    return rf"(?i)(?<![A-Za-z]){gap.join(name)}{gap}Dist(?:rict)?\b"


def parse_location(address: Column) -> Column:
    """struct(city, district) of an address: known districts, other ones by their ending, English ones, else the city alone."""
    named = F.regexp_extract(address, f"({any_word(rules.ALL_CITIES)})", 1)
    city = F.when(named != "", F.regexp_replace(named, "台", "臺"))
    known = first_of([(address.contains(d), F.lit(d)) for d in [*rules.TAIPEI, *rules.NEW_TAIPEI]])
    rest = F.regexp_replace(F.regexp_replace(address, "(?i)台灣|臺灣|Taiwan", ""), any_word(rules.ALL_CITIES), "")
    fits = lambda d: ~d.isin(rules.NO_DISTRICTS) & ~d.rlike(f"({any_word(rules.NO_DISTRICT_ENDS)})$")
    general = F.get(F.filter(F.regexp_extract_all(rest, F.lit("([一-鿿]{2,3}區)"), 1), fits), F.lit(0))
    # each English pattern ends in "Dist", so other addresses need none of them
    english = F.when(address.rlike("(?i)dist"), first_of([(address.rlike(_district_en(en)), F.lit(zh)) for zh, en in [*rules.TAIPEI.items(), *rules.NEW_TAIPEI.items(), *[(z, e) for e, z in rules.SECOND_NAMES.items()]]]))
    token = F.regexp_extract(address, f"({_home_token()})", 1)
    alone = F.when(token != "", F.when(token.rlike("(?i)^(新北|New)"), F.lit("新北市")).otherwise(F.lit("臺北市")))
    some = F.coalesce(address != "", F.lit(False))

    def both(district: Column) -> Column:
        found = F.coalesce(city, F.when(district.isNotNull(), city_of(district, address)).otherwise(alone))
        return F.struct(F.when(some, found).alias("city"), F.when(some, district).alias("district"))

    return let(F.coalesce(known, general, english), both)


def outside_area(city: Column, address: Column) -> Column:
    """Whether a listing is clearly elsewhere: another city, or an address that names another city or country."""
    text = F.coalesce(address, F.lit(""))
    en = "|".join(rules.COUNTRIES_EN)
    foreign = rf"^\s*(?:{'|'.join(rules.COUNTRIES)})|^\s*(?:{en})(?=[A-ZÀ-￿,]|\s*$)|,\s*(?:{en})\s*$"
    away = text.rlike(_other_city_en()) | text.rlike(any_word(rules.OTHER_CITIES)) | text.rlike(foreign)
    return first_of([(city.isin(rules.HOME_CITIES), F.lit(False)), (F.coalesce(city, F.lit("")) != "", F.lit(True)), ((text == "") | text.rlike(_home_token()), F.lit(False))], away)


def _plain(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[\s.\-_,'\u2018\u2019\u02bc]+", ""))


def place_lookup(venue: Column) -> Column:
    """struct(city, district) of a venue's name: a city elsewhere that it names, the first known place in it, its city."""
    here = ["臺北市", "台北市", "新北市"]

    def of(plain: Column) -> Column:
        cases = [(venue.contains(c), c.replace("台", "臺"), None) for c in rules.PLACE_CITIES if c not in here]
        cases += [(plain.contains(re.sub(r"[\s.\-_,']+", "", name).lower()), city, district) for name, city, district in rules.PLACES]
        cases += [(venue.contains(c), c.replace("台", "臺"), None) for c in here]
        place = lambda city, district: F.struct(F.lit(city).cast("string").alias("city"), F.lit(district).cast("string").alias("district"))
        return first_of([(c, place(x, d)) for c, x, d in cases], place(None, None))

    return let(_plain(venue), of)


def clean_venue(venue: Column) -> Column:
    """One place name out of a venue field, or null: no links or directions, no label, not a description."""
    v = F.trim(venue)
    bare = F.trim(F.regexp_replace(v, rf"(?i)^(?:{'|'.join(rules.VENUE_LABELS)})\s*[:：]\s*", ""))
    head = F.trim(F.get(F.split(bare, "[：:；;。]", 2), F.lit(0)))
    return first_of([
        ((v == "") | v.rlike("(?i)^https?://") | v.rlike(rf"^(?:{'|'.join(rules.VENUE_DIRECTIONS)})\s*[:：]"), F.lit(None).cast("string")),
        (F.length(bare) <= rules.VENUE_LONG, F.nullif(bare, F.lit(""))),
        ((head != bare) & F.length(head).between(2, rules.VENUE_LONG), head), (F.length(bare) <= rules.VENUE_LONGEST, bare),
    ])


def detect_free(*texts: Column) -> Column:
    """True if a text says free, false if it names a price, else null."""
    blob = F.lower(F.concat_ws(" ", *texts))
    return let(blob, lambda b: F.when(b.rlike(any_word(rules.FREE_WORDS)), F.lit(True)).when(b.rlike(any_word(rules.PAID_WORDS)), F.lit(False)))


def strip_html(text: Column, limit: int = 500) -> Column:
    return F.nullif(F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"(?U)\s+", " ")), 1, limit), F.lit(""))


def uid(platform: Column, source_id: Column) -> Column:
    return F.concat(platform, F.lit(":"), source_id)


def title_key(title: Column) -> Column:
    """A title without case, spaces and punctuation."""
    return F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def dedup_key(title: Column, starts_at: Column) -> Column:
    return F.concat(F.substring(title_key(title), 1, 40), F.lit("|"), F.substring(F.coalesce(starts_at, F.lit("")), 1, 10))


HASHED = ["title", "type", "starts_at", "ends_at", "signup_deadline", "venue", "address", "city", "district", "price_text", "status"]


def content_hash(columns: list[str] = HASHED) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in columns]).cast("binary")), 1, 16)


def problems() -> Column:
    """What is wrong with a listing row; an empty array if nothing is."""
    iso = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[+-]\d{2}:\d{2}$"
    empty = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    tests = [
        (empty("source_platform") | empty("source_id"), "no source_platform or source_id"), (empty("title"), "no title"), (empty("source_url"), "no source_url"),
        (~F.coalesce(F.col("type").isin(rules.TYPES), F.lit(False)), "unknown type"), (~F.coalesce(F.col("status").isin(rules.STATUSES), F.lit(False)), "unknown status"),
        *[(~F.coalesce(F.col(c).rlike(iso), F.lit(True)), f"{c} isn't ISO 8601 with an offset") for c in ("starts_at", "ends_at", "signup_deadline")],
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(what)) for bad, what in tests]))


def price_label() -> Column:
    text = F.nullif(F.col("price_text"), F.lit(""))
    free = F.coalesce(F.col("is_free"), F.lit(False)) | F.coalesce(text.rlike("(?i)^(免費|free)$"), F.lit(False))
    return first_of([(free, F.lit("Free")), (F.col("is_free").isNotNull(), F.coalesce(text, F.lit("Paid")))], F.coalesce(text, F.lit("Price not listed")))


def named(key: Column, names: dict[str, str]) -> Column:
    return first_of([(key == k, F.lit(v)) for k, v in names.items()], key)


def area_label(district: Column, city: Column) -> Column:
    names = {**rules.TAIPEI, **rules.NEW_TAIPEI, "大安區": "Da'an"}
    return F.nullif(F.concat_ws(", ", named(F.nullif(district, F.lit("")), names), named(F.nullif(city, F.lit("")), rules.CITY_NAMES)), F.lit(""))


def where_label() -> Column:
    place = F.coalesce(F.nullif("venue", F.lit("")), F.nullif("address", F.lit("")))
    parts = F.concat_ws(" · ", place, area_label(F.col("district"), F.col("city")))
    return F.when(F.array_contains("tags", "online"), F.lit("Online")).when(parts != "", parts).otherwise(F.lit("Location not listed"))


def safe_url(url: Column) -> Column:
    return F.when(F.trim(url).rlike("(?i)^https?://"), F.trim(url))


def when_label() -> Column:
    """The start as "Sat 5 Aug · 14:00" in Taipei time; midnight is a date without a time."""
    local = F.to_timestamp(F.substring("starts_at", 1, 19), "yyyy-MM-dd'T'HH:mm:ss")
    time = F.when(F.date_format(local, "HH:mm") != "00:00", F.date_format(local, " · HH:mm")).otherwise(F.lit(""))
    return F.coalesce(F.concat(F.date_format(local, "EEE d MMM"), time), F.lit("Date not listed"))


def languages(tags: Column) -> Column:
    code = lambda t: named(F.substring(t, 6, 100), rules.LANGUAGE_NAMES)
    return F.transform(F.filter(tags, lambda t: t.startswith("lang:")), code)


def found_updated(text: Column) -> Column:
    """The date that a page gives as its own last change; years before 1911 are ROC years, impossible dates are null."""
    roc = r"(?:更新日期|修改日期|發布日期|發佈日期|公告日期|資料更新|最後更新)\s*[：:]?\s*(\d{2,4})\s*[-./年]\s*(\d{1,2})\s*[-./月]\s*(\d{1,2})"
    en = r"(?i)(?:Last updated|Updated|Post published|Published)\s*[：:]?\s*(\d{4})\s*[-./年]\s*(\d{1,2})\s*[-./月]\s*(\d{1,2})"

    def date(pattern: str) -> Column:
        y, m, d = (F.regexp_extract(text, pattern, i).try_cast("int") for i in (1, 2, 3))
        y = F.when(y < 1911, y + 1911).otherwise(y)
        return F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")).try_cast("date")

    return F.coalesce(date(roc), date(en))
