"""Feeds to listings: schema.org markup in pages, and the payloads of the sources that are known."""

from __future__ import annotations

import html as html_lib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import rules

BLOCK = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"


def jsonld_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``block`` (variant), a row for each JSON-LD block; blocks that aren't JSON are dropped."""
    # parsed within the generator, which filters don't pass: else each filter on the block would parse it again
    return pages.withColumn("block", F.explode_outer(F.transform(F.regexp_extract_all(html, F.lit(BLOCK), 1), lambda x: F.try_parse_json(F.trim(x))))).filter("block is not null")


def _is_event(kind) -> bool:
    return any(isinstance(x, str) and x.endswith("Event") for x in (kind if isinstance(kind, list) else [kind]))


def events_in(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``pos`` and ``node`` (JSON text): every Event node at any depth of arrays and @graph, in order."""

    @F.pandas_udf("array<string>")
    def nodes(texts):
        def walk(x):
            if isinstance(x, list):
                for y in x:
                    yield from walk(y)
            elif isinstance(x, dict):
                if _is_event(x.get("@type")):
                    yield json.dumps(x, ensure_ascii=False)
                yield from walk(x.get("@graph", []))

        return texts.map(lambda t: list(walk(json.loads(t))))

    return blocks.select("*", F.posexplode(nodes(F.to_json("block"))).alias("pos", "node"))


def listed_events(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``pos`` and ``node`` (variant): the Events of ItemLists, wrapped in a ListItem or bare."""
    lists = blocks.filter(F.try_variant_get("block", "$['@type']", "string") == "ItemList")
    node = lambda x: F.coalesce(F.try_variant_get(x, "$.item", "variant"), x)
    items = lists.select("*", F.posexplode_outer(F.transform(F.try_variant_get("block", "$.itemListElement", "array<variant>"), node)).alias("pos", "node"))
    return items.filter(F.try_variant_get("node", "$['@type']", "string").endswith("Event"))


def _text(node: str, path: str) -> Column:
    """A field that may be text, an object with a name, text or id, or a list of such."""
    get = lambda p: F.nullif(F.trim(F.try_variant_get(node, p, "string")), F.lit(""))
    plain = F.when(F.schema_of_variant(F.try_variant_get(node, path, "variant")) == "STRING", get(path))
    first = F.when(F.schema_of_variant(F.try_variant_get(node, f"{path}[0]", "variant")) == "STRING", get(f"{path}[0]"))
    return F.coalesce(plain, get(f"{path}.name"), get(f"{path}.text"), get(f"{path}['@id']"), first, get(f"{path}[0].name"))


def _address(node: str) -> Column:
    at = "$.location.address"
    part = lambda k: F.nullif(F.trim(F.try_variant_get(node, f"{at}.{k}", "string")), F.lit(""))
    street, town, code = part("streetAddress"), part("addressLocality"), part("postalCode")
    town = F.when(~F.coalesce(street.contains(town), F.lit(False)), town)
    code = F.when(~F.coalesce(street.contains(code), F.lit(False)) & ~F.coalesce(town.contains(code), F.lit(False)), code)
    return F.coalesce(F.nullif(F.concat_ws(", ", street, town, code), F.lit("")), _text(node, at))


def from_jsonld(nodes: DataFrame, platform: str, node: str = "node") -> DataFrame:
    """Listings of schema.org Event nodes (variant) with source_id and source_url; nodes without a name are dropped."""
    get = lambda p: F.try_variant_get(node, p, "string")
    offers = F.coalesce(F.try_variant_get(node, "$.offers", "array<variant>"), F.array_compact(F.array(F.try_variant_get(node, "$.offers", "variant"))))
    price = lambda o: F.coalesce(F.try_variant_get(o, "$.price", "double"), F.try_variant_get(o, "$.lowPrice", "double"))
    rows = nodes.select(
        "*", _text(node, "$.name").alias("title"), N.strip_html(_text(node, "$.description")).alias("description"), N.clean_venue(_text(node, "$.location.name")).alias("venue"),
        _address(node).alias("address"), F.coalesce(_text(node, "$.organizer"), _text(node, "$.performer")).alias("organizer"), N.taipei_iso(get("$.startDate")).alias("starts_at"),
        N.taipei_iso(get("$.endDate"), end_of_day=True).alias("ends_at"), F.element_at(F.split(get("$.eventStatus"), "/"), -1).alias("_status"),
        F.coalesce(get("$.eventAttendanceMode").endswith("OnlineEventAttendanceMode"), F.lit(False)).alias("_online"), F.array_compact(F.transform(offers, price)).alias("_prices"),
        F.coalesce(F.try_variant_get(F.get(offers, F.lit(0)), "$.priceCurrency", "string"), F.lit("TWD")).alias("_cur"),
        F.try_variant_get(node, "$.location.geo.latitude", "double").alias("lat"), F.try_variant_get(node, "$.location.geo.longitude", "double").alias("lon"),
    ).filter("title is not null")
    rows = rows.withColumn("_p", N.parse_location(F.col("address"))).withColumn("_v", N.place_lookup(F.col("venue")))
    use = F.col("_p.district").isNull() & F.col("_v.district").isNotNull()
    low, high = F.array_min("_prices"), F.array_max("_prices")
    num = lambda x: F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
    text = F.when(low.isNotNull(), F.concat("_cur", F.lit(" "), num(low), F.when(low < high, F.concat(F.lit("–"), num(high))).otherwise("")))
    tags = F.concat(N.language_tags(F.col("title"), F.col("description")), F.when(F.col("_online"), F.array(F.lit("online"))).otherwise(F.array().cast("array<string>")))
    return rows.select(
        F.lit(platform).alias("source_platform"), "source_id", "source_url", "title", "description", "organizer", tags.alias("tags"), N.classify(F.col("title"), F.col("description")).alias("type"), "starts_at", "ends_at", "venue",
        "address", F.when(use, F.col("_v.district")).otherwise(F.col("_p.district")).alias("district"), F.when(use, F.col("_v.city")).otherwise(F.coalesce("_p.city", "_v.city")).alias("city"), "lat", "lon",
        F.coalesce(low == 0, N.detect_free(F.col("title"), F.col("description"))).alias("is_free"), text.alias("price_text"),
        F.coalesce(N.first_of([(F.col("_status") == k, F.lit(v)) for k, v in rules.SCHEMA_STATUS.items()]), F.lit("upcoming")).alias("status"),
    )


def _trimmed(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


#: The fields of each source's rows, as they are spelt there.
TOURISM = "struct<id:string,title:string,description:string,begin:string,end:string,url:string,distric:string,address:string,organizer:string,co_rganizer:string,ticket:string,is_major:boolean,links:array<struct<src:string>>>"
TRENDY = "struct<id:string,title:string,categoryName:string,location:string,startDate:string,endDate:string,content:string,departmentName:string,officeName:string>"
TALENT = "struct<slug:string,title:struct<en:string,zh:string>,contents:struct<en:string,zh:string>,date:string,start_time:string,end_time:string,location:struct<en:string,zh:string>,format:string,fee:string,organiser:struct<en:string>>"
TRENDY_TYPES = {"演唱會經濟": "music", "城市行動": "festival", "產業趨勢": "talk"}
TOURISM_PAGE = "https://www.travel.taipei/en/event-calendar"


def from_tourism(rows: DataFrame, endpoint: str) -> DataFrame:
    rows = rows.filter("trim(coalesce(id, '')) <> '' and trim(coalesce(title, '')) <> ''")
    rows = rows.withColumn("title", F.trim("title")).withColumn("description", N.strip_html(F.col("description"))).withColumn("ticket", N.strip_html(F.col("ticket"), 200)).withColumn("_p", N.parse_location(F.col("address")))
    major = F.when(F.coalesce("is_major", F.lit(False)), F.array(F.lit("major"))).otherwise(F.array().cast("array<string>"))
    url = F.coalesce(_trimmed("url"), F.nullif(F.trim(F.get("links", F.lit(0))["src"]), F.lit("")), F.lit(TOURISM_PAGE))
    return rows.select(
        F.lit("travel_taipei").alias("source_platform"), F.concat(F.lit(f"{endpoint.lower()}-"), F.trim("id")).alias("source_id"), url.alias("source_url"), "title", N.classify(F.col("title"), F.col("description")).alias("type"), "description",
        F.coalesce(F.nullif("organizer", F.lit("")), F.nullif("co_rganizer", F.lit(""))).alias("organizer"), F.concat(F.array(F.lit(f"src:{endpoint.lower()}")), N.language_tags(F.col("title"), F.col("description")), major).alias("tags"),
        N.taipei_iso(F.col("begin")).alias("starts_at"), N.taipei_iso(F.col("end"), end_of_day=True).alias("ends_at"), F.nullif("address", F.lit("")).alias("address"), F.coalesce(_trimmed("distric"), "_p.district").alias("district"),
        F.coalesce("_p.city", F.lit("臺北市")).alias("city"), N.detect_free(F.col("ticket"), F.col("title")).alias("is_free"), F.col("ticket").alias("price_text"),
    )


def from_trendy(rows: DataFrame) -> DataFrame:
    rows = rows.filter("trim(coalesce(id, '')) <> '' and trim(coalesce(title, '')) <> ''").withColumn("title", F.trim("title")).withColumn("content", N.strip_html(F.col("content")))
    rows = rows.withColumn("location", _trimmed("location")).withColumn("category", _trimmed("categoryName")).withColumn("_p", N.parse_location(F.col("location")))
    known = N.first_of([(F.col("category") == k, F.lit(v)) for k, v in TRENDY_TYPES.items()])
    return rows.select(
        F.lit("trendy_taipei").alias("source_platform"), F.trim("id").alias("source_id"), F.concat(F.lit("https://trendy.taipei/tw/Event/Detail?id="), F.trim("id")).alias("source_url"), "title",
        F.coalesce(known, N.classify(F.col("title"), F.col("content"))).alias("type"), F.col("content").alias("description"), F.coalesce(F.nullif("departmentName", F.lit("")), F.nullif("officeName", F.lit(""))).alias("organizer"),
        F.when(F.col("category").isNotNull(), F.array(F.concat(F.lit("cat:"), "category"))).otherwise(F.array().cast("array<string>")).alias("tags"), N.taipei_iso(F.col("startDate")).alias("starts_at"), N.taipei_iso(F.col("endDate"), end_of_day=True).alias("ends_at"),
        F.trim(F.split("location", "（")[0]).alias("venue"), F.col("location").alias("address"), F.col("_p.district").alias("district"), F.coalesce("_p.city", F.lit("臺北市")).alias("city"), N.detect_free(F.col("title"), F.col("content")).alias("is_free"),
    )


def from_talent(rows: DataFrame) -> DataFrame:
    """Rows in another city are dropped unless online; a name of Taipei in title or place is enough for the city."""
    en, zh, loc_en, loc_zh = (F.coalesce(F.trim(c), F.lit("")) for c in ("title.en", "title.zh", "location.en", "location.zh"))
    rows = rows.select("*", en.alias("en"), zh.alias("zh"), loc_en.alias("loc_en"), loc_zh.alias("loc_zh")).filter("trim(coalesce(slug, '')) <> '' and (en <> '' or zh <> '')")
    online = (F.lower(F.coalesce("format", F.lit(""))) == "online") | (F.lower("loc_en") == "online")
    where = F.concat_ws(" ", "en", F.nullif("loc_en", F.lit("")), F.nullif("loc_zh", F.lit("")))
    others = "(?i)\\b(" + "|".join(rules.OTHER_CITIES_EN) + ")\\b|" + N.any_word(sorted({c[:2] for c in rules.OTHER_CITIES}))
    rows = rows.withColumn("online", online).withColumn("where", where).filter(F.col("online") | ~F.col("where").rlike(others))
    rows = rows.withColumn("_p", N.parse_location(F.coalesce(F.nullif("loc_zh", F.lit("")), F.col("loc_en")))).withColumn("description", N.strip_html(F.coalesce(F.nullif("contents.en", F.lit("")), F.col("contents.zh"))))
    city = F.coalesce("_p.city", F.when(~F.col("online") & F.col("where").rlike(r"\bTaipei\b|臺北|台北"), F.lit("臺北市")))
    at = lambda t: N.taipei_iso(F.concat_ws(" ", "date", t))
    extra = F.array_compact(F.array(F.lit("audience:foreign-professionals"), F.when(F.col("online"), F.lit("online"))))
    tags = F.concat(extra, F.array_distinct(F.concat(N.language_tags(F.col("en"), F.col("zh")), F.when(F.col("en") != "", F.array(F.lit("lang:en"))).otherwise(F.array().cast("array<string>")))), F.when(F.concat_ws(" ", "en", "zh").rlike("(?i)\\btax|稅"), F.array(F.lit("topic:tax"))).otherwise(F.array().cast("array<string>")))
    fee = F.nullif(F.trim("fee"), F.lit(""))
    empty = F.lit("")
    return rows.select(
        F.lit("talent_taiwan").alias("source_platform"), F.trim("slug").alias("source_id"), F.coalesce(F.nullif("zh", empty), F.col("en")).alias("title"), F.nullif("en", empty).alias("title_en"), N.classify(F.coalesce(F.nullif("en", empty), F.col("zh")), F.col("zh"), F.col("description")).alias("type"),
        "description", F.coalesce(F.trim("organiser.en"), F.lit("Talent Taiwan")).alias("organizer"), tags.alias("tags"), F.when(F.col("date").isNotNull(), at(F.coalesce("start_time", F.lit("00:00:00")))).alias("starts_at"), F.when(F.col("end_time").isNotNull(), at(F.col("end_time"))).alias("ends_at"),
        F.when(~F.col("online"), F.coalesce(F.nullif("loc_en", empty), F.nullif("loc_zh", empty))).alias("venue"), F.when(~F.col("online"), F.nullif("loc_zh", empty)).alias("address"), F.col("_p.district").alias("district"), city.alias("city"),
        F.when(fee.rlike("(?i)^(free|免費)$"), F.lit(True)).otherwise(N.detect_free(fee)).alias("is_free"), fee.alias("price_text"),
    )


#: Columns of the session feed under names of our own, in the order of its header.
SESSIONS = ["type_zh", "type_en", "date", "list_price", "early_2m", "early_1m", "form", "state", "signup", "price", "blank", "final"]
CANCELLED = ["取消", "已取消", "Cancelled"]


def from_sessions(rows: DataFrame) -> DataFrame:
    """Listings of a session feed with the columns of SESSIONS; rows without name or date are dropped."""
    rows = rows.withColumn("title", F.coalesce("type_zh", "type_en")).withColumn("starts_at", N.taipei_iso(F.col("date"))).filter("title is not null and starts_at is not null")
    price = F.coalesce("price", "list_price")
    number = F.nullif(F.replace(F.regexp_extract(price, r"(\d[\d,]*)", 1), F.lit(",")), F.lit(""))
    key = F.coalesce(F.nullif(F.regexp_replace(F.coalesce("type_en", F.lit("")), "[^A-Za-z0-9]+", ""), F.lit("")), F.lit("event"))
    tag = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}:"), c))
    off = F.coalesce(F.col("state").isin(CANCELLED), F.lit(False)) | F.coalesce(F.col("final").isin(CANCELLED), F.lit(False))
    return rows.select(
        F.lit("taiwan_pathfinder").alias("source_platform"), F.concat(key, F.lit("-"), "date").alias("source_id"), F.col("form").alias("source_url"), "title", F.col("type_en").alias("title_en"), N.classify(F.col("title"), F.col("type_en")).alias("type"),
        F.array_compact(F.array(F.lit("src:openForBooking"), tag("signup", "signup"), tag("final", "final"), tag("early2m", "early_2m"), tag("early1m", "early_1m"))).alias("tags"), "starts_at", N.taipei_iso(F.col("date"), end_of_day=True).alias("ends_at"),
        (number.cast("int") == 0).alias("is_free"), price.alias("price_text"), F.when(off, "cancelled").otherwise("upcoming").alias("status"),
    )


# ---- detail pages


def detail_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``fields``, a map of label to text of <h3>label</h3><div>value</div>; the first of each label."""
    pattern = r"(?s)<h3>\s*([^<]+?)\s*</h3>\s*<div>(.*?)</div>"

    @F.pandas_udf("array<string>")
    def unescape(values):
        return values.map(lambda v: [html_lib.unescape(x) for x in v])

    labels, bodies = F.regexp_extract_all(html, F.lit(pattern), 1), F.regexp_extract_all(html, F.lit(pattern), 2)
    plain = F.transform(bodies, lambda b: F.regexp_replace(F.regexp_replace(b, r"(?i)<br\s*/?>|</p>", "\n"), "<[^>]+>", ""))
    rows = pages.withColumn("_l", F.transform(labels, F.trim)).withColumn("_b", F.transform(unescape(plain), lambda b: F.btrim(b, F.lit(" \t\r\n"))))
    first = F.filter(F.sequence(F.lit(0), F.size("_l") - 1), lambda i: F.array_position("_l", F.get("_l", i)) == i + 1)
    some = F.when(F.size("_l") > 0, F.map_from_arrays(F.transform(first, lambda i: F.get("_l", i)), F.transform(first, lambda i: F.get("_b", i))))
    return rows.withColumn("fields", some).drop("_l", "_b")


OTHER = "其他縣市"
SHORT = "(臺北|台北|新北(?!投)|桃園|臺中|台中|臺南|台南|高雄|基隆|新竹|苗栗|彰化|南投|雲林|嘉義|屏東|宜蘭|花蓮|臺東|台東|澎湖|金門|馬祖)"
ABOUT, PLACES, ADDRESS_LINE = "內容簡介", "演出地點", r"(?:地址|演出地點|活動地點|地點|場地)\s*[:：]\s*(.+)"


def _cities(text: Column) -> Column:
    """The cities that a text names: the two home cities by name, any other as one."""
    home = lambda c: F.when(c.isin(rules.HOME_CITIES), c).otherwise(F.lit(OTHER))
    short = F.transform(F.regexp_extract_all(text, F.lit(SHORT), 1), lambda s: N.first_of([(s.isin("台北", "臺北"), F.lit("臺北市")), (s == "新北", F.lit("新北市"))], F.lit(OTHER)))
    named = N.parse_location(text)["city"]
    return F.concat(short, F.array_compact(F.array(F.when(named.isNotNull(), home(named)))))


def locate_sessions(listings: DataFrame) -> DataFrame:
    """``listings`` (uid, starts_at, fields) with d_city, d_address and why: the first evidence that names one city only, of
    the lines with the session's date, the address lines, and the places field."""
    rows = listings.withColumn("_d", F.coalesce(F.element_at("fields", ABOUT), F.lit(""))).withColumn("_v", F.filter(F.transform(F.split(F.coalesce(F.element_at("fields", PLACES), F.lit("")), "、"), F.trim), lambda v: v != ""))
    y, m, d = F.substring("starts_at", 1, 4), F.substring("starts_at", 6, 2), F.substring("starts_at", 9, 2)
    mi, di = m.cast("int").cast("string"), d.cast("int").cast("string")
    spelt = [F.concat_ws("/", y, m, d), F.concat_ws("\\.", y, m, d), F.concat_ws("-", y, m, d), F.concat_ws("/", y, mi, di), F.concat_ws("/", m, d), F.concat_ws("/", mi, di), F.concat(mi, F.lit("月"), di, F.lit("日")), F.concat_ws("\\.", m, d)]
    rows = rows.withColumn("_dates", F.concat(F.lit(r"(?<![\d/.])(?:"), F.concat_ws("|", *spelt), F.lit(r")(?!\d)")))
    rows = rows.withColumn("_lines", F.split("_d", "\n"))
    on_date = F.filter("_lines", lambda x: F.regexp_like(x, F.col("_dates")))
    address = F.filter(F.transform("_lines", lambda x: F.regexp_extract(x, ADDRESS_LINE, 1)), lambda x: x != "")
    rows = rows.withColumn("_c1", F.when(F.col("starts_at").isNotNull(), F.array_distinct(F.flatten(F.transform(on_date, _cities)))))
    rows = rows.withColumn("_c2", F.array_distinct(F.flatten(F.transform(address, _cities))))
    rows = rows.withColumn("_c3", F.array_distinct(F.array_compact(F.transform("_v", lambda v: N.parse_location(v)["city"]))))
    one = lambda c: F.size(c) == 1
    city = N.first_of([(one(F.coalesce("_c1", F.array().cast("array<string>"))), F.get("_c1", F.lit(0))), (one("_c2"), F.get("_c2", F.lit(0))), (one("_c3"), F.get("_c3", F.lit(0)))])
    why = N.first_of([(one(F.coalesce("_c1", F.array().cast("array<string>"))), F.lit("session line")), (one("_c2"), F.lit("address line")), (one("_c3"), F.lit("places")), (F.size("_c3") > 1, F.lit("several places"))], F.lit("no place"))
    rows = rows.withColumn("d_city", city).withColumn("why", why)
    sure = (F.size("_v") == 1) & one("_c3") & (F.get("_c3", F.lit(0)) == F.col("d_city"))
    return rows.withColumn("d_address", F.when(sure, F.get("_v", F.lit(0)))).drop("_d", "_v", "_dates", "_lines", "_c1", "_c2", "_c3")


def apply_details(listings: DataFrame, details: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """``listings`` with city, district and address set right by their detail page (url, fields), and moved: the reason for
    which the city changed, or null. Listings whose city isn't a home city go, those without one unless they are kept."""
    rows = locate_sessions(listings.join(details.select(F.col("url").alias("source_url"), "fields"), "source_url", "left"))
    unsure = F.col("fields").isNotNull() & F.col("d_city").isNull() & (F.col("why") != "no place")
    city = N.first_of([(unsure, F.lit(None).cast("string")), (F.col("d_city").isNotNull(), F.col("d_city"))], F.col("city"))
    rows = rows.withColumn("_city", city).withColumn("_moved", ~F.col("_city").eqNullSafe(F.col("city")))
    exact = F.col("d_address").isNotNull() & (F.col("d_city") == F.col("_city"))
    district = F.when(~F.col("_moved"), F.col("district"))
    rows = rows.withColumn("district", F.when(exact, F.coalesce(N.parse_location(F.col("d_address"))["district"], district)).otherwise(district))
    rows = rows.withColumn("address", F.when(exact, F.col("d_address")).otherwise(F.col("address"))).withColumn("moved", F.when(F.col("_moved"), F.col("why"))).withColumn("city", F.col("_city"))
    keep = F.col("city").isin(rules.HOME_CITIES) if not keep_unknown else F.coalesce(F.col("city").isin(rules.HOME_CITIES), F.lit(True))
    return rows.filter(keep).drop("_city", "_moved", "fields", "d_city", "d_address", "why")


# ---- bilingual article payloads


ARTICLE = "struct<title:struct<en:string,zh:string>,contents:struct<en:string,zh:string>,updated_time:string>"
FAQ = "struct<title:struct<en:string,zh:string>,slug:string,contents:array<struct<sequence_no:int,title:struct<en:string,zh:string>,contents:struct<en:string,zh:string>>>>"


def _fragment(c: Column) -> Column:
    from ..operators.documents import read_page

    @F.pandas_udf("string")
    def text(col):
        return col.map(lambda x: read_page(f"<div>{x or ''}</div>", ["div"])[0])

    return text(c)


def article_texts(rows: DataFrame, payload: str = "payload", thin: int = 200) -> DataFrame:
    """``rows`` with text (English, then Chinese, each under its title), page_title, page_updated and status (ok, thin)."""
    rows = rows.withColumn("_a", F.from_json(payload, ARTICLE))
    rows = rows.withColumn("_en", _fragment(F.col("_a.contents.en"))).withColumn("_zh", _fragment(F.col("_a.contents.zh")))
    part = lambda body, name, lang: F.when(F.col(body) != "", F.concat(F.lit(f"## {name}："), F.coalesce(f"_a.title.{lang}", F.lit("")), F.lit("\n\n"), body))
    text = F.concat_ws("\n\n", part("_en", "English", "en"), part("_zh", "中文", "zh"))
    rows = rows.withColumn("text", text).withColumn("page_title", F.coalesce(F.nullif("_a.title.en", F.lit("")), "_a.title.zh")).withColumn("page_updated", F.nullif(F.substring("_a.updated_time", 1, 10), F.lit("")))
    return rows.withColumn("status", F.when(F.length("text") < thin, "thin").otherwise("ok")).drop("_a", "_en", "_zh")


def faq_texts(rows: DataFrame, category: str, data: str = "data") -> DataFrame:
    """``rows`` (id, data: JSON array of FAQ categories) with text: questions and answers of the first category that the name
    or slug fits, in their order, and status (ok, thin, or error where no category fits)."""
    cats = rows.select("id", F.from_json(data, f"array<{FAQ}>").alias("c"))
    fits = F.filter("c", lambda x: F.coalesce(F.lower(x["title"]["en"]).contains(category.lower()), F.lit(False)) | F.coalesce(F.lower(x["slug"]) == category.lower(), F.lit(False)))
    one = cats.withColumn("cat", F.get(fits, F.lit(0)))
    items = one.select("id", F.posexplode_outer(F.col("cat.contents")).alias("pos", "i")).withColumn("_en", _fragment(F.col("i.contents.en"))).withColumn("_zh", _fragment(F.col("i.contents.zh")))
    block = F.when(F.col("i").isNotNull(), F.concat(F.lit("## Q: "), F.coalesce("i.title.en", F.lit("")), F.lit("\n\n"), "_en", F.lit("\n\n### 問："), F.coalesce("i.title.zh", F.lit("")), F.lit("\n\n"), "_zh"))
    items = items.select("id", F.struct(F.coalesce("i.sequence_no", F.lit(0)).alias("s"), "pos", block.alias("b")).alias("e"))
    text = items.groupBy("id").agg(F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list("e")), lambda x: x["b"])).alias("text"))
    found = one.select("id", F.col("cat").isNotNull().alias("found"))
    return found.join(text, "id").select("id", "text", F.when(~F.col("found"), "error").when(F.length("text") < 200, "thin").otherwise("ok").alias("status"))
