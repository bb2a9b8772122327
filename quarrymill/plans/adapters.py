"""Listing-shaped rows out of the driver tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import spread, written

#: The time at which the registered queries run.
NOW = "1999-06-16T12:00:00+08:00"

TITLES = [
    "Sunday Hiking on the Ridge Trail", "攀岩體驗", "週三英文中文語言交換", "English Corner Conversation", "農夫市集", "Jazz Night with Live Band", "昆蟲的頭等大事特展",
    "Yoga in the Park", "金車文藝講堂", "Coffee Tasting", "燈節嘉年華", "Networking Mixer", "Winding Down With Chai", "法語交流 French Table", "手沖咖啡工作坊",
    "Marathon Club", "Language Exchange", "室內樂演奏會", "日語交流會", "EnJoin' x JECHO 活動空間", "City Walk",
]
DESCRIPTIONS = [
    "免費入場，中英文雙語", "票價 300 元", "<p>Free admission  for <b>all</b></p>", "An evening of jazz and wine", "報名費 NT$500, english friendly", "日文 and 韓文 speakers welcome",
    "走進一個展覽", "Updated 1998-03-05",
]
ADDRESSES = [
    "台灣台北市108臺北市萬華區成都路10巷35-37號", "106大安區大學里新生南路三段60巷7號", "松山文創園區 巴洛克花園（臺北市信義區光復南路）", "No. 7, Da’an District, Ta",
    "Xinyi District, Keelung City", "新北市板橋區縣民大道", "桃園市中壢區中正路", "10 Orchard Rd, Singapore", "New Taipei City, Tamsui Dist.", "Taipei City Hall", "中國文化大學",
    "高雄市前金區中正路",
]
VENUES = [
    "國家兩廳院", "臺中市中山堂", "Da An Park Playground / Gym", "地點：卡米地", "大眾運輸：捷運新店站", "https://maps.example.org/x", "Taipei 101 Mall", "花蓮文創",
    "MOJO 1921 咖啡廳：捷運中山站出來以後一直走到底再左轉就可以看到我們的招牌了如果找不到請打電話給我們我們會派人出來接您謝謝大家的支持與愛護", "新北市圖書館", "Unknown Hall",
]
TYPES = ["outdoor_challenge", "sports", "language_exchange", "music", "market", "exhibition", "talk", "food", "festival", "social", "other"]
DISTRICTS = ["萬華區", "大安區", "信義區", "板橋區", None, "中正區"]
CITIES = ["臺北市", "臺北市", "新北市", "桃園市", None]
PLATFORMS = ["anncr", "accupass", "meetup", "travel_taipei", "talent_taiwan"]
TAGS = ["", "lang:en", "online", "lang:en,online,kw:jazz", "src:x", "lang:ja,lang:zh"]
FEEDBACK = ["not_my_thing", "went", None, None, None, None, None]


def pick(values: list, key: str) -> str:
    """SQL for the value at ``key`` modulo the length of the list."""
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"CASE ({key}) % {len(values)} " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values)) + " END"


def _stamp(day: str, hour: str) -> str:
    return f"concat(cast({day} as string), 'T', lpad(cast({hour} as string), 2, '0'), ':00:00+08:00')"


DAY = "cast(o_orderdate as date)"
LISTINGS = f"""
SELECT o_orderkey AS k, concat({pick(PLATFORMS, 'o_orderkey')}, ':', cast(o_orderkey as string)) AS uid, {pick(PLATFORMS, 'o_orderkey')} AS source_platform,
  cast(o_orderkey as string) AS source_id, concat('https://listings.example.org/', cast(o_orderkey as string)) AS source_url,
  {pick(TITLES, 'o_orderkey + o_custkey')} AS title, CASE WHEN o_orderkey % 6 = 0 THEN 'Evening out' WHEN o_orderkey % 6 = 1 THEN ' ' END AS title_en,
  {pick([*DESCRIPTIONS, None], 'o_orderkey')} AS description, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE concat('org', cast(o_custkey % 40 as string)) END AS organizer,
  {pick(TYPES, 'o_orderkey + o_custkey')} AS type, {pick(TAGS, 'o_custkey')} AS tags_text,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE {_stamp(DAY, 'o_orderkey % 24')} END AS starts_at,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 50 = 1 THEN {_stamp(DAY + ' + 800', '23')} ELSE {_stamp(DAY + ' + cast(o_orderkey % 9 as int)', '23')} END AS ends_at,
  CASE WHEN o_orderkey % 5 < 3 THEN NULL ELSE {_stamp(DAY + ' - 3', '12')} END AS signup_deadline,
  {pick([*VENUES, None], 'o_custkey')} AS venue, {pick([*ADDRESSES, None], 'o_orderkey')} AS address, {pick(DISTRICTS, 'o_custkey')} AS district, {pick(CITIES, 'o_custkey')} AS city,
  CASE WHEN o_orderkey % 3 = 0 THEN true WHEN o_orderkey % 3 = 1 THEN false END AS is_free,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 40 = 1 THEN 'free' ELSE concat('NT$', cast(o_orderkey % 500 as string)) END AS price_text,
  CASE WHEN o_orderkey % 13 = 0 THEN 'cancelled' ELSE 'upcoming' END AS status, {pick(FEEDBACK, 'o_orderkey')} AS feedback,
  {_stamp("cast('1999-05-01' as date) + cast(7 * (o_orderkey % 6) as int)", 'o_orderkey % 5')} AS first_seen,
  {_stamp("cast('1999-05-01' as date) + cast(7 * (o_orderkey % 6) + 7 * (o_custkey % (6 - o_orderkey % 6)) as int)", 'o_orderkey % 5 + 1')} AS last_seen
FROM {{orders}}"""
LISTINGS_CTE = f"listings AS ({LISTINGS.format(orders='orders')})"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str, many: bool = False) -> DataFrame:
    """The listings, with ``tags`` as an array. With ``many`` the orders are dealt out to many files first: a file of one row
    group is one task, and filters on what is made of its rows pass a repartition that is not written."""
    orders = read(spark, sf_dir, "orders")
    if many:
        orders = written(spread(orders.select("o_orderkey", "o_custkey", "o_orderdate")), "orders")
    rows = spark.sql(LISTINGS, orders=orders)
    return rows.withColumn("tags", F.filter(F.split("tags_text", ","), lambda t: t != ""))


#: The listings as DuckDB has them after a status refresh at NOW.
REFRESHED_CTE = f"""{LISTINGS_CTE},
fresh AS (SELECT * EXCLUDE (status, tags_text), list_filter(string_split(tags_text, ','), lambda t: t <> '') AS tags, starts_at::TIMESTAMPTZ AS s, coalesce(ends_at, starts_at)::TIMESTAMPTZ AS e,
  CASE WHEN status = 'cancelled' THEN status WHEN coalesce(ends_at, starts_at)::TIMESTAMPTZ < TIMESTAMPTZ '{NOW}' THEN 'expired' WHEN starts_at::TIMESTAMPTZ <= TIMESTAMPTZ '{NOW}' THEN 'ongoing' ELSE 'upcoming' END AS status
  FROM listings)"""
