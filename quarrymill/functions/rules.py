"""Fixed values of the listing rules: word lists, place names and labels, in the order in which they are tried."""

from __future__ import annotations

TYPES = ["outdoor_challenge", "sports", "language_exchange", "music", "market", "exhibition", "talk", "food", "festival", "social", "other"]
STATUSES = ["upcoming", "ongoing", "expired", "cancelled"]

#: Type of a listing by words in its title; the first type with a word in it is taken.
TYPE_WORDS = {
    "outdoor_challenge": [
        "攀岩", "抱石", "攀登", "深水", "dws", "deep water", "溯溪", "溪降", "瀑布", "越野", "越嶺", "trail run", "縱走", "登山", "百岳", "野營",
        "健行", "古道", "小百岳", "獨木舟", "sup", "衝浪", "潛水", "free dive", "自由潛水", "bouldering", "climbing", "hiking", "canyoning",
        "mountaineering",
    ],
    "language_exchange": [
        "語言交換", "語言交流", "英文角", "英語角", "會話", "口說", "language exchange", "language meetup", "conversation", "toastmasters",
        "english corner", "speaking club", "polyglot", "日語交流", "韓語交流",
    ],
    "market": ["市集", "快閃", "跳蚤", "二手市", "農夫市", "flea", "market day", "bazaar", "pop-up", "popup"],
    "music": [
        "音樂", "演唱", "演奏", "樂團", "live house", "livehouse", "dj", "concert", "gig", "音樂節", "爵士", "jazz", "band", "獨立音樂", "acoustic",
        "recital",
    ],
    "festival": ["節慶", "廟會", "嘉年華", "燈節", "花季", "festival", "carnival"],
    "sports": [
        "路跑", "馬拉松", "瑜伽", "yoga", "健身", "球賽", "羽球", "籃球", "自行車", "單車", "游泳", "運動", "marathon", "run club", "fitness",
    ],
    "food": ["品酒", "餐酒", "料理", "烘焙", "咖啡", "美食", "廚藝", "tasting", "brunch", "dining", "cooking class", "wine"],
    "exhibition": [
        "展覽", "特展", "個展", "聯展", "藝術展", "攝影展", "美術", "常設展", "珍藏展", "巡迴展", "主題展", "文化展", "檔案展", "雙年展",
        "exhibition", "gallery", "art show", "installation",
    ],
    "talk": [
        "講座", "講堂", "沙龍", "工作坊", "研習", "課程", "讀書會", "分享會", "論壇", "workshop", "seminar", "talk", "lecture", "meetup",
        "conference",
    ],
    "social": ["聚會", "交流會", "networking", "social", "mixer", "happy hour"],
}

LANGUAGE_WORDS = {
    "en": ["english", "英文", "英語", "esl", "ielts", "toeic"], "ja": ["japanese", "日文", "日語", "にほんご"], "ko": ["korean", "韓文", "韓語"],
    "es": ["spanish", "西班牙文", "西語"], "fr": ["french", "法文", "法語"], "zh": ["中文", "華語", "mandarin", "chinese"],
}
LANGUAGE_NAMES = {"en": "English", "zh": "Mandarin", "ja": "Japanese", "ko": "Korean", "fr": "French", "es": "Spanish"}

FREE_WORDS = ["免費", "免票", "自由入場", "free entry", "free admission", "no charge"]
PAID_WORDS = ["票價", "售票", "元", "nt$", "ntd", "$", "費用", "報名費"]

HOME_CITIES = ["臺北市", "新北市"]
OTHER_CITIES = [
    "桃園市", "臺中市", "台中市", "臺南市", "台南市", "高雄市", "基隆市", "新竹市", "新竹縣", "苗栗縣", "彰化縣", "南投縣", "雲林縣", "嘉義市",
    "嘉義縣", "屏東縣", "宜蘭縣", "花蓮縣", "臺東縣", "台東縣",
]
ALL_CITIES = ["臺北市", "台北市", "新北市", *OTHER_CITIES]
OTHER_CITIES_EN = [
    "Keelung", "Taichung", "Kaohsiung", "Taoyuan", "Tainan", "Hsinchu", "Chiayi", "Miaoli", "Changhua", "Nantou", "Yunlin", "Pingtung", "Yilan",
    "Hualien", "Taitung", "Penghu", "Kinmen", "Lienchiang",
]
#: Districts of the two home cities with their English names; and those whose names other cities have as well.
TAIPEI = {
    "中正區": "Zhongzheng", "大同區": "Datong", "中山區": "Zhongshan", "松山區": "Songshan", "大安區": "Daan", "萬華區": "Wanhua", "信義區": "Xinyi",
    "士林區": "Shilin", "北投區": "Beitou", "內湖區": "Neihu", "南港區": "Nangang", "文山區": "Wenshan",
}
NEW_TAIPEI = {
    "板橋區": "Banqiao", "三重區": "Sanchong", "中和區": "Zhonghe", "永和區": "Yonghe", "新莊區": "Xinzhuang", "新店區": "Xindian", "樹林區": "Shulin",
    "鶯歌區": "Yingge", "三峽區": "Sanxia", "淡水區": "Tamsui", "汐止區": "Xizhi", "瑞芳區": "Ruifang", "土城區": "Tucheng", "蘆洲區": "Luzhou",
    "五股區": "Wugu", "泰山區": "Taishan", "林口區": "Linkou", "深坑區": "Shenkeng", "石碇區": "Shiding", "坪林區": "Pinglin", "三芝區": "Sanzhi",
    "石門區": "Shimen", "八里區": "Bali", "平溪區": "Pingxi", "雙溪區": "Shuangxi", "貢寮區": "Gongliao", "金山區": "Jinshan", "萬里區": "Wanli",
    "烏來區": "Wulai",
}
SECOND_NAMES = {"Danshui": "淡水區"}
SHARED_DISTRICTS = ["中正區", "中山區", "信義區", "大安區"]
NO_DISTRICT_ENDS = ["園區", "社區", "校區", "廠區", "營區", "展區", "專區", "特區", "商區", "街區", "景區", "災區"]
NO_DISTRICTS = ["市區", "地區", "郊區", "本區", "該區", "全區"]
COUNTRIES = ["新加坡", "中國(?![一-鿿])", "香港", "澳門", "日本", "韓國", "馬來西亞", "泰國", "越南", "菲律賓", "印尼", "印度", "尼泊爾", "美國"]
COUNTRIES_EN = [
    "Singapore", "China", r"Hong\s*Kong", "Macau", "Japan", r"(?:South\s+)?Korea", "Malaysia", "Thailand", "Vietnam", "Philippines", "Indonesia",
    "India", "Nepal", r"United\s+States", "USA",
]

#: (name, city, district) of places, in the order in which names are looked for.
PLACES = [
    ("國家兩廳院", "臺北市", "中正區"), ("國家戲劇院", "臺北市", "中正區"), ("國家音樂廳", "臺北市", "中正區"), ("實驗劇場", "臺北市", "中正區"),
    ("演奏廳", "臺北市", "中正區"), ("中山堂", "臺北市", "中正區"), ("臺北表演藝術中心", "臺北市", "士林區"), ("北藝中心", "臺北市", "士林區"),
    ("城市舞台", "臺北市", "松山區"), ("臺北市藝文推廣處", "臺北市", "松山區"), ("水源劇場", "臺北市", "中正區"), ("西門紅樓", "臺北市", "萬華區"),
    ("南村劇場", "臺北市", "信義區"), ("松山文創", "臺北市", "信義區"), ("松菸", "臺北市", "信義區"), ("華山1914", "臺北市", "中正區"),
    ("臺北流行音樂中心", "臺北市", "南港區"), ("北流", "臺北市", "南港區"), ("南港展覽館", "臺北市", "南港區"), ("臺泥大樓", "臺北市", "中山區"),
    ("台泥大樓", "臺北市", "中山區"), ("士敏廳", "臺北市", "中山區"), ("卡米地", "臺北市", "中正區"), ("大稻埕戲苑", "臺北市", "大同區"),
    ("臺北天文館", "臺北市", "士林區"), ("花博", "臺北市", "中山區"), ("圓山", "臺北市", "中山區"), ("新北市藝文中心", "新北市", "板橋區"),
    ("新莊文化藝術中心", "新北市", "新莊區"), ("淡水雲門劇場", "新北市", "淡水區"), ("臺中國家歌劇院", "臺中市", None), ("衛武營", "高雄市", None),
    ("高雄流行音樂中心", "高雄市", None), ("臺南文化中心", "臺南市", None), ("新竹縣", "新竹縣", None), ("苗栗縣", "苗栗縣", None),
    ("雲林", "雲林縣", None), ("嘉義", "嘉義市", None), ("宜蘭", "宜蘭縣", None), ("花蓮", "花蓮縣", None), ("臺東", "臺東縣", None),
    ("Taipei Main Station", "臺北市", "中正區"), ("Taipei Railway Station", "臺北市", "中正區"), ("Daan Park", "臺北市", "大安區"),
    ("Daan Forest Park", "臺北市", "大安區"), ("大安森林公園", "臺北市", "大安區"), ("Bailing Rugby", "臺北市", "士林區"), ("百齡運動", "臺北市", "士林區"),
    ("Chiang Kai-Shek Memorial", "臺北市", "中正區"), ("Taipei 101", "臺北市", "信義區"), ("Ximending", "臺北市", "萬華區"),
    ("Shilin Night Market", "臺北市", "士林區"),
]
PLACE_CITIES = ["臺北市", "台北市", "新北市", "桃園市", "臺中市", "台中市", "臺南市", "台南市", "高雄市", "基隆市", "新竹市", "新竹縣"]
VENUE_LABELS = ["活動地點", "講座地點", "上課地點", "集合地點", "地點", "地址", r"Google\s*地圖", r"Google\s*搜尋", r"Google\s*Maps"]
VENUE_DIRECTIONS = ["大眾運輸", "交通方式", "交通資訊", "交通"]
VENUE_LONG, VENUE_LONGEST = 60, 100

PUBLISHERS = {
    "勞動部": "Ministry of Labor", "內政部移民署": "National Immigration Agency", "國家發展委員會 Talent Taiwan": "Talent Taiwan",
    "國家發展委員會": "National Development Council", "104 人力銀行": "104 Job Bank", "Money101": "Money101",
}
CITY_NAMES = {"臺北市": "Taipei", "新北市": "New Taipei"}
SCHEMA_STATUS = {
    "EventScheduled": "upcoming", "EventCancelled": "cancelled", "EventPostponed": "cancelled", "EventRescheduled": "upcoming", "EventMovedOnline": "upcoming",
}

#: Topics: types, and sub-topics by words, type or tag.
TOPICS = {
    "outdoors": ["outdoor_challenge", "sports"], "social": ["language_exchange", "social"], "music": ["music"], "arts": ["exhibition", "festival"],
    "markets": ["market", "food"], "talks": ["talk"],
}
SUBTOPICS = {
    "outdoors": {
        "climbing": ("words", ["攀岩", "抱石", "climb", "boulder"]),
        "hiking": ("words", ["登山", "健行", "古道", "百岳", "縱走", "hiking", "hike", "trail"]),
        "water": ("words", ["潛水", "獨木舟", "溯溪", "溪降", "衝浪", "sup", "kayak", "dive", "canyon"]),
        "fitness": ("type or words", ["sports", "路跑", "瑜伽", "run", "yoga"]),
    },
    "social": {"exchange": ("type", ["language_exchange"]), "english": ("tag", ["lang:en"]), "japanese": ("tag", ["lang:ja"]), "meetups": ("type", ["social"])},
    "music": {
        "live": ("words", ["live", "樂團", "獨立", "band", "gig"]), "jazz": ("words", ["jazz", "爵士"]),
        "classical": ("words", ["音樂會", "演奏", "交響", "室內樂", "鋼琴", "recital", "orchestra", "symphony"]),
    },
    "arts": {"exhibitions": ("type", ["exhibition"]), "festivals": ("type", ["festival"])},
    "markets": {
        "markets": ("type", ["market"]), "food": ("type", ["food"]), "coffee": ("words", ["咖啡", "手沖", "茶", "coffee", "tea", "chai"]),
    },
    "talks": {
        "english": ("tag", ["lang:en"]), "workshops": ("words", ["工作坊", "workshop", "手作", "diy", "體驗"]),
        "talks": ("words", ["講座", "講堂", "沙龍", "論壇", "talk", "seminar", "salon"]),
    },
}
