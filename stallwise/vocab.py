# -*- coding: utf-8 -*-
"""Fixed values of the listing market: word lists, labels, patterns, limits.

Everything in this module is a fixed value that results depend on; nothing is computed.
Operators take these as defaults and accept other values as arguments.
"""

# --- fixed values: profiles and area of interest ------------------------------------------
# (lat_min, lon_min, lat_max, lon_max)
BBOX = (46.93187895804624, 28.50558181762733, 47.113965779064955, 29.164418182373254)
PROFILES = {"apartments": 1404, "garages": 1408, "commercial": 1405}
DEFAULT_CATEGORY = 270

# --- fixed values: comparable-quality rules and benchmark thresholds -----------------------
CITY = "Кишинёв"
AREA_MAX = 400.0
AREA_PER_ROOM_MAX = 100.0
PRICE_FLOOR = 15000.0
PPM_DEAL_RANGE = (300.0, 12000.0)
MIN_AREA = 30.0
POOL_MIN = 8
DISCOUNT_RANGE = (15.0, 60.0)
SUSPECT_SHARE = 0.55  # of the segment median
PRICE_TOLERANCE = 0.5

# --- fixed values: author labels ----------------------------------------------------------
AUTHORS = {"private": "Частное лицо", "business": "Агентство", "developer": "Застройщик"}
NEW_BUILD = "Новострой"

# --- fixed values: attribute names behind the attribute filters ---------------------------
FEATURE_NAMES = {
    "condition": "Состояние квартиры",
    "building": "Тип здания",
    "locality": "Населённый пункт",
    "parking": "Тип стоянки",
    "premise": "Тип помещения",
    "pcondition": "Состояние помещения",
}

# --- fixed values: amenity name -> (attribute name, kind of test, values) -----------------
AMENITIES = {
    "heating": ("Автономное отопление", "true", ()),
    "lift": ("Лифт", "true", ()),
    "furnished": ("Меблированная", "true", ()),
    "appliances": ("С бытовой техникой", "true", ()),
    "ready": ("Готова к въезду", "true", ()),
    "ac": ("Кондиционер", "true", ()),
    "parking": ("Парковочное место", "present", ()),
    "baths2": ("Санузел", "in", ("2", "3", "4 и более")),
    "balcony": ("Балкон / лоджия", "not in", ("Нет", "")),
    "electric": ("Электричество", "true", ()),
    "pit": ("Смотровая яма", "true", ()),
    "guard": ("Круглосуточная охрана", "true", ()),
    "cctv": ("Видеонаблюдение", "true", ()),
    "road": ("Выход на проезжую часть", "true", ()),
    "ready_c": ("Готов к въезду", "true", ()),
    "parking_c": ("Парковочные места", "true", ()),
    "acs": ("Кондиционеры", "true", ()),
    "gas": ("Газифицирован", "true", ()),
    "water": ("Водопровод", "true", ()),
    "generator": ("Электрогенератор", "true", ()),
    "equipment": ("Вместе с оборудованием", "true", ()),
    "ramp": ("Рампа для погрузки / разгрузки товара", "true", ()),
}

# --- fixed values: named price steps (upper edge, label) ----------------------------------
PRICE_STEPS = (
    (50000, "до 50 тыс."),
    (100000, "50–100 тыс."),
    (200000, "100–200 тыс."),
    (500000, "200–500 тыс."),
    (1000000, "500 тыс. – 1 млн"),
    (None, "от 1 млн"),
)

# --- fixed values: trend labels and their display order -----------------------------------
ALL_LISTINGS = "все лоты"
UNSPECIFIED = "не указано"
STUDIO = "студия"
ROOMS_SUFFIX = "-комн."
ROOMS_TOP = "5+ комн."
AREA_BANDS = (
    (40, "до 40 m²"),
    (60, "40–60 m²"),
    (80, "60–80 m²"),
    (100, "80–100 m²"),
    (None, "от 100 m²"),
)
FLOOR_FIRST = "первый этаж"
FLOOR_MIDDLE = "средние этажи"
FLOOR_LAST = "последний этаж"
TREND_ORDER = {
    "rooms": ("студия", "1-комн.", "2-комн.", "3-комн.", "4-комн.", "5+ комн."),
    "area": ("до 40 m²", "40–60 m²", "60–80 m²", "80–100 m²", "от 100 m²"),
    "floor": ("первый этаж", "средние этажи", "последний этаж"),
}
MAX_SERIES = 8
PPM_SANE = (100.0, 25000.0)

# --- fixed values: markers of instalment terms and unfinished flats -----------------------
TERMS_MARKERS = (
    "рассроч", "в рассрочку", "аванс", "первоначальный взнос", "первый взнос",
    "белый вариант", "серый вариант", "вариант алб", "черновая", "без ремонта",
    "под ремонт", "в стадии строительства", "сдача дома", "строится",
    " in rate", " în rate", "rate fara", "rate fără", "avans",
    "varianta alba", "varianta albă", "varianta gri", "varianta sura", "varianta sură",
    "la rosu", "la roșu", "la gri", "in constructie", "în construcție",
    "se construieste", "se construiește", "exploatare",
    "bloc nou in constructie", "сдача в", "готовность",
)
STUDIO_MARKER = "туди"

# --- fixed values: privacy ----------------------------------------------------------------
PRIVATE_FIELDS = ("phones", "owner_login", "owner_id", "owner_registered", "owner_verified")
PRIVATE_FEATURES = ("Контакты", "Агентство")
LISTING_TEXT_FEATURE = "Текст объявления"
PHONE_PATTERN = r"(?U)(?<!\d)(?:\+?373[\s\-.()]*)?0?[\s\-.()]*[67]\d(?:[\s\-.()]*\d){6}(?!\d)"
PHONE_MASK = "[номер скрыт]"

# --- fixed values: renamed districts ------------------------------------------------------
DISTRICT_FEATURE = "Сектор"
DISTRICT_RENAMES = {"Окраина": "Пригород"}

# --- fixed values: card feature ids -> column ---------------------------------------------
FEATURE_IDS = {
    1: "offer_type", 2: "price", 3: "map", 7: "region", 8: "city", 9: "district",
    10: "street", 11: "house", 13: "body", 14: "photos", 15: "video", 16: "contacts",
    241: "rooms", 244: "area", 248: "floor", 249: "floors_total", 795: "author_type",
    852: "housing_stock", 1385: "price_per_m2", 1640: "old_price", 1658: "developer",
    2199: "living_room", 2562: "uploaded_video",
}

# --- fixed values: unit codes -------------------------------------------------------------
UNITS = {
    "UNIT_METER_SQUARE": "m²",
    "UNIT_ARE": "сот.",
    "UNIT_HECTARE": "га",
    "UNIT_EUR": "EUR",
    "UNIT_USD": "USD",
    "UNIT_MDL": "MDL",
    "UNIT_LEI": "MDL",
}
UNIT_PREFIX = "UNIT_"
BARGAIN_SUFFIX = " (торг)"

# --- fixed values: columns of the two flat exports ----------------------------------------
LISTING_EXPORT = (
    "id", "title", "price", "currency", "old_price", "old_currency", "street",
    "subcategory", "lat", "lon", "url",
)
CARD_EXPORT = (
    "id", "url", "title", "state", "posted", "reseted", "expire", "is_expired",
    "views_total", "views_today", "views_since_republish",
    "category", "subcategory", "subcategory_id",
    "offer_type", "author_type", "price", "currency", "bargain", "price_per_m2",
    "old_price", "old_currency",
    "rooms", "area", "floor", "floors_total", "housing_stock", "living_room", "developer",
    "region", "city", "district", "street", "house", "lat", "lon",
    "owner_login", "owner_id", "owner_registered", "owner_is_business",
    "owner_business_plan", "owner_verified",
    "phones", "photos_count", "photos", "description",
)

# --- fixed values: register pages (labels are matched by folded prefix) -------------------
REGISTER_MARK = r"(?s)<summary[^>]*>.*?<strong>\s*([\d.]+)\s*</strong>"
REGISTER_FIELD = r"(?s)<li>\s*([^<:]+?)\s*:\s*<strong>(.*?)</strong>"
REGISTER_UPDATED = r"Data actualiz[ăa]rii:\s*([\d.]+)"
BUILDING_LABELS = {
    "adresa": "address", "clasificator": "classifier", "anul constr": "year_built",
    "numarul de etaje": "floors", "starea": "condition", "gaz": "gas",
    "materialul": "walls", "apa": "water", "canalizare": "sewer",
    "complet electrificat": "electrified", "valoarea estimata": "value_lei",
}
UNIT_LABELS = {
    "adresa": "address", "suprafata": "area", "tipul": "kind", "etajul": "floor",
    "veceu": "wc", "baie": "bath", "ultimul etaj": "last_floor",
    "valoarea estimata": "value_lei",
}
YES_NO = {"da": 1, "nu": 0}

# --- fixed values: register linkage -------------------------------------------------------
EARTH_RADIUS = 6378137.0
RING_METRES = (12.0, 25.0)
RING_DIRECTIONS = 8
AREA_TOLERANCES = (0.05, 0.10)
STREET_SCORE_MIN = 0.6
STREET_WORDS = (
    "str", "strada", "bd", "bld", "bul", "bulevardul", "sos", "soseaua", "pr", "prospectul",
    "str-la", "stradela", "al", "aleea", "pta", "piata", "tr", "trecerea", "fund", "fundac",
    "ул", "улица", "бул", "бульвар", "б-р", "шос", "шоссе", "пр", "пр-т", "проспект",
    "пер", "переулок", "пл", "площадь", "туп", "тупик", "мун", "mun", "or", "г",
)
CYRILLIC_SOUNDS = (
    ("дж", "J"), ("ч", "Ç"), ("ж", "J"), ("ш", "S"), ("щ", "S"), ("ц", "C"),
    ("х", "h"), ("кс", "ks"),
)
CYRILLIC_LETTERS = ("бвгдзклмнпрстф", "bvgdzklmnprstf")
LATIN_SOUNDS = (
    ("che", "ke"), ("chi", "ki"), ("ghe", "Ge"), ("ghi", "Gi"),
    ("ce", "Çe"), ("ci", "Çi"), ("ge", "Je"), ("gi", "Ji"),
    ("j", "J"), ("x", "ks"), ("c", "k"), ("q", "k"), ("w", "v"), ("G", "g"),
)
LATIN_MARKED = ("șşțţ", "SSCC")
VOWELS = "aeiouyаеёиоуыэюяйьъ"
HOUSE_LETTERS = ("абвгдеж", "abvgdej")

# --- fixed values: message rules ----------------------------------------------------------
RATE_LIMIT_KEY = 5
RATE_LIMIT_ALL = 40
RATE_WINDOW_SECONDS = 3600
EMAIL_PATTERN = r"(?i)^[^@\s]{1,64}@[a-z0-9.-]{1,180}\.[a-z]{2,24}$"
NAME_MIN, NAME_MAX = 2, 100
EMAIL_MAX = 200
BODY_MIN, BODY_MAX = 10, 5000

# --- fixed values: patterns of request parameters and addresses ----------------------------
URL_OPTION = r"^o_(\d+)_(\d+)$"
URL_RANGE = r"^(from|to|unit)_(\d+)_(\d+)$"
HOUSE_PATTERN = r"^\d[\w/-]*$"
STREET_AND_HOUSE = r"^(.*?)\s+(\d[\w/-]*)$"
SECTOR_PREFIX = r"^sect\.?\s+\S+\s+"
APARTMENT_PATTERN = r"(?i)\bap\.\s*(\S+)\s*$"
