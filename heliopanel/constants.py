"""Names, word lists and patterns that define the expected results.

Everything in this module is plain data. The order of every list matters where a
"first match wins" rule reads it.
"""

# Tokens that give a location-file column its role.
PLANT_TOKENS = ["발전소명", "발전소", "호기명", "호기", "플랜트", "사업명", "사업장", "설비명",
                "site", "plant", "facility", "name"]
LOCATION_TOKENS = ["위치", "주소", "지역", "시도", "시군구", "행정구역", "소재지", "address",
                   "location", "region", "city", "province", "lat", "lon", "latitude", "longitude"]
SOURCE_TOKENS = ["에너지원", "에너지", "발전원", "전원", "연료", "source", "fuel", "type"]

# Raw substrings that give a meter-file column its role.
METER_NAME_TOKENS = ["발전소", "발전기", "발전구분", "site", "plant"]
METER_DATE_TOKENS = ["일자", "날짜", "년월일", "date"]
METER_UNIT_NO_TOKENS = ["호기", "unit"]

# Energy-source default, filter word, unknown plant, one corrected plant name.
SOLAR = "태양광"
UNKNOWN_PLANT = "미상"
PLANT_CORRECTIONS = {"영암에프원태양광b": "(군산)영암F1태양광"}

# Energy units, in the order they are looked for, and their divisor to MWh.
UNIT_DIVISORS = {"mwh": 1.0, "kwh": 1_000.0, "wh": 1_000_000.0}

# Hour labels, as pattern and group of the hour, and the plant in a file name.
HOUR_LABELS = [(r"\d{1,2}\s*[-~_]\s*(\d{1,2})", 1), (r"(\d{1,2})\s*시", 1), (r"(?:^|\D)(\d{1,2})(?!\d)", 1)]
PLANT_IN_FILE_NAME = r"\[(.*?)\]"

# Column candidates for time stamps and for the forecast tables.
DATETIME_CANDIDATES = ["일시", "datetime", "timestamp", "DATE_TIME", "date_time"]
DATE_CANDIDATES = ["일자", "date"]
HOUR_CANDIDATES = ["시간", "hour", "HOUR"]
TIME_COLUMN_CANDIDATES = ["일시", "datetime", "time"]
PLANT_COLUMN_CANDIDATES = ["발전구분", "발전기", "호기", "plant"]
TARGET_COLUMN_CANDIDATES = ["합산발전량(MWh)", "합산발전량", "발전량", "target"]

# Names of the published training table.
TRAINING_COLUMNS = {
    "ts": "일시",
    "plant": "발전구분",
    "station_name": "지역",
    "station": "지점번호",
    "mwh": "합산발전량(MWh)",
    "temperature": "기온(°C)",
    "rain": "강수량(mm)",
    "sunshine": "일조(hr)",
    "radiation": "일사(MJ/m2)",
}
WEATHER_COLUMNS = {
    "지점": "station",
    "지점명": "station_name",
    "일시": "ts",
    "기온(°C)": "temperature",
    "강수량(mm)": "rain",
    "일조(hr)": "sunshine",
    "일사(MJ/m2)": "radiation",
}
STATION_COLUMNS = {"지점": "station", "지점명": "station_name", "위도": "lat", "경도": "lon"}
REGISTRY_COLUMNS = {"발전기명": "generator", "광역지역": "region", "세부지역": "subregion",
                    "설비용량": "capacity"}

# Province spellings an address may start with, and the word endings kept.
PROVINCES_LONG = ["서울특별시", "부산광역시", "대구광역시", "인천광역시", "광주광역시", "대전광역시",
                  "울산광역시", "세종특별자치시", "경기도", "강원도", "강원특별자치도", "충청북도",
                  "충청남도", "전라북도", "전라남도", "경상북도", "경상남도", "제주특별자치도"]
PROVINCES_SHORT = ["전남", "전북", "경남", "경북", "충남", "충북", "강원", "제주", "서울", "부산",
                   "대구", "인천", "광주", "대전", "울산", "세종"]
DISTRICT_ENDINGS = ["시", "군", "구", "읍", "면", "동"]

# Canonical provinces in report order with the pattern that recognises each.
REGION_PATTERNS = {
    "서울특별시": "서울(특별)?\\s*시?",
    "부산광역시": "부산(광역)?\\s*시?",
    "대구광역시": "대구(광역)?\\s*시?",
    "인천광역시": "인천(광역)?\\s*시?",
    "광주광역시": "광주(광역)?\\s*시?",
    "대전광역시": "대전(광역)?\\s*시?",
    "울산광역시": "울산(광역)?\\s*시?",
    "세종특별자치시": "세종(특별자치)?\\s*시?",
    "경기도": "경기\\s*(도)?",
    "강원특별자치도": "강원(특별자치)?\\s*도?",
    "충청북도": "(충북|충청북도)",
    "충청남도": "(충남|충청남도)",
    "전라북도": "(전북특별자치도|전북|전라북도)",
    "전라남도": "(전남|전라남도)",
    "경상북도": "(경북|경상북도)",
    "경상남도": "(경남|경상남도)",
    "제주특별자치도": "(제주(특별자치)?\\s*도?)",
}
CANONICAL_REGIONS = list(REGION_PATTERNS)
REGION_PREFIXES = CANONICAL_REGIONS + ["전북특별자치도"]
DISPLAY_NAMES = {"전라북도": "전북특별자치도"}
INVALID_REGION_LABELS = ["", "nan", "None", "알수없음"]

# Names used by the boundary file.
BOUNDARY_NAMES = {
    "Seoul": "서울특별시", "Busan": "부산광역시", "Daegu": "대구광역시", "Incheon": "인천광역시",
    "Gwangju": "광주광역시", "Daejeon": "대전광역시", "Ulsan": "울산광역시", "Sejong": "세종특별자치시",
    "Gyeonggi": "경기도", "Gangwon": "강원특별자치도",
    "North Chungcheong": "충청북도", "South Chungcheong": "충청남도",
    "North Jeolla": "전라북도", "South Jeolla": "전라남도",
    "North Gyeongsang": "경상북도", "South Gyeongsang": "경상남도",
    "Jeju": "제주특별자치도",
}

# Panel and model settings.
LAG_MAX = 168
ROLL_WINDOWS = (24, 72, 168)
ROLL_MIN_FRACTION = 0.6
SEQ_LEN = 168
HORIZON = 24
PEAK_HORIZONS = (8, 18)
PEAK_WEIGHT = 6.0
SAMPLED_WINDOWS = 512_000
VALIDATION_DAYS = 7
UNIT_FACTORS = [1, 10, 24, 100, 1000, 10000]
EARTH_RADIUS_KM = 6371.0
MWH_SCALE = 4
