"""Table schemas and the fixed values of the analysis.

Everything here is a plain constant: the schemas of the raw/staging/mart
tables and the parameters (analysis window, warm-up start, subscription
token, operations-station id, month -> snapshot lookup).
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results)
# ---------------------------------------------------------------------------
WINDOW_START = 202401          # first month of the analysis window
WINDOW_END = 202512            # last month of the analysis window
WARMUP_START = 202310          # ride months read before the window for lag/rolling
SUBSCRIPTION_TOKEN = "정기권"   # pass type that counts as a subscription
SUBSCRIPTION = "SUBSCRIPTION"
NON_SUBSCRIPTION = "NON_SUBSCRIPTION"
UNKNOWN = "UNKNOWN"
OPS_STATION_ID = 9980          # operations (maintenance) station id
OPS_STATION_PATTERN = "%AS센터%"  # operations station name pattern (ASCII-case-insensitive)
AGE_BAND_MISSING = ("", "NAN", "NULL", "NONE")   # upper-cased age tokens meaning "missing"
RACK_QR = "QR"
RACK_LCD = "LCD"
RACK_BOTH = "LCD,QR"
SNAPSHOT_SHEET = "대여소현황"    # preferred workbook sheet
SNAPSHOT_SKIP_ROWS = 5         # rows above the data in a snapshot workbook
HEADER_KEYWORDS = ("대여소", "보관소", "자치구", "위도", "경도")  # header-row detection keywords
HEADER_SCAN_ROWS = 20
ENCODING_CANDIDATES = ("utf-8-sig", "utf-8", "cp949", "euc-kr")
SNAPSHOT_MONTHS = (202312, 202406, 202412, 202506, 202512)

# month -> station snapshot month (nearest half-year snapshot, ties to December)
MONTH_SNAPSHOT_MAP = (
    (202401, 202312), (202402, 202312), (202403, 202312), (202404, 202406),
    (202405, 202406), (202406, 202406), (202407, 202406), (202408, 202406),
    (202409, 202412), (202410, 202412), (202411, 202412), (202412, 202412),
    (202501, 202412), (202502, 202412), (202503, 202412), (202504, 202506),
    (202505, 202506), (202506, 202506), (202507, 202506), (202508, 202506),
    (202509, 202512), (202510, 202512), (202511, 202512), (202512, 202512),
)

# dataset -> (folder, file glob); file names of the public monthly extracts
DATASET_FILES = {
    "signup_month": ("signup_month", "서울특별시 공공자전거 신규가입자 정보(월별)_*.csv"),
    "ride_month": ("ride_month", "서울특별시 공공자전거 이용정보(월별)_*.csv"),
    "station_snapshot": ("station_snapshot", "공공자전거 대여소 정보(*기준).xlsx"),
    "station_usage_month": ("station_usage_month", "서울특별시 공공자전거 대여소별 이용정보(월별)_*.csv"),
}

# dataset -> human label used in the load-check reports
DATASET_LABELS = {
    "signup_month": "신규가입자 정보(월별)",
    "ride_month": "이용정보(월별)",
    "station_usage_month": "대여소별 이용정보(월별)",
    "station_snapshot": "대여소 정보",
}

# dataset -> period column in the source CSV
PERIOD_COLUMNS = {
    "signup_month": "가입년월",
    "ride_month": "대여일자",
    "station_usage_month": "기준년월",
}

# raw column -> candidate source headers (ranked; see HeaderIndex)
SIGNUP_SOURCE_COLUMNS = {
    "signup_ym": ("가입년월",),
    "member_type_raw": ("회원구분",),
    "age_band_raw": ("연령대",),
    "gender_raw": ("성별",),
    "signup_cnt_raw": ("가입건수",),
}
RIDE_SOURCE_COLUMNS = {
    "ride_ym": ("대여일자",),
    "station_id_raw": ("대여소번호",),
    "station_name_raw": ("대여소명",),
    "pass_type_raw": ("대여구분코드",),
    "gender_raw": ("성별",),
    "age_band_raw": ("연령대코드",),
    "ride_cnt_raw": ("이용건수",),
    "exercise_amt_raw": ("운동량",),
    "carbon_amt_raw": ("탄소량",),
    "distance_m_raw": ("이동거리(M)", "이용거리(M)"),
    "duration_min_raw": ("이용시간(분)",),
}
USAGE_SOURCE_COLUMNS = {
    "district_raw": ("자치구",),
    "station_name_raw": ("대여소명",),
    "usage_ym": ("기준년월",),
    "checkout_cnt_raw": ("대여건수",),
    "return_cnt_raw": ("반납건수",),
}
SNAPSHOT_POSITIONAL_COLUMNS = (
    "station_id_raw", "station_name_raw", "district_raw", "address_raw", "lat_raw",
    "lon_raw", "installed_at_raw", "rack_lcd_raw", "rack_qr_raw", "operation_type_raw",
)
# raw columns loaded as integers (unparseable -> NULL)
INT_RAW_COLUMNS = {"signup_ym", "signup_cnt_raw", "ride_ym", "ride_cnt_raw",
                   "usage_ym", "checkout_cnt_raw", "return_cnt_raw"}

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


RAW_SIGNUP = _struct(("source_file", S), ("signup_ym", I), ("member_type_raw", S),
                     ("age_band_raw", S), ("gender_raw", S), ("signup_cnt_raw", L),
                     ("loaded_at", S))
RAW_RIDE = _struct(("source_file", S), ("ride_ym", I), ("station_id_raw", S),
                   ("station_name_raw", S), ("pass_type_raw", S), ("gender_raw", S),
                   ("age_band_raw", S), ("ride_cnt_raw", L), ("exercise_amt_raw", S),
                   ("carbon_amt_raw", S), ("distance_m_raw", S), ("duration_min_raw", S),
                   ("loaded_at", S))
RAW_SNAPSHOT = _struct(("snapshot_ym", I), ("source_file", S),
                       *[(c, S) for c in SNAPSHOT_POSITIONAL_COLUMNS], ("loaded_at", S))
RAW_USAGE = _struct(("source_file", S), ("usage_ym", I), ("district_raw", S),
                    ("station_name_raw", S), ("checkout_cnt_raw", L), ("return_cnt_raw", L),
                    ("loaded_at", S))
MONTH_SNAPSHOT = T.StructType([T.StructField("month_ym", I, False),
                               T.StructField("snapshot_ym", I, False)])

STG_SIGNUP = _struct(("source_file", S), ("month_ym", I), ("month_date", S), ("member_type", S),
                     ("age_band", S), ("gender", S), ("signup_cnt", L), ("loaded_at", S))
STG_RIDE = _struct(("source_file", S), ("month_ym", I), ("month_date", S), ("station_id", L),
                   ("station_name_raw", S), ("station_name", S), ("pass_type", S),
                   ("pass_group", S), ("gender", S), ("age_band", S), ("ride_cnt", L),
                   ("exercise_amt", D), ("carbon_amt", D), ("distance_m", D),
                   ("duration_min", D), ("is_ops_excluded", I), ("loaded_at", S))
STG_SNAPSHOT = _struct(("snapshot_ym", I), ("source_file", S), ("station_id", L),
                       ("station_name", S), ("district", S), ("address", S), ("lat", D),
                       ("lon", D), ("installed_at_raw", S), ("rack_lcd", L), ("rack_qr", L),
                       ("operation_type", S), ("rack_cnt", L), ("loaded_at", S))
STG_USAGE = _struct(("source_file", S), ("month_ym", I), ("month_date", S), ("district", S),
                    ("station_name_raw", S), ("station_id", L), ("station_name", S),
                    ("checkout_cnt", L), ("return_cnt", L), ("loaded_at", S))

RAW_SCHEMAS = {
    "raw_signup_month": RAW_SIGNUP,
    "raw_ride_month": RAW_RIDE,
    "raw_station_snapshot": RAW_SNAPSHOT,
    "raw_station_usage_month": RAW_USAGE,
}

# month column per table (used for partitioning and coverage checks)
MONTH_COLUMN = {
    "raw_signup_month": "signup_ym",
    "raw_ride_month": "ride_ym",
    "raw_station_snapshot": "snapshot_ym",
    "raw_station_usage_month": "usage_ym",
    "stg_signup_month": "month_ym",
    "stg_ride_month": "month_ym",
    "stg_station_snapshot": "snapshot_ym",
    "stg_station_usage_month": "month_ym",
    "stg_month_station_snapshot_map": "month_ym",
    "mart_signup_segment_month": "month_ym",
    "mart_ride_segment_month": "month_ym",
    "mart_growth_month": "month_ym",
    "mart_station_efficiency_month": "month_ym",
}

RAW_TABLES = tuple(RAW_SCHEMAS)
STG_TABLES = ("stg_signup_month", "stg_ride_month", "stg_station_snapshot",
              "stg_station_usage_month", "stg_month_station_snapshot_map")
MART_TABLES = ("mart_signup_segment_month", "mart_ride_segment_month",
               "mart_growth_month", "mart_station_efficiency_month")
