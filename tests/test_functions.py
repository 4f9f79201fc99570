"""Column functions against the source engine's semantics."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pedalytics.functions import columns as C


def one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,expected", [
    ("10.0", 10), ("12abc", 12), ("nan", 0), ("", 0), ("  7", 7), ("-3x", -3), ("+5", 5),
    ("abc", 0), ("9980", 9980), ("9980.0", 9980), (None, None),
])
def test_lenient_long(spark, text, expected):
    assert one(spark, C.lenient_long, text) == expected


@pytest.mark.parametrize("text,expected", [
    (".25", 0.25), ("12.", 12.0), ("1e3", 1000.0), ("nan", 0.0), ("inf", 0.0), ("", 0.0),
    ("49.5", 49.5), ("-2.5kg", -2.5), (None, None),
])
def test_lenient_double(spark, text, expected):
    assert one(spark, C.lenient_double, text) == expected


def _model_long(s):
    import re
    if s is None:
        return None
    m = re.match(r"^\s*([+-]?[0-9]+)", s)
    if not m:
        return 0
    v = int(m.group(1))
    return v if -2**63 <= v < 2**63 else 0


@settings(max_examples=1, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="0123456789+-. eanx,", max_size=8)),
                min_size=50, max_size=200))
def test_lenient_long_matches_prefix_model(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r["r"] for r in df.select(C.lenient_long("v").alias("r")).collect()]
    assert got == [_model_long(v) for v in values]


@pytest.mark.parametrize("text,expected", [
    (None, "nan"), ("", "nan"), ("NaN", "nan"), ("NULL", "nan"), ("N/A", "nan"), ("None", "nan"),
    (" M", "M"), ("\t30대 \n", "30대"), ("0", "0"),
])
def test_null_tokens(spark, text, expected):
    assert one(spark, C.null_tokens, text) == expected


@pytest.mark.parametrize("text,expected", [("12", 12), ("12.0", 12), (" 12 ", 12), ("12.5", None),
                                           ("x", None), ("nan", None), (None, None)])
def test_to_int_coerce(spark, text, expected):
    assert one(spark, C.to_int_coerce, text) == expected


def test_month_date(spark):
    assert one(spark, C.month_date, 202401, "int") == "2024-01-01"
    assert one(spark, C.month_date, None, "int") is None


@pytest.mark.parametrize("text,sid,name", [
    ("207. 여의나루역", 207, "여의나루역"), (" 5. Station 5.2 ", 5, "Station 5.2"),
    ("Station 9", None, "Station 9"), ("nan", None, "nan"), (".x", 0, "x"),
])
def test_station_split(spark, text, sid, name):
    assert one(spark, C.station_id_from_name, text) == sid
    assert one(spark, C.station_name_from_name, text) == name


@pytest.mark.parametrize("raw,band", [(None, "UNKNOWN"), ("", "UNKNOWN"), ("nan", "UNKNOWN"),
                                      (" None ", "UNKNOWN"), (" 30대 ", "30대"), ("기타", "기타")])
def test_age_band(spark, raw, band):
    assert one(spark, C.age_band, raw) == band


@pytest.mark.parametrize("raw,g", [(" m", "M"), ("F ", "F"), ("f", "F"), ("nan", "UNKNOWN"),
                                   (None, "UNKNOWN"), ("X", "UNKNOWN")])
def test_gender(spark, raw, g):
    assert one(spark, C.gender, raw) == g


@pytest.mark.parametrize("raw,grp", [(" 정기권", "SUBSCRIPTION"), ("일일권", "NON_SUBSCRIPTION"),
                                     (None, "NON_SUBSCRIPTION")])
def test_pass_group(spark, raw, grp):
    assert one(spark, C.pass_group, raw) == grp


def test_rack_cnt_branches(spark):
    rows = [("QR", 3, 8), ("QR", 3, None), ("LCD", 3, 8), ("LCD", None, 8), ("LCD,QR", 3, 8),
            ("LCD,QR", None, None), ("OTHER", 3, 8), ("OTHER", 3, None), (None, None, None)]
    df = spark.createDataFrame(rows, "op string, lcd long, qr long")
    got = [r[0] for r in df.select(C.rack_cnt("op", "lcd", "qr")).collect()]
    assert got == [8, 0, 3, 0, 11, 0, 8, 3, 0]


def test_ops_flag_ignores_ascii_case(spark):
    rows = [("9980", "x"), ("9980.0", "x"), ("1", "중랑 as센터"), ("1", "AS센터"), ("1", "x"),
            (None, None), ("nan", "센터")]
    df = spark.createDataFrame(rows, "i string, n string")
    assert [r[0] for r in df.select(C.ops_flag(C.lenient_long("i"), "n")).collect()] == [1, 1, 1, 1, 0, 0, 0]


def test_round_half_away_from_zero(spark):
    df = spark.createDataFrame([(7943, 8), (7553, 8), (201, 20000)], "a long, b long")
    got = [r[0] for r in df.select(C.round_half_up(F.col("a") / F.col("b"), 2)).collect()]
    assert got == [992.88, 944.13, 0.01]


def test_safe_ratio_is_double_and_guarded(spark):
    df = spark.createDataFrame([(7, 2), (1, 0), (1, None)], "a long, b long")
    out = df.select(C.safe_ratio("a", "b").alias("r"))
    assert dict(out.dtypes)["r"] == "double"
    assert [r[0] for r in out.collect()] == [3.5, None, None]


def test_snapshot_ym_from_name(spark):
    assert one(spark, C.snapshot_ym_from_name, "공공자전거 대여소 정보(24.6월 기준).xlsx") == 202406
    assert one(spark, C.snapshot_ym_from_name, "공공자전거 대여소 정보(23.12월 기준).xlsx") == 202312
    assert one(spark, C.snapshot_ym_from_name, "other.xlsx") is None


def test_decoded_file_name(spark):
    assert one(spark, C.decoded_file_name, "a%20b+c.csv") == "a b+c.csv"


def test_keyword_score(spark):
    assert one(spark, C.keyword_score, "대여소 번호 자치구 위도") == 3
    assert one(spark, C.keyword_score, None) == 0


def test_strip_all_matches_python_strip(spark):
    vals = ["　 30대\xa0\t", " x ", "y ", "", "a b", "\x1c\n"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    assert [r[0] for r in df.select(C.strip_all("v")).collect()] == [v.strip() for v in vals]
