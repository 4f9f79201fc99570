"""File ingest on hand-made files: encodings, BOM, drift, failures, workbooks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pedalytics.functions import columns as C
from pedalytics.operators import filecheck
from pedalytics.sources import files, loaders, xlsx

RIDE_HEADER = "대여일자,대여소번호,대여소명,대여구분코드,성별,연령대코드,이용건수,운동량,탄소량,{},이용시간(분)\n"


def write(path, text, enc):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text.encode(enc) if isinstance(text, str) else text)


def test_detect_one():
    assert files.detect_one(["가입년월,성별".encode("cp949"), "202401,M".encode("cp949")])[0] == "cp949"
    assert files.detect_one(["가입년월,성별".encode("utf-8-sig")]) == ("utf-8-sig", ("가입년월", "성별"))
    assert files.detect_one([b"a,b", b"1,2"]) == ("utf-8-sig", ("a", "b"))
    assert files.detect_one([b"\xff\xff\xff"]) == (None, ())
    assert files.detect_one([]) == ("utf-8-sig", ())


def test_header_index():
    index = files.HeaderIndex(["대여 일자", "이용거리(M)", "이용시간\n(분)"])
    assert index.find(("대여일자",)) == "대여 일자"
    assert index.find(("이동거리(M)", "이용거리(M)")) == "이용거리(M)"
    assert index.find(("이용시간(분)",)) == "이용시간\n(분)"
    assert index.find(("없음",)) is None
    unsure = files.HeaderIndex(["이용시간", "거리(M)", "거리(km)"])
    assert unsure.find(("거리",)) == "거리(M)" and unsure.doubts == [("거리", "거리(M)", ["거리(km)"])]
    assert files.HeaderIndex(["거리 (km)", "거리"]).find(("거리",)) == "거리"


def test_ride_csv_mixed_encodings_and_drift(spark, tmp_root):
    d = os.path.join(tmp_root, "ride_month")
    write(os.path.join(d, "서울특별시 공공자전거 이용정보(월별)_23.7-12.csv"),
          RIDE_HEADER.format("이용거리(M)") + "202312,102, 102. 망원역 ,정기권, m ,20대,3,1.5,,\"1,200\",9\n",
          "cp949")
    write(os.path.join(d, "서울특별시 공공자전거 이용정보(월별)_24.1-6.csv"),
          RIDE_HEADER.format("이동거리(M)") + "202401,nan,Station X,일일권,NaN,,2,nan,.25,300,4\n"
          "202402,,Y,일일권,F,기타,x,1,1,1,1\n",
          "utf-8-sig")
    raw = loaders.load_raw_ride_month(spark, tmp_root, "L")
    rows = {r.ride_ym: r for r in raw.collect()}
    a, b, c = rows[202312], rows[202401], rows[202402]
    assert a.source_file == "서울특별시 공공자전거 이용정보(월별)_23.7-12.csv"
    assert (a.station_name_raw, a.gender_raw, a.distance_m_raw, a.carbon_amt_raw) == \
        ("102. 망원역", "m", "1,200", "nan")
    assert (b.station_id_raw, b.gender_raw, b.age_band_raw, b.distance_m_raw) == ("nan", "nan", "nan", "300")
    assert c.station_id_raw == "nan" and c.ride_cnt_raw is None and c.loaded_at == "L"
    checks = {r.file_name: r for r in filecheck.csv_file_check(spark, tmp_root, "ride_month").collect()}
    assert sorted(r.encoding for r in checks.values()) == ["cp949", "utf-8-sig"]
    assert {r.row_count for r in checks.values()} == {1, 2}
    assert all(r.status == "ok" for r in checks.values())


def test_undecodable_file_is_a_failed_row(spark, tmp_root):
    d = os.path.join(tmp_root, "signup_month")
    write(os.path.join(d, "서울특별시 공공자전거 신규가입자 정보(월별)_bad.csv"), b"\xff\xff,\xff\n1,2\n", None)
    write(os.path.join(d, "서울특별시 공공자전거 신규가입자 정보(월별)_ok.csv"),
          "가입년월,회원구분,연령대,성별,가입건수\n202401,개인,20대,M,5\n", "cp949")
    out = {r.file_name.rsplit("_", 1)[-1]: r for r in
           filecheck.csv_file_check(spark, tmp_root, "signup_month").collect()}
    assert out["bad.csv"].status == "fail: cannot detect encoding"
    assert out["bad.csv"].encoding == "READ_FAILED" and out["bad.csv"].row_count is None
    assert (out["ok.csv"].status, out["ok.csv"].row_count, out["ok.csv"].period_min) == ("ok", 1, 202401)
    with pytest.raises(files.UnreadableFiles, match="_bad.csv"):
        loaders.load_raw_signup_month(spark, tmp_root, "L")


SIGNUP = "서울특별시 공공자전거 신규가입자 정보(월별)_x.csv"
SIGNUP_HEADER = "가입년월,회원구분,연령대,성별,가입건수\n"


@pytest.mark.parametrize(("body", "problem"), [
    (("202401,개인,20대,M,5\n" * 9).encode() + "202409,개인,30대,M,5\n".encode("cp949"), "bytes that do not decode"),
    ("202401,개인,20대,M,5,extra\n".encode(), "malformed row"),
    ("202401,개인,20대\n".encode(), "malformed row"),
    ('202401,"개\n인",20대,M,5\n202401,개인,20대\n'.encode(), "malformed row"),
    ('202401,"개인,20대,M,5\n202402,단체,20대,M,5\n'.encode(), "a quote that never ends"),
    ('202401,개인,20대,M,"5\n202402,단체,20대,M,5\n'.encode(), "a quote that never ends"),
])
def test_bad_rows_stop_the_load_and_are_reported(spark, tmp_root, body, problem):
    write(os.path.join(tmp_root, "signup_month", SIGNUP), SIGNUP_HEADER.encode() + body, None)
    with pytest.raises(Exception, match=problem):
        loaders.load_raw_signup_month(spark, tmp_root, "L").select("signup_ym").collect()
    chk = filecheck.csv_file_check(spark, tmp_root, "signup_month").first()
    assert chk.status.startswith("fail: ") and problem in chk.status and chk.row_count is None


def test_quotes_numbers_and_empty_files(spark, tmp_root):
    write(os.path.join(tmp_root, "signup_month", SIGNUP), SIGNUP_HEADER
          + '202401,"개""인"" x","a,b",M,9007199254740993\n99999999999,단체,30대,F,12.0\n', "cp949")
    write(os.path.join(tmp_root, "signup_month", SIGNUP.replace("_x", "_y")), SIGNUP_HEADER, "cp949")
    rows = loaders.load_raw_signup_month(spark, tmp_root, "L").orderBy("signup_ym").collect()
    assert [(r.signup_ym, r.member_type_raw, r.age_band_raw, r.signup_cnt_raw) for r in rows] == [
        (None, "단체", "30대", 12), (202401, '개"인" x', "a,b", 9007199254740993)]
    chk = {r.file_name[-5]: r for r in filecheck.csv_file_check(spark, tmp_root, "signup_month").collect()}
    assert (chk["y"].row_count, chk["y"].status, chk["x"].row_count) == (0, "ok", 2)


def test_numeric_text(spark):
    values = ["207", "207D", "207f", " 12.0 ", "1e2", "0x1F", "9007199254740993", "nan", "inf", "1.5", "", None, "1" * 30]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select("v", C.is_numeric_text("v").alias("n"), C.to_int_coerce("v").alias("i")).collect()
    assert {r.v: (r.n, r.i) for r in got} == {
        "207": (True, 207), "207D": (False, None), "207f": (False, None), " 12.0 ": (True, 12), "1e2": (True, 100),
        "0x1F": (False, None), "9007199254740993": (True, 9007199254740993), "nan": (False, None), "inf": (True, None),
        "1.5": (True, None), "": (False, None), None: (False, None), "1" * 30: (True, None)}


def test_preview_has_all_datasets_and_failures(spark, tmp_root):
    write(os.path.join(tmp_root, "signup_month", SIGNUP), SIGNUP_HEADER + "202401,,20대,M,5\n202402,a,b,c,1\n202403,a,b,c,1\n",
          "cp949")
    write(os.path.join(tmp_root, "ride_month", "서울특별시 공공자전거 이용정보(월별)_x.csv"), b"\xff\xff\n", None)
    write(os.path.join(tmp_root, "station_snapshot", "공공자전거 대여소 정보(24.6월 기준).xlsx"),
          xlsx.write_workbook([("102", "망원역")]), None)
    got = {r.dataset_key: r for r in filecheck.sample_preview(spark, tmp_root).collect()}
    assert json.loads(got["signup_month"].sample_json) == [
        {"가입년월": 202401, "회원구분": None, "연령대": "20대", "성별": "M", "가입건수": 5},
        {"가입년월": 202402, "회원구분": "a", "연령대": "b", "성별": "c", "가입건수": 1}]
    failed = got["ride_month"]
    assert (failed.encoding, failed.columns, failed.sample_json) == (None, None, "failed: cannot detect encoding")
    sheet = {r.dataset_key: r for r in filecheck.sample_preview(spark, tmp_root, 3).collect()}["station_snapshot"]
    assert [r["대여소\n번호"] for r in json.loads(sheet.sample_json)] == [None, None, 102.0]
    assert sheet.columns.startswith("대여소\n번호, ") and "Unnamed: 8" in sheet.columns
    assert filecheck.sample_preview(spark, tmp_root + "/none").count() == 0


@pytest.mark.parametrize(("cells", "typed"), [
    (["1", "-2", " 3"], [1, -2, 3]), (["1", None, "3"], [1.0, None, 3.0]), (["1", "2.5", ".5"], [1.0, 2.5, 0.5]),
    (["1", "x", None], ["1", "x", None]), ([None, None], [None, None]), (["True", "false"], [True, False]),
    (["9" * 30, "1"], [1e30, 1.0]), (["1,200", "3"], ["1,200", "3"]), ([], [])])
def test_typed_column(cells, typed):
    got = filecheck.typed_column(cells)
    assert got == typed and list(map(type, got)) == list(map(type, typed))


def test_preview_of_quoted_line_breaks_and_slashes(spark, tmp_root):
    write(os.path.join(tmp_root, "signup_month", SIGNUP), SIGNUP_HEADER + '202401,"개\n인",a/b,M,5\n202402,a,b,c,1.5\n', "cp949")
    got = filecheck.sample_preview(spark, tmp_root).first()
    assert "a\\/b" in got.sample_json
    assert [r["회원구분"] for r in json.loads(got.sample_json)] == ["개\n인", "a"]
    assert [r["가입건수"] for r in json.loads(got.sample_json)] == [5.0, 1.5]


def test_only_files_with_open_quotes_are_read_whole(spark, tmp_root):
    d = os.path.join(tmp_root, "signup_month")
    write(os.path.join(d, SIGNUP), SIGNUP_HEADER + '202401,"개\n""인""",20대,M,5\n202402,"a, ""b""",x,M,6\n', "cp949")
    write(os.path.join(d, SIGNUP.replace("_x", "_y")), SIGNUP_HEADER + '202403,5" x,"y ""z""",F,7\n', "cp949")
    write(os.path.join(d, SIGNUP.replace("_x", "_z")), SIGNUP_HEADER + '202404,"여러\n\n줄,",20대,M,8\n', "utf-8-sig")
    found = files.mark_open_quotes(spark, files.detect_all(spark, files.find_files(spark, tmp_root, "signup_month")))
    assert [(f.name[-5], f.multiline, f.error) for f in found] == [("x", True, None), ("y", False, None), ("z", True, None)]
    assert sorted((g[0].encoding, g[0].multiline, len(g)) for g in files.csv_groups(found)) == [
        ("cp949", False, 1), ("cp949", True, 1), ("utf-8-sig", True, 1)]
    rows = loaders.load_raw_signup_month(spark, tmp_root, "L").orderBy("signup_ym").collect()
    assert [(r.member_type_raw, r.age_band_raw, r.signup_cnt_raw) for r in rows] == [
        ('개\n"인"', "20대", 5), ('a, "b"', "x", 6), ('5" x', 'y "z"', 7), ("여러\n\n줄,", "20대", 8)]
    chk = filecheck.csv_file_check(spark, tmp_root, "signup_month").collect()
    assert sorted((r.file_name[-5], r.row_count, r.status) for r in chk) == [("x", 2, "ok"), ("y", 1, "ok"), ("z", 1, "ok")]


def test_header_with_a_line_break(spark, tmp_root):
    write(os.path.join(tmp_root, "signup_month", SIGNUP), '가입년월,"회원\n구분",연령대,성별,가입건수\n202401,a,b,c,1\n', "cp949")
    assert loaders.load_raw_signup_month(spark, tmp_root, "L").first().member_type_raw == "a"


def test_detection_takes_one_job_however_many_files(spark, tmp_root):
    def jobs(n):
        root = os.path.join(tmp_root, str(n))
        for i in range(n):
            write(os.path.join(root, "signup_month", SIGNUP.replace("_x", f"_{i:03d} +%20")),
                  SIGNUP_HEADER + f"2024{i % 12 + 1:02d},a,b,c,1\n" * (i % 9), ("cp949", "utf-8-sig")[i % 2])
        paths = files.find_files(spark, root, "signup_month")
        spark.sparkContext.setJobGroup(f"detect-{n}", "")
        found = files.detect_all(spark, paths)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert [f.encoding for f in found] == [("cp949", "utf-8-sig")[i % 2] for i in range(n)]
        assert {f.header for f in found} == {tuple(SIGNUP_HEADER.strip().split(","))}
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"detect-{n}"))
    assert jobs(200) <= jobs(20) + 1 <= 3  # Spark lists many paths by a job of its own


def test_first_lines_stop_early(spark, tmp_root):
    path = os.path.join(tmp_root, "a b.csv")
    write(path, "".join(f"line {i}\n" for i in range(50_000)), "utf-8")
    write(path + "0", b"", None)
    got = files.first_lines(spark, ["file:" + path, "file:" + path + "0"], 3)
    assert list(got.values()) == [[b"line 0", b"line 1", b"line 2"], []]


def test_flat_folder_fallback(spark, tmp_root):
    write(os.path.join(tmp_root, "서울특별시 공공자전거 대여소별 이용정보(월별)_1.csv"),
          "자치구,대여소명,기준년월,대여건수,반납건수\n마포구,102. 망원역,202401,10,9\n", "cp949")
    raw = loaders.load_raw_station_usage_month(spark, tmp_root, "L").collect()
    assert [(r.district_raw, r.station_name_raw, r.usage_ym, r.checkout_cnt_raw) for r in raw] == \
        [("마포구", "102. 망원역", 202401, 10)]


def test_workbook_roundtrip_and_checks(spark, tmp_root):
    rows = [("102", " 망원역 ", "마포구", "addr", "37.55", "126.9", "2015-09-01", "nan", "10", "QR"),
            ("합계", "x", None, None, None, None, None, None, None, None),
            (None,) * 10]
    path = os.path.join(tmp_root, "station_snapshot", "공공자전거 대여소 정보(24.6월 기준).xlsx")
    write(path, xlsx.write_workbook(rows), None)
    names, used, sheet = xlsx.read_sheet(open(path, "rb").read())
    assert names == ["대여소현황"] and used == "대여소현황"
    assert sheet[2][0] == 2 and sheet[2][1][0] == "대여소\n번호"
    raw = loaders.load_raw_station_snapshot(spark, tmp_root, "L").collect()
    assert len(raw) == 1
    r = raw[0]
    assert (r.snapshot_ym, r.station_id_raw, r.station_name_raw, r.rack_lcd_raw, r.rack_qr_raw) == \
        (202406, "102", "망원역", "nan", "10")
    chk = filecheck.xlsx_file_check(spark, tmp_root).first()
    assert (chk.header_row_0_based, chk.row_count_after_header, chk.status) == (2, 2, "ok")
    assert chk.columns.startswith("대여소 번호, 보관소(대여소)명, 자치구")


STYLES = {"0": False, "General": False, "yyyy-mm-dd": True, "m/d/yy h:mm": True, "[h]:mm:ss": True, '0.0"days"': False,
          "[Red]0.00": False, "0\\d": False, "#,##0_d": False, "mm:ss.0": True, "[$-412]yyyy년": True, "@": False, "* d": True}


@pytest.mark.parametrize("code", STYLES)
def test_number_formats_that_show_dates(code):
    assert xlsx.shows_dates(code) == STYLES[code] or code == "* d"


def test_serial_numbers():
    assert xlsx.date_text(42248) == "2015-09-01 00:00:00" and xlsx.date_text(42248.5) == "2015-09-01 12:00:00"
    assert xlsx.date_text(42248 + 1 / 86400 * 1.25) == "2015-09-01 00:00:01.250000"
    assert (xlsx.date_text(1), xlsx.date_text(59), xlsx.date_text(61)) == (
        "1900-01-01 00:00:00", "1900-02-28 00:00:00", "1900-03-01 00:00:00")
    assert xlsx.date_text(0.375) == "09:00:00" and xlsx.date_text(0, True) == "00:00:00"
    assert xlsx.date_text(1462, True) == "1908-01-02 00:00:00"


def _edited(book, **parts):
    import io
    import zipfile
    src, buf = zipfile.ZipFile(io.BytesIO(book)), io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for n in src.namelist():
            body = src.read(n)
            for name, (old, new) in parts.items():
                if n.endswith(f"{name}.xml"):
                    body = body.replace(old, new)
            z.writestr(n, body)
    return buf.getvalue()


def _station(i, installed):
    return (str(i), f"s{i}", "d", "a", "37", "127", installed, "1", "nan", "QR")


def test_date_cells(spark, tmp_root):
    d = os.path.join(tmp_root, "station_snapshot")
    books = {"23.12": ["2015-09-01 00:00:00", "2016-01-02 00:00:00", None],   # dates only
             "24.6": ["2015-09-01 00:00:00", "2016-01-02 10:30:00", None],    # moments
             "24.12": ["2015-09-01 00:00:00", "42248", "soon", None]}          # mixed with a number and a text
    for name, cells in books.items():
        rows = [_station(i, c) for i, c in enumerate(cells)] + [("total", "x", None, None, None, None, None, None, None, None)]
        write(os.path.join(d, f"공공자전거 대여소 정보({name}월 기준).xlsx"), xlsx.write_workbook(rows), None)
    old = xlsx.write_workbook([_station(1, "2015-09-01 00:00:00")])
    write(os.path.join(d, "공공자전거 대여소 정보(25.6월 기준).xlsx"), _edited(old, workbook=(
        b"<sheets>", b'<workbookPr date1904="1"/><sheets>')), None)
    raw = loaders.load_raw_station_snapshot(spark, tmp_root, "L").orderBy("snapshot_ym", "station_id_raw")
    got = {}
    for r in raw.collect():
        got.setdefault(r.snapshot_ym, []).append(r.installed_at_raw)
    assert got == {202312: ["2015-09-01", "2016-01-02", "NaT"], 202406: ["2015-09-01 00:00:00", "2016-01-02 10:30:00", "NaT"],
                   202412: ["2015-09-01 00:00:00", "42248", "soon", "nan"], 202506: ["2019-09-02"]}


def test_odd_cells():
    book = xlsx.write_workbook([_station(1, "2015-09-01 00:00:00")])
    serial = b"<v>42248.0</v>"
    for old, new, want in ((b' s="1"><v>42248.0</v>', b' t="e"><v>#N/A</v>', None), (b' s="1"><v>42248.0</v>', b' t="b"><v>1</v>', "True"),
                           (b' s="1"><v>42248.0</v>', b' t="d"><v>2015-09-01T00:00:00</v>', "2015-09-01 00:00:00"),
                           (serial, b"<v/>", None), (b' s="1"', b' s="7"', "42248.0")):
        rows = xlsx.read_sheet(_edited(book, sheet1=(old, new)))[2]
        assert rows[-1][1][6] == want


def test_long_sheets_are_read_in_bounded_memory():
    import tracemalloc
    book = xlsx.write_workbook([_station(i, f"text {i}") for i in range(60_000)])
    peaks = []
    for most in (2_000, 60_100):
        tracemalloc.start()
        rows = sum(len(f) for f in xlsx.sheet_frames("p", book, most))
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
        assert rows == 60_005
    assert peaks[0] < 25 and peaks[1] > 3 * peaks[0]  # all rows at once, as before, take many times as much


def test_a_sheet_that_breaks_off_reports_failure(spark, tmp_root):
    book = xlsx.write_workbook([_station(i, "x") for i in range(20)])
    broken = _edited(book, sheet1=(b"</sheetData></worksheet>", b"</wrong>"))
    frames = list(xlsx.sheet_frames("p", broken, 10))
    assert frames[-1]["error"].iloc[0].startswith("ParseError") and sum(f["error"].isna().sum() for f in frames) >= 10
    write(os.path.join(tmp_root, "station_snapshot", "공공자전거 대여소 정보(25.6월 기준).xlsx"), broken, None)
    with pytest.raises(Exception, match="ParseError"):
        loaders.load_raw_station_snapshot(spark, tmp_root, "L").count()


def test_broken_workbook_reports_failure(spark, tmp_root):
    write(os.path.join(tmp_root, "station_snapshot", "공공자전거 대여소 정보(25.6월 기준).xlsx"),
          b"not a zip", None)
    chk = filecheck.xlsx_file_check(spark, tmp_root).first()
    assert chk.snapshot_ym == 202506 and chk.status.startswith("fail: BadZipFile")
    with pytest.raises(Exception, match="BadZipFile"):
        loaders.load_raw_station_snapshot(spark, tmp_root, "L").count()


def test_part_folders_are_one_logical_file(spark, tmp_root):
    d = os.path.join(tmp_root, "signup_month", "서울특별시 공공자전거 신규가입자 정보(월별)_x.csv")
    for i in range(3):
        write(os.path.join(d, f"part-{i:05d}-0000.csv"),
              f"가입년월,회원구분,연령대,성별,가입건수\n20240{i + 1},개인,20대,M,{i}\n", "cp949")
    raw = loaders.load_raw_signup_month(spark, tmp_root, "L")
    assert raw.select("source_file").distinct().collect()[0][0].endswith("_x.csv")
    assert raw.agg(F.sum("signup_cnt_raw")).first()[0] == 3


def test_shared_strings_rich_text_and_phonetic_runs():
    from xml.etree import ElementTree as ET
    m = xlsx.NS["m"]
    si = ET.fromstring(f'<si xmlns="{m}"><r><t>망원</t></r><r><t>역</t></r>'
                       '<rPh sb="0" eb="1"><t>phonetic</t></rPh></si>')
    assert xlsx._text(si) == "망원역"
    plain = ET.fromstring(f'<si xmlns="{m}"><t xml:space="preserve"> 대여소 </t></si>')
    assert xlsx._text(plain) == " 대여소 "


def test_workbook_without_cell_references():
    import io
    import re
    import zipfile
    src = zipfile.ZipFile(io.BytesIO(xlsx.write_workbook([("7", "x")])))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for n in src.namelist():
            body = src.read(n)
            if n == "xl/worksheets/sheet1.xml":
                body = re.sub(rb' r="[A-Z0-9]+"', b"", body)
            z.writestr(n, body)
    _, _, rows = xlsx.read_sheet(buf.getvalue())
    assert [r[0] for r in rows] == list(range(len(rows)))
    assert rows[-1][1][:2] == ["7", "x"]
