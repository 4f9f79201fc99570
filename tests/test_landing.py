"""Landing: files are parsed once, checked from what was stored, and only new or changed files are read again."""

import os

import pytest
from pyspark.sql import functions as F

from pedalytics.operators import filecheck
from pedalytics.plans import stages
from pedalytics.sources import files, landing, loaders

HEADER = "가입년월,회원구분,연령대,성별,가입건수\n"


def write(root, name, body, enc="cp949", dataset="signup_month"):
    path = os.path.join(root, dataset, f"서울특별시 공공자전거 신규가입자 정보(월별)_{name}.csv")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(body.encode(enc) if isinstance(body, str) else body)
    return path


def signups(spark, out, entries):
    rows = loaders.load_landed(spark, out, "signup_month", entries, "L").collect()
    return sorted((r.signup_ym, r.member_type_raw, r.signup_cnt_raw) for r in rows)


def by_file(entries):
    return {e["file_name"][-5]: e for e in entries}


@pytest.fixture()
def folders(tmp_path):
    return str(tmp_path / "src"), str(tmp_path / "out")


def test_landed_rows_and_checks_equal_the_direct_ones(spark, folders):
    src, out = folders
    write(src, "a", HEADER + "202401,개인,20대,M,5\n202403,단체,20대,M,6\n")
    write(src, "b", HEADER + '202402,"개\n인",20대,M,7\n', "utf-8-sig")
    write(src, "c", HEADER)
    entries = landing.land(spark, src, out)
    assert signups(spark, out, entries) == [(202401, "개인", 5), (202402, "개\n인", 7), (202403, "단체", 6)]
    direct = filecheck.csv_file_check(spark, src, "signup_month").orderBy("file_name").collect()
    assert filecheck.landed_file_checks(spark, entries).orderBy("file_name").collect() == direct
    assert landing.rejected_rows(spark, out, entries).count() == 0


def test_only_new_and_changed_files_are_read(spark, folders, monkeypatch):
    src, out = folders
    write(src, "a", HEADER + "202401,개인,20대,M,5\n")
    write(src, "b", HEADER + "202402,개인,20대,M,6\n")
    first = by_file(landing.land(spark, src, out))
    read = []
    group = files.read_csv_group
    monkeypatch.setattr(files, "read_csv_group", lambda s, g: read.extend(f.name[-5] for f in g) or group(s, g))
    assert by_file(landing.land(spark, src, out)) == first and read == []
    write(src, "c", HEADER + "202403,개인,20대,M,7\n")
    entries = landing.land(spark, src, out)
    assert read == ["c"] and by_file(entries)["a"] == first["a"]
    write(src, "b", HEADER + "202405,단체,20대,M,8\n202406,단체,20대,M,9\n")
    os.remove(write(src, "a", ""))
    entries = landing.land(spark, src, out)
    assert read == ["c", "b"]
    assert signups(spark, out, entries) == [(202403, "개인", 7), (202405, "단체", 8), (202406, "단체", 9)]
    checks = {r.file_name[-5]: (r.row_count, r.period_min, r.period_max) for r in filecheck.landed_file_checks(spark, entries).collect()}
    assert checks == {"b": (2, 202405, 202406), "c": (1, 202403, 202403)}


def test_broken_files_keep_their_encoding_and_rows_are_stored(spark, folders):
    src, out = folders
    write(src, "a", HEADER + "202401,개인,20대,M,5\n202402,개인,20대\n")
    write(src, "b", (HEADER + "202401,개인,20대,M,5\n" * 9).encode() + "202409,개인,30대,M,5\n".encode("cp949"))
    write(src, "c", HEADER + '202401,"개인,20대,M,5\n202402,단체,20대,M,5\n')
    write(src, "d", b"\xff\xff\n")
    write(src, "e", HEADER + "202407,개인,20대,M,5\n")
    entries = landing.land(spark, src, out)
    rows = {r.file_name[-5]: r for r in filecheck.landed_file_checks(spark, entries).collect()}
    assert {k: (r.encoding, r.row_count) for k, r in rows.items()} == {
        "a": ("cp949", None), "b": ("utf-8-sig", None), "c": ("cp949", None), "d": ("READ_FAILED", None), "e": ("cp949", 1)}
    assert [rows[k].status.split(": ", 1)[1] for k in "abcd"] == [
        "1 rows: malformed row", "1 rows: bytes that do not decode", "a quote that never ends", "cannot detect encoding"]
    rejected = landing.rejected_rows(spark, out, entries).collect()
    assert sorted((r.file_name[-5], r.problem) for r in rejected) == [("a", "malformed row"), ("b", "bytes that do not decode")]
    with pytest.raises(files.UnreadableFiles, match="_a.csv.*malformed"):
        landing.require_clean(entries)
    with pytest.raises(Exception, match="unreadable source file"):
        loaders.load_landed(spark, out, "signup_month", entries, "L").count()
    with pytest.raises(files.UnreadableFiles):
        stages.run(spark, out, source_root=src)
    assert stages.read_table(spark, out, "rejected_rows").count() == 2


def test_broken_quotes_that_leave_whole_rows_are_seen(spark, folders):
    src, out = folders
    write(src, "a", HEADER + '202401,개인,20대,M,"5\n202402,단체,20대,M,5\n')
    write(src, "b", HEADER + '202401,개인,20대,M,"5\n202402,단체,20대,M,6"\n')
    entries = by_file(landing.land(spark, src, out))
    assert entries["a"]["error"] == "a quote that never ends"
    assert (entries["b"]["error"], entries["b"]["row_count"], entries["b"]["bad"]) == (None, 1, 0)


def test_header_doubts_are_stored(spark, folders):
    src, out = folders
    write(src, "a", "가입년월,회원구분,연령대(만),연령대(구),성별,가입건수\n202401,개인,x,y,M,5\n")
    entries = landing.land(spark, src, out)
    told = landing.header_doubts(spark, entries).collect()
    assert [(r.dataset, r.column_name, r.taken, r.others) for r in told] == [("signup_month", "연령대", "연령대(만)", "연령대(구)")]
    assert loaders.load_landed(spark, out, "signup_month", entries, "L").first().age_band_raw == "x"
    landing.require_clean(entries)


def test_each_file_is_scanned_once_after_detection(spark, folders, monkeypatch):
    src, out = folders
    for name in "ab":
        write(src, name, HEADER + "202401,개인,20대,M,5\n")
    scans = []
    group = files.read_csv_group
    monkeypatch.setattr(files, "read_csv_group", lambda s, g: scans.extend(f.name[-5] for f in g) or group(s, g))
    entries = landing.land(spark, src, out)
    raw = loaders.load_landed(spark, out, "signup_month", entries, "L")
    assert raw.agg(F.sum("signup_cnt_raw")).first()[0] == 10 and sorted(scans) == ["a", "b"]
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan.lower() and "csv" not in plan.lower()
    empty = landing.land(spark, src + "-none", out + "-none")
    assert empty == [] and loaders.load_landed(spark, out + "-none", "ride_month", empty).count() == 0
