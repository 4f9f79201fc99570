"""Incremental file ingest: each file loaded once across runs, retries idempotent."""

import os

from pedalytics.streaming.incremental import ingest_new_files, read_ingested

HEADER = "가입년월,회원구분,연령대,성별,가입건수\n"


def drop(folder, name, body, enc="cp949"):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write((HEADER + body).encode(enc))


def test_new_files_are_appended_once(spark, tmp_root):
    src, out, ckpt = (os.path.join(tmp_root, d) for d in ("src", "out", "ckpt"))
    folder = os.path.join(src, "signup_month")
    drop(folder, "서울특별시 공공자전거 신규가입자 정보(월별)_24.1-6.csv", "202401,개인,20대,M,5\n202402,개인,20대,F,3\n")
    drop(folder, "unrelated.csv", "1,2,3,4,5\n")
    q = ingest_new_files(spark, src, "signup_month", out, checkpoint=ckpt, loaded_at="L")
    q.awaitTermination()
    assert read_ingested(spark, out, "signup_month").count() == 2
    drop(folder, "서울특별시 공공자전거 신규가입자 정보(월별)_24.7-12.csv", "202407,단체,30대,M,7\n", "utf-8-sig")
    q = ingest_new_files(spark, src, "signup_month", out, checkpoint=ckpt, loaded_at="L")
    q.awaitTermination()
    rows = read_ingested(spark, out, "signup_month").collect()
    assert sorted((r.signup_ym, r.signup_cnt_raw) for r in rows) == [(202401, 5), (202402, 3), (202407, 7)]
    q = ingest_new_files(spark, src, "signup_month", out, checkpoint=ckpt, loaded_at="L")
    q.awaitTermination()
    assert read_ingested(spark, out, "signup_month").count() == 3
