"""File scan: latin-1 bytes, alias headers, CSV null tokens, month from the file name;
and the streaming incremental ingest."""

import datetime as dt
import os

from cardpulse.sources import files
from cardpulse.streaming import snapshot_ingest


def _write(path, text):
    with open(path, "wb") as f:
        f.write(text.encode("latin-1"))


def test_snapshot_csv_scan(spark, tmp_dir):
    _write(os.path.join(tmp_dir, "prime_JUL_2025.csv"),
           'RIM_NO,NAME,Card account status \n"1,234",caf\xe9,CLSB\n,NA,\n  ,x,y\n')
    df = files.read_snapshots(spark, tmp_dir)
    assert {"RIMNO", "PRODUCT_NAME", "CARD_STATUS", "SNAP_MONTH"} <= set(df.columns)
    clean = files.clean_snapshots(df)
    rows = sorted(clean.collect(), key=lambda r: (r["PRODUCT_NAME"] is None, r["PRODUCT_NAME"] or ""))
    assert [r["PRODUCT_NAME"] for r in rows] == ["caf\xe9", "x", None]
    assert [r["RIMNO"] for r in rows] == ["1234", None, None]
    assert all(r["SNAP_MONTH"] == dt.date(2025, 7, 1) for r in rows)


def test_streaming_ingest(spark, tmp_dir):
    landing = os.path.join(tmp_dir, "landing")
    os.makedirs(landing)
    _write(os.path.join(landing, "prime_JUL_2025.csv"), "RIMNO,ACTIVATED\n1,a \n2,I\n")
    _write(os.path.join(landing, "prime_AUG_2025.csv"), "ACTIVATED,NAME,RIM_NO\nA,GOLD,1\n")
    q = snapshot_ingest(spark, landing, os.path.join(tmp_dir, "table"), os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(tmp_dir, "table"))
    got = sorted((str(r["SNAP_MONTH"]), r["RIMNO"], r["ACTIVATED"]) for r in out.collect())
    assert got == [("2025-07-01", "1", "A"), ("2025-07-01", "2", "I"), ("2025-08-01", "1", "A")]


def test_unlike_headers_are_united_by_name(spark, tmp_dir):
    _write(os.path.join(tmp_dir, "prime_JUL_2025.csv"), "RIM_NO,NAME,ACTIVATED\n1,GOLD,A\n")
    _write(os.path.join(tmp_dir, "prime_AUG_2025.csv"), "NAME,ACTIVATED,RIMNO,CREDIT_LIMIT\nSILVER,I,2,100\n")
    _write(os.path.join(tmp_dir, "other.csv"), "RIMNO,RIM_NO,STATUS\n3,x,NORM\n")
    df = files.clean_snapshots(files.read_snapshots(spark, tmp_dir))
    got = {(r["RIMNO"], r["PRODUCT_NAME"], r["ACTIVATED"], r["CREDIT_LIMIT"], r["STATUS"], str(r["SNAP_MONTH"])) for r in df.collect()}
    assert got == {("1", "GOLD", "A", None, None, "2025-07-01"), ("2", "SILVER", "I", 100.0, None, "2025-08-01"),
                   ("3", None, None, None, "NORM", "1900-01-01")}
    absent = files.absent_columns(spark, tmp_dir)
    assert absent[dt.date(2025, 7, 1)] == {"CREDIT_LIMIT", "STATUS", "RIM_NO"}
    assert [tuple(r)[1] for r in files.unmatched_files(spark, tmp_dir).collect()] == ["other"]


def test_quoting(spark, tmp_dir):
    _write(os.path.join(tmp_dir, "prime_JUL_2025.csv"), 'RIMNO,NAME,STATUS\n1,"GOLD ""VIP"", X",NORM\n2,"a\\",LOST\n3,"  ",x\n')
    rows = {r["RIMNO"]: (r["PRODUCT_NAME"], r["STATUS"]) for r in files.read_snapshots(spark, tmp_dir).collect()}
    assert rows == {"1": ('GOLD "VIP", X', "NORM"), "2": ("a\\", "LOST"), "3": ("  ", "x")}


def test_line_ends_in_quotes(spark, tmp_dir):
    _write(os.path.join(tmp_dir, "prime_JUL_2025.csv"), 'RIMNO,NAME\n1,"two\nlines"\n2,one\n')
    rows = {r["RIMNO"]: r["PRODUCT_NAME"] for r in files.read_snapshots(spark, tmp_dir, multi_line=True).collect()}
    assert rows == {"1": "two\nlines", "2": "one"}


def test_transactions_and_declared_dates(spark, tmp_dir):
    _write(os.path.join(tmp_dir, "a.csv"), "RIMNO,DESCRIPTION,EMBEDDED _FEE,TRXN DATE,POST DATE\n007,GOLD,\"1,234.5\",03/04/2025,2025-04-05\n")
    _write(os.path.join(tmp_dir, "b.csv"), "POST DATE,TRXN DATE,RIMNO,CCY\n12/31/2025,31/12/2025,8,818\n")
    formats = {"TRXN_DATE": "dd/MM/yyyy"}
    df = files.read_transactions(spark, tmp_dir, formats=formats)
    got = {r["RIMNO"]: (r["PRODUCT_NAME"], r["EMBEDDED_FEE"], r["TRXN_DATE"], r["POST_DATE"], r["CCY"]) for r in df.collect()}
    assert got == {"7": ("GOLD", 1234.5, dt.datetime(2025, 4, 3), dt.date(2025, 4, 5), None),
                   "8": (None, None, dt.datetime(2025, 12, 31), None, 818)}
    raw = files.read_csv_files(spark, tmp_dir, files.contract.TXN_ALIASES)
    rejects = {r["COLUMN_NAME"]: (r["N_TEXT"], r["N_REJECTED"]) for r in files.date_rejects(raw, df, ["TRXN_DATE", "POST_DATE"]).collect()}
    assert rejects == {"TRXN_DATE": (2, 0), "POST_DATE": (2, 1)}


def test_large_partitions_are_several_files(spark, tmp_dir):
    df = spark.range(100_000).selectExpr("id", "case when id < 99000 then 'big' else 'small' end as SEGMENT")
    out = os.path.join(tmp_dir, "table")
    files.write_partitioned(df, out, ["SEGMENT"], max_rows_per_file=20_000)
    assert len([f for f in os.listdir(os.path.join(out, "SEGMENT=big")) if f.endswith(".parquet")]) >= 5
    back = spark.read.parquet(out)
    assert back.count() == 100_000 and back.select("id").distinct().count() == 100_000
    assert back.where("SEGMENT = 'big'").count() == 99_000


def test_id_list_and_bom(spark, tmp_dir):
    ids = spark.createDataFrame([("3",), ("1",), ("2",)], "RIMNO string")
    files.write_ids(ids, os.path.join(tmp_dir, "ids"), "common ids")
    assert [r[0] for r in spark.read.text(os.path.join(tmp_dir, "ids")).collect()] == ["common ids: 3", "1", "2", "3"]
    files.write_csv(ids.coalesce(1), os.path.join(tmp_dir, "csv"), bom=True)
    part = [f for f in os.listdir(os.path.join(tmp_dir, "csv")) if f.startswith("part")][0]
    assert open(os.path.join(tmp_dir, "csv", part), "rb").read().startswith(b"\xef\xbb\xbfRIMNO")


def test_headers_of_many_files_take_one_job(spark, tmp_dir):
    names = {}
    for i in range(200):
        extra = f",X{i % 3}" if i % 5 else ""
        body = "\n" * (i % 2) + f"RIM_NO,NAME{extra}\r\n" + "".join(f"{k},n,1\n" for k in range(i % 7))
        _write(os.path.join(tmp_dir, f"p {i}_JUL_2025.csv"), body)
        names[f"p {i}_JUL_2025.csv"] = ["RIM_NO", "NAME"] + ([f"X{i % 3}"] if i % 5 else [])
    _write(os.path.join(tmp_dir, "none_JUL_2025.csv"), "")
    _write(os.path.join(tmp_dir, "big_JUL_2025.csv"), "\xef\xbb\xbfA,,\"b\"\"q\",A\n" + "1,2,3,4\n" * 200_000)
    spark.sparkContext.setJobGroup("headers", "headers")
    got = files.file_headers(spark, tmp_dir)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("headers")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 2     # the listing of many files may be a job of its own
    by = {f.rsplit("/", 1)[-1]: h for f, h in got.items()}
    assert by.pop("big_JUL_2025.csv") == ["A0", "_c1", 'b"q', "A3"] and by == names
    assert files.read_snapshots(spark, [os.path.join(tmp_dir, f"p {i}_JUL_2025.csv") for i in (1, 2, 6)]).count() == 9


def test_files_without_a_month_are_snapshots_of_their_own(spark, tmp_dir):
    from cardpulse.functions.months import named, snapshot_months
    from cardpulse.operators import audit
    _write(os.path.join(tmp_dir, "first batch.csv"), "RIMNO,ACTIVATED\n1,A\n2,A\n")
    _write(os.path.join(tmp_dir, "second.csv"), "RIMNO\n2\n3\n")
    _write(os.path.join(tmp_dir, "prime_JUL_2025.csv"), "RIMNO,ACTIVATED\n3,A\n")
    df = files.read_snapshots(spark, tmp_dir)
    labels = files.snapshot_labels(spark, tmp_dir)
    months = named(snapshot_months(df), labels)
    got = [(r["FROM_MONTH"], r["TO_MONTH"], r["N_PREV"], r["N_CURR"], r["N_NEW"], r["N_MISSING"])
           for r in audit.month_new_missing(df, months=months).collect()]
    assert sorted(got) == [("first batch", "second", 2, 2, 1, 1), ("second", "2025-JUL", 2, 1, 0, 1)]
    assert files.absent_columns(spark, tmp_dir) == {dt.date(1900, 1, 2): {"ACTIVATED"}}
    assert sorted(tuple(r)[1:] for r in files.unmatched_files(spark, tmp_dir).collect()) == [
        ("first batch", dt.date(1900, 1, 1)), ("second", dt.date(1900, 1, 2))]


def test_date_formats_are_voted(spark, tmp_dir):
    from cardpulse.operators import quality
    rows = [("2025-01-02", "13/02/2025", "03/04/2025", "x", None)] * 3 + [("01/02/2025", "03/04/2025", "05/04/2025", "", " ")]
    df = spark.createDataFrame(rows, "ISO string, DAYS string, BOTH string, JUNK string, EMPTY string")
    votes = {(r["COLUMN_NAME"], r["FORMAT"]): r for r in quality.date_format_votes(df, df.columns).collect()}
    won = {c: (f, r["N_TEXT"], r["N_ACCEPTED"], r["N_REJECTED"], r["N_AMBIGUOUS"]) for (c, f), r in votes.items() if r["IS_WINNER"]}
    assert won == {"ISO": ("yyyy-MM-dd", 4, 3, 1, 0), "DAYS": ("dd/MM/yyyy", 4, 4, 0, 1), "BOTH": ("dd/MM/yyyy", 4, 4, 0, 4),
                   "JUNK": ("yyyy-MM-dd", 3, 0, 3, 0), "EMPTY": ("yyyy-MM-dd", 0, 0, 0, 0)}
    assert votes["DAYS", "MM/dd/yyyy"]["N_ACCEPTED"] == 1 and votes["ISO", "MM/dd/yyyy"]["N_ACCEPTED"] == 1
    formats = files.vote_formats(df, df.columns)
    assert formats == {"ISO": "yyyy-MM-dd", "DAYS": "dd/MM/yyyy", "BOTH": "dd/MM/yyyy"}
    typed = files.apply_contract(df, dates=["ISO", "DAYS"], formats=formats)
    assert [str(r["DAYS"]) for r in typed.select("DAYS").distinct().orderBy("DAYS").collect()] == ["2025-02-13", "2025-04-03"]
    assert [r["ISO"] for r in typed.where("ISO IS NULL").collect()] == [None]
    assert quality.date_format_votes(df, []).count() == 0 and quality.date_format_votes(df.limit(0), ["ISO"]).count() == 10


def test_inputs_of_many_rows_are_written_without_a_shuffle_of_their_own(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from cardpulse.sources import fixtures as fx

    plain = fx.prime_raw(spark, "/root/testdata/sf0.001").select("ROW_ID", "RIMNO", "SNAP_MONTH")
    monkeypatch.setattr(fx, "_DERIVED", {})
    monkeypatch.setattr(fx, "FEW_ROWS", 0)
    dealt = []
    monkeypatch.setattr(DataFrame, "repartition", lambda self, *a: dealt.append(a) or self)
    large = fx.prime_raw(spark, "/root/testdata/sf0.001").select("ROW_ID", "RIMNO", "SNAP_MONTH")
    assert not dealt and sorted(map(str, large.collect())) == sorted(map(str, plain.collect()))
