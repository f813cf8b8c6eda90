import datetime as dt

from pyspark.sql import functions as F

from tagloom.plans import extraction
from tagloom.sources import readers, synthetic, writers
from tests.conftest import rows


def test_sample_tags_are_repeatable(spark):
    a = synthetic.sample_tags(spark, "2025-06-01", "2025-06-02")
    assert a.count() == 289 and rows(a) == rows(synthetic.sample_tags(spark, "2025-06-01", "2025-06-02"))
    ends = a.agg(F.min("ts"), F.max("ts")).first()
    assert ends[0] == dt.datetime(2025, 6, 1) and ends[1] == dt.datetime(2025, 6, 2)


def test_schedule_file_to_extraction_and_back(spark, tmp_path):
    sheet = tmp_path / "schedule.csv"
    sheet.write_text(
        "日付,品種,タグ,稼働開始時間,区切り,翌日フラグ,稼働終了時間,稼働時間合計,備考\n"
        ",,,開始,,,終了,,\n"
        "2025-06-01,H,1,08:00:00,～,,10:00:00,2:00,\n"
        "2025/6/1,L,2,23:00:00,～,翌,01:00:00,2:00,x\n"
        "2025-06-01,M,3,,～,,01:00:00,,\n",
        encoding="utf-8",
    )
    schedule = readers.read_schedule(spark, str(sheet))
    assert schedule.columns == readers.SCHEDULE_COLUMNS and schedule.count() == 3
    tags = synthetic.sample_tags(spark, "2025-06-01", "2025-06-03")
    extracted = extraction.extract(tags, schedule)
    assert rows(extraction.extraction_counts(extracted).where("part = 'product'"), "key", "n") == [("H", 25), ("L", 25)]
    path = str(tmp_path / "extracted")
    writers.write_csv(extracted, path)
    columns = ", ".join(f"{c} DOUBLE" for c in synthetic.SAMPLE_TAGS)
    again = readers.read_extracted(spark, path, columns)
    assert rows(again) == rows(extracted.select(*again.columns))


def test_nan_becomes_missing_and_columns_are_pruned(spark, tmp_path):
    (tmp_path / "a.csv").write_text("t,x,y\n2024-01-01 00:00:00,NaN,1\n2024-01-01 00:05:00,2.5,2\n")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"), "t TIMESTAMP_NTZ, x DOUBLE, y INT", columns=["x"])
    assert rows(df) == [(2.5,), (None,)]
    assert readers.read_tags(spark, str(tmp_path / "a.csv")).columns == ["ts", "x", "y"]


def test_json_and_report_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 1, 2, 3)), (2, None)], "i int, ts timestamp_ntz")
    writers.write_json(df, str(tmp_path / "j"))
    assert rows(readers.read_json(spark, str(tmp_path / "j"), df.schema)) == rows(df)
    writers.write_report({"a": df, "b": df.agg(F.count("i").alias("n"))}, str(tmp_path / "r"), fmt="csv")
    assert rows(readers.read_csv(spark, str(tmp_path / "r/b"), "n BIGINT")) == [(2,)]
