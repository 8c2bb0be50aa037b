import pytest
from pyspark.sql import types as T

from casedesk import schemas
from casedesk.sources import files


def test_csv_with_line_breaks_quotes_and_bom(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('﻿customer_tweet_id,raw\n1,"two\nlines, ""quoted"""\n2,plain\n3,\n', encoding="utf-8")
    df = files.read_csv_strings(spark, str(path))
    assert df.columns == ["customer_tweet_id", "raw"]
    assert [tuple(r) for r in df.collect()] == [
        ("1", 'two\nlines, "quoted"'), ("2", "plain"), ("3", None)]
    typed = files.read_csv(spark, str(path), schemas.all_strings(["raw", "customer_tweet_id"]))
    assert typed.columns == ["raw", "customer_tweet_id"]
    assert [r.customer_tweet_id for r in typed.collect()] == ["1", "2", "3"]
    with pytest.raises(ValueError, match="extra"):
        files.read_csv(spark, str(path), schemas.all_strings(["raw", "extra"]))


def test_csv_columns_by_name_and_type(spark, tmp_path):
    path = tmp_path / "typed.csv"
    path.write_text("created_at,text,customer_tweet_id\n"
                    "2017-10-31 22:10:47 +0000,hello,7\nnever,x,many\n", encoding="utf-8")
    rows = files.read_csv(
        spark, str(path), T.StructType.fromDDL(
            "customer_tweet_id long, text string, created_at timestamp"),
        "yyyy-MM-dd HH:mm:ss Z", multi_line=False).collect()
    assert [(r.customer_tweet_id, r.text) for r in rows] == [(7, "hello"), (None, "x")]
    assert [r.created_at is None for r in rows] == [False, True]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc, é'), (2, "")], "customer_tweet_id long, raw string")
    files.write_csv(df, str(tmp_path / "out"))
    back = files.read_csv(spark, str(tmp_path / "out"), df.schema).orderBy("customer_tweet_id")
    assert [r.raw or "" for r in back.collect()] == ['a "b"\nc, é', ""]


def test_json_lines_keep_text(spark, tmp_path):
    files.write_json(spark.createDataFrame([("é😀",)], "x string"), str(tmp_path / "j"))
    assert "é😀" in "".join(p.read_text("utf-8") for p in (tmp_path / "j").glob("*.json"))


def test_optional_table(spark, tmp_path):
    schema = schemas.all_strings(["a"])
    assert files.read_optional(spark, str(tmp_path / "none"), schema).count() == 0
    files.write_table(spark.createDataFrame([("x",)], schema), str(tmp_path / "t"))
    assert files.read_optional(spark, str(tmp_path / "t"), schema).count() == 1


def test_columns(spark):
    df = spark.createDataFrame([(1,)], "customer_tweet_id long")
    with pytest.raises(ValueError, match="review_status"):
        files.require_columns(df, schemas.EVALUATION_COLUMNS)
    row = files.ensure_string_columns(df, ["intent", "customer_tweet_id"]).first()
    assert (row.intent, row.customer_tweet_id) == ("", "1")
