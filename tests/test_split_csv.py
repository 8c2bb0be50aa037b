"""CSV with line breaks inside fields, read in splits, against the reader of whole files."""

import random

import pytest

from casedesk import schemas
from casedesk.sources import files, split_csv


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes",
             "spark.sql.files.minPartitionNum")
    for name, value in zip(names, ("997", "0", "1")):
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def quoted(value, r):
    if value is None:
        return ""
    if any(c in value for c in ',"\n\r') or r.random() < 0.2:
        return '"' + value.replace('"', '""') + '"'
    return value


def written(path, seed, n, end="\n", longest=6):
    r = random.Random(seed)
    words = ["plain", "two\nlines", 'say "hi"', '"', '""', "a,b", "\n", "\n\n\n", "é 😀", "x" * 50,
             '",\n"', "tail\n"]
    lines = ['id,text,"no\nte"' if seed % 2 else "id,text,note"]
    for i in range(n):
        text = "".join(r.choice(words) for _ in range(r.randrange(1, longest)))
        note = None if r.random() < 0.3 else r.choice(words)
        lines.append(",".join((str(i), quoted(text, r), quoted(note, r))))
    path.write_bytes((end.join(lines) + (end if r.random() < 0.5 else "")).encode())


@pytest.mark.parametrize("seed", range(4))
def test_splits_equal_whole_files(spark, small_splits, tmp_path, seed):
    written(tmp_path / "a.csv", seed, 400)
    # A field that covers several splits, with no line that is a record's end among them.
    written(tmp_path / "b.csv", seed, 60, longest=300)
    want = files.read_csv_strings(spark, str(tmp_path))
    found = split_csv.read_csv_strings(spark, str(tmp_path))
    assert found.columns == want.columns
    assert split_csv._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    assert rows(found) == rows(want) and want.count() == 460


def test_typed_tweets_in_splits(spark, small_splits, small_dir, tmp_path):
    from casedesk.sources import tables
    from pyspark.sql import functions as F
    tweets = tables.tweets(spark, small_dir).withColumn(
        "text", F.concat("text", F.lit('\n"quoted", more\n\nend')))
    files.write_csv(tweets.coalesce(1), str(tmp_path / "tweets"))
    strings = split_csv.read_csv_strings(spark, str(tmp_path / "tweets"))
    found = files.typed_columns(strings, schemas.TWEETS)
    assert rows(found) == rows(files.read_csv(spark, str(tmp_path / "tweets"), schemas.TWEETS))
    assert found.count() == tweets.count()


def test_many_splits_without_broadcast(spark, small_splits, tmp_path, monkeypatch):
    written(tmp_path / "a.csv", 9, 300)
    want = rows(files.read_csv_strings(spark, str(tmp_path)))
    monkeypatch.setattr(split_csv, "MOST_BROADCAST", 0)
    assert rows(split_csv.read_csv_strings(spark, str(tmp_path))) == want


def test_a_header_alone_and_line_ends_of_two_characters(spark, small_splits, tmp_path):
    (tmp_path / "h.csv").write_bytes(b"id,text\n")
    assert split_csv.read_csv_strings(spark, str(tmp_path / "h.csv")).count() == 0
    (tmp_path / "crlf.csv").write_bytes(b'id,text\r\n1,"a,b"\r\n2,c\r\n\r\n3,"say ""x"""\r\n')
    found = split_csv.read_csv_strings(spark, str(tmp_path / "crlf.csv"))
    assert rows(found) == [("1", "a,b"), ("2", "c"), ("3", 'say "x"')]
