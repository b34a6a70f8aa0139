import json
from pathlib import Path

import pytest

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.sources import readers, sinks


def test_column_names():
    assert readers.lower_name("Full.Model.Name.") == "full_model_name"
    assert readers.upper_name("Duration (in seconds)") == "DURATION__IN_SECONDS_"


def test_upsert_updates_inserts_and_repeats(spark, tmp_path):
    path = str(tmp_path / "news")
    key = {"headline": F.lower("headline")}
    first = spark.createDataFrame([("2024-01-01", "A", 1), ("2024-01-01", "B", 2), ("2024-01-02", "A", 3)], "day string, headline string, v int")
    second = spark.createDataFrame([("2024-01-01", "a", 10), ("2024-01-01", "a", 11), ("2024-01-03", "C", 5)], "day string, headline string, v int")
    sinks.upsert(path, first, key, "day", [F.col("v")])
    for _ in range(2):
        sinks.upsert(path, second, key, "day", [F.col("v")])
        rows = sorted((str(r.day), r.headline, r.v) for r in spark.read.parquet(path).collect())
        assert rows == [("2024-01-01", "B", 2), ("2024-01-01", "a", 10), ("2024-01-02", "A", 3), ("2024-01-03", "C", 5)]


def test_replace_partition_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "days")
    sinks.write_partitions(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "v int, day string"), path, "day")
    sinks.replace_partition(path, spark.createDataFrame([(9, "a"), (8, "b")], "v int, day string"), "day", "a")
    assert sorted((r.v, r.day) for r in spark.read.parquet(path).collect()) == [(3, "b"), (9, "a")]


def test_json_out_of_dirty_replies(spark):
    replies = {
        "clean": '[{"headline": "h1", "category": "funding"}]',
        "fenced": '```json\n[{"headline": "h2", "category": "funding"}]\n```',
        "commas": 'Sure: [{"headline": "h3", "category": "funding",}, ]',
        "loose": '1) {"headline": "h4", "category": "x", "extra": {"a": 1,}} and {bad: } and {"headline": "no category"}',
        "none": "nothing here",
        "missing": None,
    }
    schema = StructType([StructField("headline", StringType()), StructField("category", StringType())])
    df = spark.createDataFrame(list(replies.items()), "k string, reply string")
    got = {r.k: r.headline for r in readers.parse_records(df, "reply", schema).collect()}
    assert got == {"clean": "h1", "fenced": "h2", "commas": "h3", "loose": "h4"}


def test_csv_after_preamble(spark, tmp_path):
    path = tmp_path / "survey.csv"
    path.write_text('Id,Answer Text\n"Record","What they said"\n{import},{import}\n1,yes\n2,"no, never"\n')
    schema = StructType([StructField("Id", LongType()), StructField("Answer Text", StringType())])
    df = readers.read_csv_after(spark, str(path), schema, 2)
    assert sorted(tuple(r) for r in df.collect()) == [(1, "yes"), (2, "no, never")] and df.columns == ["ID", "ANSWER_TEXT"]


def test_documents_and_listing(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.tif").write_bytes(b"123")
    docs = readers.read_documents(spark, str(tmp_path / "a.txt")).collect()
    assert [d.text for d in docs] == ["one\ntwo"]
    assert [(r.file, r.length) for r in readers.list_files(spark, str(tmp_path), "*.tif").collect()] == [("b.tif", 3)]


def test_collection_keeps_types(spark, tmp_path):
    path = sinks.write_collection(spark.createDataFrame([(1, None, 2.5)], "a int, b string, c double"), str(tmp_path), "things")
    text = "".join(part.read_text() for part in Path(path).glob("*.json"))
    assert json.loads(text) == {"a": 1, "b": None, "c": 2.5}


def test_cards_escape_text(spark):
    card = spark.range(1).select(sinks.html_card(F.lit("<b> & \"x\""), F.lit("u"), F.lit(None).cast("string"), F.lit("s"))).first()[0]
    assert "&lt;b&gt; &amp; &quot;x&quot;" in card and '<p class="lead"></p>' in card


def test_any_text_comes_back_from_csv(spark, tmp_path):
    rows = [(1, "a\nb\r\nc"), (2, ""), (3, None), (4, " x "), (5, 'say "hi", \\n and \\'), (6, "\\N"), (7, "\\\\n\\\n"), (8, "#,;'\t")]
    df = spark.createDataFrame(rows, "id int, t string")
    path = sinks.write_csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, readers.read_csv(spark, path, df.schema, unescape=True).collect())) == rows


def test_records_equal_to_the_preamble_stay(spark, tmp_path):
    path = tmp_path / "answers.csv"
    path.write_text("id,answer\nx,y\n1,a\nx,y\nx,y\n2, b \n")
    schema = StructType([StructField("id", StringType()), StructField("answer", StringType())])
    got = sorted(map(tuple, readers.read_csv_after(spark, str(path), schema, 1).collect()))
    assert got == [("1", "a"), ("2", " b "), ("x", "y"), ("x", "y")]


def test_an_unreadable_table_is_an_error(spark, tmp_path):
    (tmp_path / "t" / "day=1").mkdir(parents=True)
    (tmp_path / "t" / "day=1" / "part-0.parquet").write_text("no parquet")
    rows = spark.createDataFrame([(1, "a", 1)], "id int, headline string, day int")
    with pytest.raises(Exception, match="(?i)parquet"):
        sinks.upsert(str(tmp_path / "t"), rows, {"headline": F.lower("headline")}, "day", [F.col("id")])


def test_cards_stay_on_one_line(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", "http://x", "<\r\n>", None)], "t string, l string, h string, s string")
    path = sinks.write_report(df.select(sinks.html_card(*map(F.col, "tlhs")).alias("html")), "html", str(tmp_path / "r"))
    assert spark.read.text(path).count() == 1


def test_long_headlines_are_told_apart(spark):
    rows = [(k, "c", "x" * 400 + str(k), "s", "u", "t", "r") for k in range(2)]
    df = spark.createDataFrame(rows, "id int, category string, headline string, source string, source_url string, summary string, relevance_notes string")
    assert readers.valid_stories(df, [F.col("id")]).count() == 2
