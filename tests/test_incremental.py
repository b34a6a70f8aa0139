import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import recode as rc
from millrace.operators import calendar as cal
from millrace.streaming import incremental as inc
from millrace.streaming import streams


def feed(spark):
    rows = [
        ("a", 1, "http://x/1", "AI <b>news</b>", "s", "2024-01-09 00:00:00"),
        ("a", 2, "http://x/2", "Gardens", "nothing", "2024-01-09 00:00:00"),
        ("a", 3, "http://x/3", "", "AI", "2024-01-09 00:00:00"),
        ("b", 1, "http://x/1", "AI copy", "s", "2024-01-09 12:00:00"),
        ("b", 2, "http://x/4", "Quantum", "s", "2024-01-01 00:00:00"),
        ("b", 3, "http://x/5", "Quantum", "s", None),
        ("b", 4, "http://x/6", "Quantum", "s", "2024-01-09 00:00:00"),
    ]
    schema = "source string, position int, url string, title string, summary string, published string"
    return spark.createDataFrame(rows, schema).withColumn("published", F.col("published").cast("timestamp_ntz"))


def test_every_entry_has_one_outcome(spark):
    staged = inc.staged_entries(feed(spark), "2024-01-10", 2)
    got = {(r.source, r.position): r.outcome for r in staged.collect()}
    assert got == {("a", 1): "kept", ("a", 2): "off_topic", ("a", 3): "incomplete", ("b", 1): "duplicate",
                   ("b", 2): "stale", ("b", 3): "stale", ("b", 4): "kept"}
    assert [(r.topic, r.title) for r in inc.candidates(staged).collect()] == [("ai", "AI news"), ("stem_science", "Quantum")]
    counters = {r.source: (r.fetched, r.kept, r.off_topic) for r in inc.source_counters(staged).collect()}
    assert counters == {"a": (3, 1, 1), "b": (4, 1, 0)}


def events(spark, path, name, rows):
    spark.createDataFrame(rows, "id long, ts timestamp, kind string").coalesce(1).write.mode("append").parquet(f"{path}/{name}")


def test_stream_counts_go_on_where_they_stopped(spark, tmp_path):
    source, target, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    day = dt.datetime(2024, 1, 1)
    events(spark, tmp_path, "in", [(i, day + dt.timedelta(hours=i), "ab"[i % 2]) for i in range(40)])

    def run():
        streams.stream_daily_counts(streams.file_stream(spark, source, 1), "ts", "kind", "30 days", target, state)
        return sorted((str(r.day), r.kind, r.n) for r in spark.read.parquet(target).collect())

    def batch():
        rows = spark.read.parquet(source).groupBy(F.to_date("ts").alias("day"), "kind").count().collect()
        return sorted((str(r.day), r.kind, r["count"]) for r in rows)

    assert run() == batch()
    assert run() == batch()
    events(spark, tmp_path, "in", [(100 + i, day + dt.timedelta(hours=2 * i), "b") for i in range(15)])
    assert run() == batch()


def test_stream_keeps_one_row_per_key(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    events(spark, tmp_path, "in", [(i, day + dt.timedelta(minutes=i), f"k{i % 4}") for i in range(20)])
    streams.stream_distinct(streams.file_stream(spark, str(tmp_path / "in")), "ts", "kind", "1 day", str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.kind for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["k0", "k1", "k2", "k3"]


def test_stream_of_first_writes(spark, tmp_path):
    """Late but earlier rows win, rows behind the watermark are dropped, a key that comes again later starts anew."""
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    day = dt.datetime(2024, 1, 1)

    def run(*rows):
        events(spark, tmp_path, "in", [(i, day + dt.timedelta(hours=h, microseconds=7), k) for i, h, k in rows])
        streams.stream_first_writes(streams.file_stream(spark, source), "ts", ["kind"], ["id"], 3600 * 24, "12 hours", target, state)
        read = spark.read.schema("id long, ts timestamp, kind string").parquet(target)
        return sorted((r.id, r.kind) for r in read.collect() if r.id < 90)

    assert run((1, 10, "a"), (2, 12, "a"), (3, 12, "b"), (4, 12, "b"), (5, 14, None)) == []
    assert run((6, 9, "a"), (7, 20, "b")) == []  # id 6 comes later but is earlier
    assert run((90, 60, "z")) in ([], [(3, "b"), (5, None), (6, "a")])  # the watermark passes the holds
    assert run((91, 61, "z"), (8, 10, "b")) == [(3, "b"), (5, None), (6, "a")]  # id 8 is behind the watermark
    assert run((9, 70, "a"), (92, 140, "z")) in ([(3, "b"), (5, None), (6, "a")], [(3, "b"), (5, None), (6, "a"), (9, "a")])
    assert run((93, 141, "z")) == [(3, "b"), (5, None), (6, "a"), (9, "a")]
    row = [r for r in spark.read.parquet(target).collect() if r.id == 6][0]
    assert row.ts == day + dt.timedelta(hours=9, microseconds=7)


def test_stream_of_first_writes_in_windows(spark, tmp_path):
    """State is an aggregate of Spark's own, no Python call per key; late but earlier rows win, each window has its own row."""
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    day = dt.datetime(2024, 1, 1)

    def run(*rows):
        events(spark, tmp_path, "in", [(i, day + dt.timedelta(hours=h, microseconds=7), k) for i, h, k in rows])
        stream = streams.file_stream(spark, source)
        streams.stream_first_writes_in_windows(stream, "ts", ["kind"], ["id"], 3600 * 24, "12 hours", target, state)
        read = spark.read.schema("id long, ts timestamp, kind string").parquet(target)
        return sorted((r.id, r.kind) for r in read.collect() if r.id < 90)

    assert run((1, 10, "a"), (10, 12, "b"), (9, 12, "b"), (5, 14, None), (11, 25, "a"), (12, 24, "a")) == []
    assert run((6, 9, "a"), (7, 20, "b")) == []  # id 6 comes later but is earlier
    run((90, 40, "z"))  # the watermark passes the first window
    assert run((91, 41, "z"), (8, 8, "b")) == [(5, None), (6, "a"), (9, "b")]  # id 8 is behind the watermark
    run((92, 140, "z"))
    assert run((93, 141, "z")) == [(5, None), (6, "a"), (9, "b"), (12, "a")]
    assert [r.ts for r in spark.read.parquet(target).collect() if r.id == 6] == [day + dt.timedelta(hours=9, microseconds=7)]
    plan = streams.first_writes_in_windows(streams.file_stream(spark, source), "ts", ["kind"], ["id"], 3600 * 24, "12 hours")
    assert "Pandas" not in plan._jdf.queryExecution().analyzed().toString()


def test_changed_parts(spark):
    old = spark.createDataFrame([("d1", 0, "x"), ("d2", 0, "y")], "day string, part long, content_key string")
    new = spark.createDataFrame([("d1", 0, "x"), ("d2", 0, "z"), ("d3", 0, "q")], "day string, part long, content_key string")
    assert sorted(r.day for r in inc.changed_parts(new, old, "day").collect()) == ["d2", "d3"]


def years(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "year int")


def test_federal_holidays_of_2021_and_2022(spark):
    got = {(str(r.date), r.holiday_name) for r in cal.federal_holidays(years(spark, 2021)).collect()}
    for day, name in [("2021-01-18", "Martin Luther King Jr. Day"), ("2021-05-31", "Memorial Day"), ("2021-06-18", "Juneteenth National Independence Day (Observed)"),
                      ("2021-07-05", "Independence Day (Observed)"), ("2021-11-25", "Thanksgiving Day"), ("2021-12-24", "Christmas Day (Observed)"),
                      ("2021-12-31", "New Year's Day (Observed)")]:
        assert (day, name) in got
    assert all(r.year == 2022 for r in cal.federal_holidays(years(spark, 2022)).collect())


def test_first_state_owns_a_shared_date(spark):
    shared = [(r.level, str(r.date)) for r in cal.state_holidays(years(spark, 2001)).filter("holiday_name = \"Patriots' Day\"").collect()]
    each = [(r.level, str(r.date)) for r in cal.state_holidays(years(spark, 2001), shared_dates=False).filter("holiday_name = \"Patriots' Day\"").collect()]
    assert shared == [("MA", "2001-04-16")] and sorted(each) == [("MA", "2001-04-16"), ("ME", "2001-04-16")]


@pytest.mark.parametrize("answers, flat", [(["P", "P"], 1), (["L", "L"], 1), (["P", "L"], None), (["P", None], None)])
def test_flatline(spark, answers, flat):
    df = spark.createDataFrame([(True, *answers)], "keep boolean, a string, b string")
    assert df.select(rc.flatline(F.col("keep"), [F.col("a"), F.col("b")], ["P", "L"])).first()[0] == flat


@pytest.mark.parametrize("keep, gibberish, flat, want", [(True, 1, None, 1), (True, 0, None, None), (True, None, 1, 1), (False, 1, 1, 0), (True, 0, 0, 0)])
def test_strange_is_three_valued(spark, keep, gibberish, flat, want):
    df = spark.createDataFrame([(keep, gibberish, flat)], "k boolean, g int, f int")
    assert df.select(rc.strange(F.col("k"), F.col("g"), F.col("f"))).first()[0] == want


def test_party_codes(spark):
    rows = [(2, 1, 5), (2, 2, 1), (1, 1, 1), (1, 2, 1), (3, 1, 1), (3, 1, -8), (3, 1, 3), (None, None, None), (2, 9, 2)]
    df = spark.createDataFrame(rows, "p int, s int, l int")
    codes = [r[0] for r in df.select(rc.party_code(F.col("p"), F.col("s"), F.col("l"))).collect()]
    assert codes == [7, 6, 1, 2, 5, 4, 3, -9, 4]


def test_luxury_quirk_misses_one_maker(spark):
    df = spark.createDataFrame([("Volkswagen", "Porsche")], "g string, m string")
    flags = df.select(rc.luxury_flag(F.col("g"), F.col("m")), rc.luxury_flag(F.col("g"), F.col("m"), quirk=True)).first()
    assert tuple(flags) == ("Luxury", "Regular")
