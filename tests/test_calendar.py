"""Rules of a table: known dates, odd rules, years that do not occur."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from millrace.operators import calendar as cal


def brute_easter(year: int) -> date:
    """Sunday after the first full moon of the tables on or after 21 March, day by day."""
    golden, century = year % 19 + 1, year // 100 + 1
    epact = (11 * golden + 20 + (8 * century + 5) // 25 - 5 - (3 * century // 4 - 12)) % 30
    epact += epact == 24 or epact == 25 and golden > 11
    moon = date(year, 3, 1) + timedelta(44 - epact - 1)
    if moon < date(year, 3, 21):
        moon += timedelta(30)
    day = moon + timedelta(1)
    while day.weekday() != 6:
        day += timedelta(1)
    return day


def test_easter_of_many_years(spark):
    rows = spark.range(1583, 2600).select("id", cal.easter(F.col("id")).alias("d")).collect()
    assert all(r.d == brute_easter(r.id) for r in rows)
    known = {1818: date(1818, 3, 22), 1943: date(1943, 4, 25), 2000: date(2000, 4, 23), 2024: date(2024, 3, 31), 2038: date(2038, 4, 25)}
    assert {r.id: r.d for r in rows if r.id in known} == known


def test_rules_of_a_table(spark):
    years = spark.createDataFrame([(2016,), (2019,), (2020,), (2020,)], "year int")
    rules = spark.createDataFrame([
        ("LA", "Mardi Gras", "easter", None, None, None, -47, None, None),
        ("CT", "Good Friday", "easter", None, None, None, -2, 2020, None),
        ("DE", "Election Day", "election", None, None, 2, None, None, None),
        ("NJ", "Every Year's Election", "election", None, None, None, 0, None, 2016),
        ("IL", "Fifth Friday", "nth", 2, "FRI", 5, None, None, None),
        ("NV", "Nevada Day", "last", 10, "FRI", None, None, None, None),
        ("TX", "Friday After Thanksgiving", "nth", 11, "THU", 4, 1, None, None),
        ("KY", "Leap Day", "day", 2, None, 29, None, None, None),
        ("XX", "No Such Kind", "moon", 1, "MON", 1, None, None, None),
        ("XX", "Over Before", "day", 1, None, 2, None, None, 1999),
        ("XX", "No Month", "day", None, None, 2, None, None, None),
    ], cal.RULE_TABLE)
    got = sorted((r.level, str(r.date)) for r in cal.rule_dates(years, rules).collect())
    assert got == sorted([
        ("LA", "2016-02-09"), ("LA", "2019-03-05"), ("LA", "2020-02-25"), ("CT", "2020-04-10"), ("DE", "2016-11-08"), ("DE", "2020-11-03"),
        ("NJ", "2016-11-08"), ("NV", "2016-10-28"), ("NV", "2019-10-25"), ("NV", "2020-10-30"), ("TX", "2016-11-25"), ("TX", "2019-11-29"),
        ("TX", "2020-11-27"), ("KY", "2016-02-29"), ("KY", "2020-02-29")])
    assert cal.rule_dates(years.limit(0), rules).count() == 0 and cal.rule_dates(years, rules.limit(0)).count() == 0


def test_first_state_owns_a_date(spark):
    years = spark.createDataFrame([(2020,)], "year int")
    rules = spark.createDataFrame([(s, "Good Friday", "easter", None, None, None, -2, None, None) for s in ("TN", "CT")]
                                  + [("CT", "New Year Again", "day", 1, None, 1, None, None, None)], cal.RULE_TABLE)
    assert [(r.level, str(r.date)) for r in cal.state_holidays_of(years, rules).collect()] == [("CT", "2020-04-10")]
    assert {r.level for r in cal.state_holidays_of(years, rules, shared_dates=False).collect()} == {"CT", "TN"}
