"""Holiday calendars from rules, joined to whatever dates a table has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.ranking import first_by

# Federal holidays. ("day", month, day) is a date; ("nth", month,
# weekday, n) the n-th such weekday; ("last", month, weekday) the last one. The
# final number is the first year of the holiday.
FEDERAL_RULES = [
    ("New Year's Day", ("day", 1, 1), 1871),
    ("Martin Luther King Jr. Day", ("nth", 1, "MON", 3), 1986),
    ("Washington's Birthday", ("nth", 2, "MON", 3), 1971),
    ("Memorial Day", ("last", 5, "MON"), 1971),
    ("Juneteenth National Independence Day", ("day", 6, 19), 2021),
    ("Independence Day", ("day", 7, 4), 1871),
    ("Labor Day", ("nth", 9, "MON", 1), 1894),
    ("Columbus Day", ("nth", 10, "MON", 2), 1971),
    ("Veterans Day", ("day", 11, 11), 1978),
    ("Thanksgiving Day", ("nth", 11, "THU", 4), 1942),
    ("Christmas Day", ("day", 12, 25), 1871),
]

# A few state rules, to be replaced by a full table where needed.
STATE_RULES = [
    ("CA", "Cesar Chavez Day", ("day", 3, 31), 1995),
    ("CA", "Susan B. Anthony Day", ("day", 2, 15), 2014),
    ("MA", "Patriots' Day", ("nth", 4, "MON", 3), 1969),
    ("ME", "Patriots' Day", ("nth", 4, "MON", 3), 1969),
    ("TX", "Texas Independence Day", ("day", 3, 2), 1874),
    ("TX", "San Jacinto Day", ("day", 4, 21), 1875),
    ("TX", "Friday After Thanksgiving", ("after", 11, "THU", 4), 1970),
    ("NV", "Nevada Day", ("last", 10, "FRI"), 2000),
    ("UT", "Pioneer Day", ("day", 7, 24), 1849),
]


def rule_date(year: Column, rule: tuple) -> Column:
    """The date a rule gives in a year."""
    kind, month = rule[0], F.lit(rule[1])
    if kind == "day":
        return F.make_date(year, month, F.lit(rule[2]))
    first = F.make_date(year, month, F.lit(1))
    if kind == "last":
        return F.next_day(F.date_sub(F.last_day(first), 7), rule[2])
    nth = F.date_add(F.next_day(F.date_sub(first, 1), rule[2]), 7 * (rule[3] - 1))
    return F.date_add(nth, 1) if kind == "after" else nth


def years_of(df: DataFrame, day: str, more: int = 0) -> DataFrame:
    """The years that occur, and ``more`` years after the last one."""
    years = df.select(F.year(day).alias("year")).distinct()
    if not more:
        return years
    last = df.agg(F.max(F.year(day))).scalar()
    later = years.agg(F.count(F.lit(1)).alias("_n")).select(F.explode(F.sequence(last + 1, last + more)).alias("year"))
    return years.unionByName(later)


def holidays(years: DataFrame, rules: Sequence[tuple]) -> DataFrame:
    """(level, year, date, holiday_name) for rules (level, name, rule, first
    year), with the observed day next to a fixed date that falls on a weekend."""
    entries = []
    for level, name, rule, since in rules:
        day = F.when(F.col("year") >= since, rule_date(F.col("year"), rule))
        entries.append(F.struct(F.lit(level).alias("level"), day.alias("date"), F.lit(name).alias("holiday_name")))
        if rule[0] == "day":
            weekday = F.weekday(day)
            shifted = F.when(weekday == 5, F.date_sub(day, 1)).when(weekday == 6, F.date_add(day, 1))
            entries.append(F.struct(F.lit(level).alias("level"), shifted.alias("date"), F.lit(name + " (Observed)").alias("holiday_name")))
    # The first of January may be observed on the last day of the year before,
    # so each year's rules are also worked out for the year after it.
    reached = years.select(F.explode(F.array("year", F.col("year") + 1)).alias("year")).distinct()
    listed = reached.select(F.inline(F.array(*entries))).filter(F.col("date").isNotNull())
    dated = listed.select("level", F.year("date").alias("year"), "date", "holiday_name")
    return dated.join(years.select("year"), "year", "left_semi").select("level", "year", "date", "holiday_name")


def federal_holidays(years: DataFrame) -> DataFrame:
    return holidays(years, [("FE", *rule) for rule in FEDERAL_RULES])


def state_holidays(years: DataFrame, rules: Sequence[tuple] = STATE_RULES, shared_dates: bool = True) -> DataFrame:
    """State holidays on dates that are not federal holidays.

    ``shared_dates=True`` lists a date once, for the first state in the
    alphabet, as the source does with its one list; False lists it per state.
    """
    others = holidays(years, rules).join(federal_holidays(years).select("date"), "date", "left_anti")
    keys = ["date"] if shared_dates else ["date", "level"]
    return first_by(others, keys, [F.col("level"), F.col("holiday_name")]).select("level", "year", "date", "holiday_name")

def easter(year: Column) -> Column:
    """Western Easter Sunday of a year, by whole-number arithmetic on the column (valid from 1583 on)."""
    y = year.cast("int")
    century = F.floor(y / 100).cast("int")
    golden = y % 19
    skipped = century - F.floor(century / 4).cast("int")
    moon = (skipped - F.floor((8 * century + 13) / 25).cast("int") + 19 * golden + 15) % 30
    full = moon - F.when((moon == 29) | ((moon == 28) & (golden > 10)), 1).otherwise(0)  # days from 21 March to the full moon
    after = (y + F.floor(y / 4).cast("int") + full + 2 - skipped) % 7
    return F.date_add(F.make_date(y, F.lit(3), F.lit(28)), (full - after).cast("int"))


RULE_TABLE = "level string, holiday_name string, kind string, month int, weekday string, n int, shift int, since int, until int"


def rule_dates(years: DataFrame, rules: DataFrame) -> DataFrame:
    """(level, year, date, holiday_name, kind) of a table of rules, one row per rule and year in which it holds.

    Columns of ``rules`` are those of ``RULE_TABLE``. ``kind`` is ``day`` (day
    ``n`` of ``month``), ``nth`` (``n``-th ``weekday`` of ``month``), ``last``
    (last ``weekday`` of ``month``), ``easter`` (Easter Sunday) or ``election``
    (Tuesday after the first Monday of November, in every ``n``-th year; null:
    every year). ``shift`` days are added (null: 0). ``since`` and ``until``
    bound the years (null: open). Rules of an unknown kind, and days that a
    year does not have, give no row. Rules meet years on the year, so there is
    no product of all rules with all years to filter.
    """
    reach = years.agg(F.min("year").alias("low"), F.max("year").alias("high"))
    low, high = reach.select("low").scalar(), reach.select("high").scalar()
    begin, end = F.greatest(F.coalesce("since", low), low), F.least(F.coalesce("until", high), high)
    held = rules.withColumn("year", F.explode(F.when(begin <= end, F.sequence(begin, end)))).join(years.select("year").distinct(), "year")
    year, first = F.col("year"), F.expr("make_date(year, month, 1)")
    november = F.next_day(F.make_date(year, F.lit(10), F.lit(31)), "MON")
    day = (
        F.when(F.col("kind") == "day", F.expr("CASE WHEN n BETWEEN 1 AND day(last_day(make_date(year, month, 1))) THEN make_date(year, month, n) END"))
        .when(F.col("kind") == "nth", F.date_add(F.expr("next_day(date_sub(make_date(year, month, 1), 1), weekday)"), (7 * (F.col("n") - 1)).cast("int")))
        .when(F.col("kind") == "last", F.expr("next_day(date_sub(last_day(make_date(year, month, 1)), 7), weekday)"))
        .when(F.col("kind") == "easter", easter(year))
        .when((F.col("kind") == "election") & (year % F.coalesce("n", F.lit(1)) == 0), F.date_add(november, 1))
    )
    day = F.when((F.col("kind") != "nth") | (F.month(day) == F.month(first)), day)
    return (
        held.withColumn("date", F.date_add(day, F.coalesce("shift", F.lit(0)))).filter(F.col("date").isNotNull())
        .select("level", F.year("date").alias("year"), "date", "holiday_name", "kind")
    )


def state_holidays_of(years: DataFrame, rules: DataFrame, shared_dates: bool = True) -> DataFrame:
    """As ``state_holidays``, with the rules of a table such as a file of all states; a fixed date on a weekend is not moved."""
    others = rule_dates(years, rules).join(federal_holidays(years).select("date"), "date", "left_anti")
    keys = ["date"] if shared_dates else ["date", "level"]
    return first_by(others, keys, [F.col("level"), F.col("holiday_name")]).select("level", "year", "date", "holiday_name")


def orders_on(days: DataFrame, df: DataFrame, moment: str) -> DataFrame:
    """The calendar rows with the count of table rows on each date."""
    counts = df.groupBy(F.to_date(moment).alias("date")).agg(F.count(F.lit(1)).alias("n_rows"))
    return days.join(counts, "date", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
