"""Column recodes: lookups, ordered rules, flags, scaling and casts.

All are column expressions, so they stay inside the scan's code generation.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import vocabulary as v


def lookup(column: Column, table: Mapping, default: Column | None = None) -> Column:
    """``table[column]``, else ``default`` (null if none is given)."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(entries, column)
    return found if default is None else F.coalesce(found, default)


def recode(column: Column, table: Mapping) -> Column:
    """Replace the listed values and keep all others."""
    return lookup(column, table, column)


def recode_by_table(df: DataFrame, column: str, table: DataFrame, old: str, new: str, out: str) -> DataFrame:
    """The same with the mapping in a table that is unique on ``old``; values
    without an entry stay. Spark broadcasts the mapping only below its size limit."""
    mapping = table.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    return (
        df.join(mapping, F.col(column) == F.col("_old"), "left")
        .withColumn(out, F.coalesce(F.col("_new"), F.col(column)))
        .drop("_old", "_new")
    )


def first_match(rules: Sequence[tuple[Column, object]], default) -> Column:
    """The value of the first rule that holds; order matters."""
    chain = F
    for condition, value in rules:
        chain = chain.when(condition, value)
    return chain.otherwise(default)


def luxury_flag(group: Column, maker: Column, quirk: bool = False) -> Column:
    makers = v.LUXURY_MAKERS_QUIRK if quirk else v.LUXURY_MAKERS
    return F.when(group.isin(v.LUXURY_GROUPS) | maker.isin(makers), "Luxury").otherwise("Regular")


def party_code(party: Column, strength: Column, leaning: Column) -> Column:
    """Seven-point code: party with strength wins over the leaning answer."""
    pairs = {f"{p}/{s}": code for (p, s), code in v.PARTY_BY_STRENGTH.items()}
    both = F.concat(party.cast("string"), F.lit("/"), strength.cast("string"))
    return F.coalesce(lookup(both, pairs), lookup(leaning, v.PARTY_BY_LEANING), F.lit(v.MISSING_CODE))


def party_letter(code: Column) -> Column:
    return first_match([(code.isin(v.REPUBLICAN_CODES), "R"), (code.isin(v.DEMOCRAT_CODES), "D")], "I")


def codes_agree(left: Column, right: Column) -> Column:
    """False only where both are known and differ."""
    return F.coalesce(left == right, F.lit(True))


def had_difficulty(rating: Column, reason: Column, other_reason: Column) -> Column:
    return first_match(
        [
            (rating.isin(v.NO_DIFFICULTY_CODES), 0),
            (rating.isin(v.DIFFICULTY_CODES) | reason.isin(v.DIFFICULTY_REASONS)
             | other_reason.isin(v.DIFFICULTY_REASONS), 1),
        ],
        v.MISSING_CODE,
    )


def cell_label(group: Column, timing: Column) -> Column:
    """Label of a 2x2 cell, null outside it."""
    labels = {f"{g}/{t}": label for (g, t), label in v.CELL_LABELS.items()}
    return lookup(F.concat(group.cast("string"), F.lit("/"), timing.cast("string")), labels)


def pick_by_cell(cell: Column, choices: Mapping[str, Mapping]) -> list[Column]:
    """One output per name, taken from the column its cell points to:
    ``{"time_1": {"Active x Timer": "q120", ...}, ...}``."""
    return [
        F.coalesce(*[F.when(cell == value, F.col(source)) for value, source in sources.items()]).alias(name)
        for name, sources in choices.items()
    ]


def scaled(column: Column, unit: float) -> Column:
    return column / F.lit(float(unit))


def safe_log(column: Column) -> Column:
    """Natural log, null for zero and below."""
    return F.when(column > 0, F.log(column))


def age_in_years(year: Column, as_of_year: int) -> Column:
    return F.lit(as_of_year) - year


def sold_next_year(year: Column, as_of_year: int) -> Column:
    return year + 1 == F.lit(as_of_year)


def flatline(keep: Column, answers: Sequence[Column], values: Sequence[str]) -> Column:
    """1 where a kept row gives one and the same answer throughout, else null."""
    uniform = [reduce(lambda a, b: a & b, [a == value for a in answers]) for value in values]
    return F.when(keep & reduce(lambda a, b: a | b, uniform), 1)


def strange(keep: Column, gibberish: Column, flat: Column) -> Column:
    """Three-valued: 1 if flagged, 0 if not kept, null if undecided."""
    flagged = keep & (gibberish.eqNullSafe(F.lit(1)) | (flat == 1))
    return F.when(flagged, 1).when(~flagged, 0)


def cast_by_pattern(df: DataFrame, casts: Sequence[tuple[str, str]]) -> DataFrame:
    """Cast every column whose name matches a pattern (first match counts).
    Values that do not parse become null."""
    columns = []
    for name in df.columns:
        target = next((kind for pattern, kind in casts if re.search(pattern, name)), None)
        columns.append(F.col(name).try_cast(target).alias(name) if target else F.col(name))
    return df.select(*columns)


def level_index(column: Column, levels: Sequence[str]) -> Column:
    """1-based position in the ordered levels, null if not a level."""
    position = F.array_position(F.array(*[F.lit(x) for x in levels]), column)
    return F.when(position > 0, position)


def relevel(levels: Sequence[str], base: str) -> list[str]:
    """The levels with ``base`` first."""
    return [base] + [x for x in levels if x != base]


def device_class(system: Column) -> Column:
    """1 mobile, 0 desktop, null unknown."""
    return F.when(system.rlike(v.MOBILE_PATTERN), 1).when(
        system.rlike(v.DESKTOP_PATTERN) | system.isin(v.DESKTOP_NAMES), 0
    )


def prefixed_id(prefix: str, column: Column) -> Column:
    return F.concat(F.lit(prefix), column.cast("string"))


def search(df: DataFrame, text: str, columns: Sequence[str], regex: bool = False) -> DataFrame:
    """Rows with ``text`` in any of the columns, ignoring case; null is no match."""
    needle = text.strip().lower()
    if not needle:
        return df
    hits = [
        F.coalesce(F.lower(F.col(c)).rlike(needle) if regex else F.lower(F.col(c)).contains(needle), F.lit(False))
        for c in columns
    ]
    return df.filter(reduce(lambda a, b: a | b, hits))
