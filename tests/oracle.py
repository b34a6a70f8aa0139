"""Run registered queries next to their SQL and compare the rows exactly."""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millrace.tables import TABLE_NAMES  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLE_NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(sorted((k, _plain(v)) for k, v in value.asDict().items()))
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda r: [(v is None, type(v).__name__, repr(v) if not isinstance(v, (int, float)) or isinstance(v, bool) else v) for v in r])


SAME_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
}


def _sql_type(spark_type: str) -> str:
    if spark_type.startswith("array<"):
        return _sql_type(spark_type[6:-1]) + "[]"
    return SAME_TYPES.get(spark_type, spark_type)


def differences(spark, con, folder, build, sql):
    """An empty list when the query and its SQL agree, else what differs."""
    df = build(spark, folder)
    got_cols, got = _sorted(df.columns, df.collect())
    cursor = con.execute(sql)
    want_cols, want = _sorted([d[0] for d in cursor.description], cursor.fetchall())
    notes = []
    got_types = {c: _sql_type(t) for c, t in df.dtypes}
    want_types = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    wrong = {c: (t, want_types.get(c)) for c, t in got_types.items() if want_types.get(c) != t}
    if wrong:
        notes.append(f"types {wrong}")
    if got_cols != want_cols:
        notes.append(f"columns {got_cols} != {want_cols}")
    if len(got) != len(want):
        notes.append(f"rows {len(got)} != {len(want)}")
    if len(got) == len(want) and got_cols == want_cols:
        bad = [(g, w) for g, w in zip(got, want) if g != w or [type(a) for a in g] != [type(b) for b in w]]
        if bad:
            notes.append(f"{len(bad)} of {len(got)} rows differ, first: spark={bad[0][0]} sql={bad[0][1]}"[:900])
    if not got:
        notes.append("no rows")
    return notes, len(got)


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from millrace.session import local_session

    folder = argv[1]
    patterns = argv[2:]
    spark = local_session("8", "oracle")
    con = connect(folder)
    built, sql = queries(), oracle_sql()
    failures = 0
    for name, build in built.items():
        if patterns and not any(name.startswith(p) for p in patterns):
            continue
        start = time.time()
        try:
            if name in sql:
                notes, n = differences(spark, con, folder, build, sql[name])
            else:
                n = build(spark, folder).count()
                notes = [] if n else ["no rows"]
            status = "ok " if not notes else "BAD"
        except Exception as error:  # noqa: BLE001 - report and go on
            notes, n, status = [f"{type(error).__name__}: {str(error)[:700]}"], -1, "ERR"
        failures += status != "ok "
        print(f"{status} {name:<42} rows={n:<8} {time.time() - start:6.2f}s {'' if name in sql else '(rows only) '}{'; '.join(notes)}", flush=True)
    print(f"{failures} failures")


if __name__ == "__main__":
    main(sys.argv)
