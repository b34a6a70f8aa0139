"""Spans against Python's matcher, disclosure by co-occurrence, dated URL lists."""

from __future__ import annotations

import datetime as dt
import hashlib
import random
import re
import time

from millrace.llm import sanitise, url_filter
from tests.llm.helpers import frame, odd_rows, prose

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number: str) -> bool:
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(number)))) % 10 == 0


def base(text: str) -> list[str]:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda d=d: 16 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 8 <= len(d) <= 15}
            if good[kind]():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_spans_equal_the_patterns(spark):
    rng = random.Random(11)
    bits = ["a@b.cd", "x_1%@", "@", ".", "-", "a", "é", "😀", " ", "\n", "1.2.3.4", "256.1.1.1", "010.0.0.255", "4539578763621486", "4539 5787 6362 1486", "12", "+1 (017) 555-7713", "+", "(", ")", "c.d@e-f.g.h_i@j.k"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for k in range(400)] + [*odd_rows(), (900, "1" * 30_000 + "." * 20), (901, "x" * 30_000 + "@y.zz"), (902, "1.2.3.4 " * 500)]
    got = sanitise.spans(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == sorted(
        (str(i), hashlib.sha256(",".join(s).encode()).hexdigest(), *(sum(x.startswith(k + ":") for x in s) for k in PATTERNS)) for i, t in rows for s in [base(t or "")])
    assert sanitise.spans(frame(spark, [])).count() == 0


def test_words_that_give_a_value_away(spark):
    rows = [(k, f"{prose(k, 40)} {w} wrote from ann.{k % 2}@example.com today {prose(k + 500, 40)}") for k in range(12) for w in [("Quillfeather" if k % 2 else "someone")]]
    rows += [(100 + k, f"{prose(k + 900, 60)} someone wrote from home today") for k in range(200)]
    got = {r.doc_id: r for r in sanitise.spans(frame(spark, rows)).collect()}
    for k, text in rows:
        at = text.find("Quillfeather")
        assert (f"term:{at}:{at + 12}" in got[k].spans.split(",")) == (at >= 0)
        assert k < 100 or got[k].spans == ""
    clean = {r.doc_id: r.text for r in sanitise.clean(frame(spark, rows)).collect()}
    assert all("Quillfeather" not in t and "@" not in t for t in clean.values())
    assert all(clean[k] == t for k, t in rows if k >= 100)
    assert "<EMAIL>" in clean[1] and "someone wrote from <EMAIL> today" in clean[0]


def test_words_are_replaced_wherever_they_stand(spark):
    rows = [(k, f"Quillfeather here. {prose(k, 60)} Quillfeather wrote from ann.b@example.com today {prose(k + 500, 60)} yours, quillfeather") for k in range(6)]
    rows += [(100 + k, f"{prose(k + 900, 60)} someone wrote from home today") for k in range(200)]
    clean = {r.doc_id: r.text for r in sanitise.clean(frame(spark, rows)).collect()}
    assert not any("uillfeather" in t for t in clean.values()) and all("<EMAIL>" in clean[k] for k in range(6))


def test_a_text_of_twenty_thousand_values(spark):
    text = " ".join(f"u{k}@mail{k % 50}.example" for k in range(20_000))
    started = time.perf_counter()
    row = sanitise.spans(frame(spark, [(1, text), (2, "nothing")])).where("doc_id = 1").first()
    assert row.n_email == 20_000 and row.base_sha256 == hashlib.sha256(",".join(base(text)).encode()).hexdigest()
    assert sanitise.clean(frame(spark, [(1, text)])).first().text == " ".join(["<EMAIL>"] * 20_000)
    assert time.perf_counter() - started < 300


def test_clean_keeps_rows_and_columns(spark):
    rows = [*odd_rows(), (50, "call +1 (017) 555-7713 or 4539578763621486 now"), (51, "+4539578763621486")]
    docs = frame(spark, rows)
    got = sanitise.clean(docs)
    assert got.columns == docs.columns
    texts = sorted((str(r.doc_id), str(r.text)) for r in got.collect())
    assert texts == sorted([*((str(i), str(t)) for i, t in rows if i not in (50, 51)), ("50", "call <PHONE> or <CARD> now"), ("51", "+<CARD>")])


def test_as_of_join(spark):
    day = lambda n: dt.date(2024, 1, n)
    changes = spark.createDataFrame([
        ("host", "a.example", "add", day(5)), ("host", "a.example", "add", day(6)), ("host", "a.example", "remove", day(10)), ("host", "a.example", "add", day(20)),
        ("domain", "evil.example", "remove", day(1)), ("domain", "evil.example", "add", day(3)), ("domain", "evil.example", "remove", day(3)), ("domain", "evil.example", "add", day(4)),
        ("prefix", "b.example/x/y", "add", day(1)), (None, "c", "add", day(1)), ("host", "c.example", "add", None)], "scope string, key string, action string, at date")
    rows = [(1, "http://a.example/", day(4)), (2, "http://A.example:80", day(5)), (3, "https://u@a.example./q?x", day(9)), (4, "http://a.example/", day(10)), (5, "http://a.example/", day(31)),
            (6, "http://x.y.evil.example/p", day(3)), (7, "http://x.y.evil.example/p", day(4)), (8, "http://notevil.example", day(9)), (9, "http://b.example/x/y/z#f", day(2)), (10, "http://b.example/x/yy", day(2)),
            (11, None, day(2)), (12, "no address", day(2)), (13, "http://a.example/", None), (2, "http://A.example:80", day(5)), (None, "http://a.example/", day(25))]
    captures = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, fetched_at date, key string, scope string")
    got = url_filter.judge(captures, changes).collect()
    assert len(got) == len(rows)
    assert sorted(str(r.page_id) for r in got if r.blocked) == sorted(["2", "2", "3", "5", "7", "9", "None"])
    assert {r.reason for r in got if r.page_id == 7} == {"domain:evil.example"}
    assert not any(r.blocked for r in url_filter.judge(captures, changes.limit(0)).collect())
    assert url_filter.judge(captures.limit(0), changes).count() == 0
