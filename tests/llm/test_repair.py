"""Conversation repair: against all edit sequences, against a plain table of costs, and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

from millrace.llm import conversation_repair as cr
from millrace.llm import queries

FOLDER = "/root/testdata/sf0.01"
GOOD = re.compile("(s?(ua)+)?")


def faults(rows):
    """Faults of rows (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append(None if re.findall(r"[^\x20\x09-\x0D]", text)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Cost, audit and repaired rows by a table of whole audits, one for each row and state."""
    states = {"": "", "s": "s", "u": "u", "a": "a"}
    leads = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(table):
        for _ in range(3):
            for s in list(table):
                for c, role in (("u", "user"), ("a", "assistant")):
                    if (s, c) in leads:
                        cost, audit, kept = table[s]
                        new = (cost + 3, audit + "I", kept + [(role, "")])
                        t = leads[s, c]
                        if t not in table or new[:2] < table[t][:2]:
                            table[t] = new
        return table

    table = inserted({states[""]: (0, "", [])})
    for (_, role, text), fault in zip(rows, faults(rows)):
        after = {}

        def put(t, new):
            if t not in after or new[:2] < after[t][:2]:
                after[t] = new

        for s, (cost, audit, kept) in table.items():
            put(s, (cost + 4, audit + "D", kept))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if (s, role[:1]) in leads:
                put(leads[s, role[:1]], (cost + more, audit + "K", kept + [(role, text)]))
            for c, name in (("u", "user"), ("a", "assistant")):
                if (s, c) in leads:
                    put(leads[s, c], (cost + 3 + more, audit + "R", kept + [(name, text)]))
        table = inserted(after)
    return min((table[s] for s in ("", "a") if s in table), key=lambda x: x[:2])


def by_enumeration(rows):
    """The same by trying every edit sequence."""
    flaws, best = faults(rows), (10 ** 9, "", [])

    def go(k, cost, audit, kept, inserts):
        nonlocal best
        if cost > best[0]:
            return
        if k == len(rows) and GOOD.fullmatch("".join(r[:1] or "-" for r, _ in kept)):
            best = min(best, (cost, audit, kept), key=lambda x: x[:2])
        if inserts < 2:
            for name in ("user", "assistant"):
                go(k, cost + 3, audit + "I", kept + [(name, "")], inserts + 1)
        if k < len(rows):
            _, role, text = rows[k]
            go(k + 1, cost + 4, audit + "D", kept, 0)
            if flaws[k] not in ("blank", "duplicate"):
                more = 3 if flaws[k] == "truncated" else 0
                go(k + 1, cost + more, audit + "K", kept + [(role, text)], 0)
                for name in ("user", "assistant"):
                    go(k + 1, cost + 3 + more, audit + "R", kept + [(name, text)], 0)

    go(0, 0, "", [], 0)
    return best


def expected(rows):
    """Contract row of one conversation, rows in order."""
    flaws = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    letters = [r[:1] for _, r, _ in rows]
    cost, audit, kept = cheapest(rows)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[flaws.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())


def plain(r):
    return (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)


def test_table_equals_all_sequences():
    rng = random.Random(1)
    for _ in range(300):
        rows = [(k, rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["a.", "b", "", f"c{k}!"])) for k in range(rng.randrange(5))]
        assert cheapest(rows)[:2] == by_enumeration(rows)[:2]


def test_query_against_plain_python(spark):
    groups, want = defaultdict(list), {}
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").orderBy("conv_id", "turn").collect():
        rows = groups[r.conv_id]
        role, text = r.role or " ", " " if r.text is None else r.text
        hurt = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        role, text = "user" if hurt == 4 else role, "" if hurt == 1 else re.sub("[.!?]", "", text) if hurt == 2 else text
        rows += [(r.turn, role, text)] * {0: 0, 3: 2}.get(hurt, 1)
    want = {k: expected(v) for k, v in groups.items()}
    got = queries.QUERIES["op12_conversation_repair"](spark, FOLDER).collect()
    assert {r.conv_id: plain(r) for r in got} == want and len(got) == len(want)


def test_blocks_of_long_conversations(spark, monkeypatch):
    """Blocks of three rows: borders within turns, copies and one conversation of a third of all rows."""
    monkeypatch.setattr(cr, "BLOCK", 3)
    rng = random.Random(2)
    groups = {k: [(rng.choice([None, 0, 0, 1, 2, 5]) if k % 3 == 0 else t, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]),
                   rng.choice(["a.", "b", "", f"c{rng.randrange(9)}!", f"d{rng.randrange(9)}"])) for t in range(rng.randrange(1, 25))] for k in range(120)}
    groups[500] = [(t, rng.choice(["user", "assistant"]), f"x{t}.") for t in range(700)]
    groups[None] = [(t, "user", "x.") for t in range(9)]
    rows = [(k, *r, "mine") for k, v in groups.items() for r in v]
    rng.shuffle(rows)
    turns = cr.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, said string").repartition(5))
    got = {r.conv_id: plain(r) for r in cr.report(turns, turns).collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        name = "null" if k is None else f"v{k}"

        def order(r):
            said = hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest().upper()
            return (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(name)}:{name}:{'-' if r[0] is None else r[0]}:{said}".encode()).digest())

        assert got[k] == expected(sorted(v, key=order)), k


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, conv string, block string, row string, code int"
    long = "word " * 100_000
    rows = [(1, None, None, None), (1, None, None, None), (1, 3, "user", long), (1, 4, "assistant", long + "."), (None, None, "user", "a?"), (2, 0, "", " \n"), (3, -5, "user", "é😀."), (3, 9, "assistant", "\x00.")]
    df = spark.createDataFrame([(*r, "c", "b", "r", 1) for r in rows], schema)
    turns = cr.turns_of(df)
    got = {r.conv_id: plain(r) for r in cr.report(turns, turns).collect()}
    for k in (1, None, 2, 3):
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == k]
        assert got[k] == expected(sorted(own, key=lambda r: (r[0] is not None, r[0] or 0)))
    gone = {r.conv_id: plain(r) for r in cr.report(turns.where("conv_id = 1"), turns).collect()}
    assert gone[3] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert cr.report(turns.limit(0), turns.limit(0)).count() == 0
