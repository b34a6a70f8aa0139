"""Filter audit: the trie, the masks and all orders against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from millrace.llm import filter_audit as fa
from millrace.llm import queries
from tests.llm.helpers import frame, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_mask(text: str) -> int:
    words = WORD.findall(text)
    return ((len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words))
            + 4 * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + 8 * bool(re.search(r"[#$%&*|]", text)))


def plain_flags(rows):
    firsts = {}
    for i, text in rows:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    return Counter((i, plain_mask(t or "") + 16 * (i is not None and i > firsts[t or ""])) for i, t in rows)


def plain_audit(rows):
    """rows: part, mask, good, toxic."""
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed_at = Counter()
        for order in permutations(range(5)):
            name, left = "".join("ABCDE"[k] for k in order), own
            for step, k in enumerate(order):
                gone = [r for r in left if r[1] >> k & 1]
                earlier = sum(r[1] >> k & 1 for r in own) - len(gone)
                left = [r for r in left if not r[1] >> k & 1]
                removed_at[k] += len(gone)
                out[part, name, step + 1] = (len(left), len(gone), earlier, sum(r[1] == 1 << k for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), k)
        for key in [x for x in out if x[0] == part]:
            out[key] = (*out[key][:6], removed_at[out[key][6]])
    return out


def test_trie_keeps_every_text():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(2000)] + [b"ab" * 5000 + bytes([k]) for k in range(50)]
    trie = fa.RadixTrie()
    for t in texts:
        node = trie.node(t)
        node[2] = (t, (node[2][1] if node[2] else 0) + 1)
    assert dict(trie.terminals()) == Counter(texts)
    assert all(trie.node(t)[2][0] == t for t in texts)


def test_masks_and_orders_of_copies(spark, monkeypatch):
    monkeypatch.setattr(fa, "TRIE_BYTES", 20_000)  # many tries, many ranges
    monkeypatch.setattr(fa, "PARTITION_BYTES", 30_000)
    rng = random.Random(5)
    family = prose(1, 300)
    pool = [family + f" end {k}" for k in range(40)] + [prose(k, 150 + k) for k in range(60)] + ["", "A B C # d"]
    rows = [(k, rng.choice(pool)) for k in range(1500)] + [(k, family) for k in range(2000, 3000)] + [(7, family), (None, family), (None, family)]
    rng.shuffle(rows)
    df = frame(spark, rows).withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.concat(F.lit("s"), (F.col("doc_id") % 5).cast("string")))).repartition(7)
    got = fa.flags(df).collect()
    assert Counter((r.doc_id, r["mask"]) for r in got) == plain_flags(rows)
    labels = spark.createDataFrame([(k, k % 2, int(k % 7 == 0), "x") for k in range(0, 3000, 3)] + [(9, 0, 1, "y"), (None, 1, 1, "z")], "doc_id long, quality int, toxic int, part string")
    known = {}
    for r in labels.collect():
        old = known.get(r.doc_id, (False, False))
        known[r.doc_id] = (old[0] or r.quality == 1, old[1] or r.toxic == 1)
    known.pop(None)
    want = plain_audit([(r.part, r["mask"], *known.get(r.doc_id, (False, False))) for r in got])
    rows = fa.audit(fa.flags(df), labels).collect()
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows} == want
    assert len(rows) == 600 * 6


def test_odd_rows_and_no_rows(spark):
    df = frame(spark, odd_rows())
    assert Counter((r.doc_id, r["mask"]) for r in fa.flags(df).collect()) == plain_flags(odd_rows())
    labels = queries.labels(spark, "/root/testdata/sf0.001")
    assert fa.audit(fa.flags(df.limit(0)), labels).count() == 0
    text_ids = fa.flags(df.withColumn("doc_id", F.col("doc_id").cast("string")))
    assert text_ids.count() == len(odd_rows())
