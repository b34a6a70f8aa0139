"""Near duplicates, repeats and benchmark passages against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import contamination, near_duplicates, queries, repeats
from tests.llm.helpers import frame, odd_rows, prose

FOLDER = "/root/testdata/sf0.001"


def shingles(text: str | None) -> frozenset:
    w = (text or "").split()
    return frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_classes(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    sets = [(i, shingles(t), tuple((t or "").split())) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a, wa) in enumerate(sets):
        for j, b, wb in sets[:k]:
            if wa == wb or a and b and len(a & b) >= 0.8 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


def edited(text: str, places: list[int]) -> str:
    w = text.split()
    for p in places:
        w[p] = f"edit{p}"
    return " ".join(w)


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(4)
    everything = rng.integers(0, 2**63, 300).astype(np.uint64)
    wa, wb = rng.integers(1, 6, 300).astype(float), rng.integers(1, 6, 300).astype(float)
    wa[:60], wb[-60:] = 0, 0
    exact = sum(1 / max(np.maximum(wa / wa[k], wb / wb[k]).sum(), 1e-9) for k in range(300) if wa[k] and wb[k])
    a = near_duplicates.signature(everything[wa > 0], wa[wa > 0], 4096)
    b = near_duplicates.signature(everything[wb > 0], wb[wb > 0], 4096)
    assert abs((a == b).mean() - exact) < 0.04
    assert len(near_duplicates.signature(everything[:1], np.ones(1))) == near_duplicates.REGISTERS


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, FOLDER).collect()]
    got = {r.doc_id: r.class_id for r in queries.QUERIES["op10_near_duplicates"](spark, FOLDER).collect()}
    assert got == brute_classes(rows)


def test_large_groups_and_chains(spark):
    seed = prose(1, 120, 5000)
    rows = [(k, seed) for k in range(150)]
    rows += [(200 + k, edited(seed, [(k * 7) % 110])) for k in range(60)]
    chain = prose(2, 200, 9000)
    rows += [(400 + k, edited(chain, [20 * j + 3 for j in range(k)])) for k in range(6)]
    rows += [(500 + k, f"{prose(50 + k, 30, 9000)} {prose(3, 60, 9000)} {prose(80 + k, 30, 9000)}") for k in range(40)]
    got = {r.doc_id: r.class_id for r in near_duplicates.classes(frame(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_pairs_inside_a_family_just_below_the_limit(spark):
    """300 texts at 0.78 to each other by a common template, and 20 pairs at 0.80 to 0.85 among them."""
    template = prose(60, 320, 90_000)

    def member(k: int, other: int | None = None, own: int = 0) -> str:
        return f"{template} {prose(1000 + k, 44, 90_000)}" if other is None else f"{template} {prose(1000 + other, 44 - own, 90_000)} {prose(5000 + k, own, 90_000)}"

    rows = [(k, member(k)) for k in range(280)] + [(280 + k, member(k, 13 * k, 34 + k % 6)) for k in range(20)]
    sets = {i: shingles(t) for i, t in rows}
    assert all(0.76 < len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) < 0.8 for i in range(100))
    assert all(0.8 <= len(sets[280 + k] & sets[13 * k]) / len(sets[280 + k] | sets[13 * k]) < 0.85 for k in range(20))
    got = {r.doc_id: r.class_id for r in near_duplicates.classes(frame(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_of_odd_rows(spark):
    rows = odd_rows()
    got = near_duplicates.classes(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.class_id, r.class_size) for r in got if r.class_size > 1) == sorted(
        [("1", 1, 2), ("1", 1, 2), ("2", 2, 4), ("3", 2, 4), ("4", 2, 4), ("None", 2, 4)])
    kept = near_duplicates.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "1", "None", "None", "5", "6", "7"])
    assert near_duplicates.classes(frame(spark, [])).count() == 0 and near_duplicates.keep_one(frame(spark, [])).count() == 0


def brute_cut(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    texts = [(i, (t or "").encode()) for i, t in rows]
    n = Counter(b[k : k + 200] for _, b in texts for k in range(len(b) - 199))
    out = {}
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if n[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("case", ["edges", "periods", "odd"])
def test_repeats_equal_brute_force(spark, case):
    seed = prose(9, 90, 5000)
    rows: list[tuple[int | None, str | None]] = {
        "edges": [(k, prose(k, 20, 900) + seed[a : a + n] + prose(k + 70, 20, 900)) for k, (a, n) in enumerate([(0, 199), (0, 200), (1, 201), (3, 350), (100, 260), (7, 203), (0, 400), (50, 333)])]
        + [(20, seed[:300]), (21, seed[:300]), (22, seed[5:205]), (23, "é" * 150 + seed[10:260])],
        "periods": [(0, "a" * 450), (1, "a" * 199), (2, "a" * 200), (3, "ab" * 120), (4, "xyz w " * 60), (5, "x" + "ab" * 101), (6, seed + "q" + seed)],
        "odd": [(k, t) for k, (_, t) in enumerate(odd_rows()) if t is None or len(t) < 9000],
    }[case]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove(frame(spark, rows)).collect()}
    assert got == brute_cut(rows)


def test_repeats_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, FOLDER).collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op9_repeats"](spark, FOLDER).collect()}
    assert got == brute_cut(rows)


def test_repeats_of_repeated_rows(spark):
    rows = [(None, prose(1, 80)), (None, prose(1, 80)), (1, prose(2, 80)), (1, prose(3, 80)), (2, None)]
    got = repeats.remove(frame(spark, rows)).collect()
    assert sorted(r.n_removed for r in got) == sorted([len(prose(1, 80))] * 2 + [0] * 3)
    assert repeats.remove(frame(spark, [])).count() == 0


def test_benchmark_query_finds_passages(spark):
    """Items of which half the five-word shingles or more stand in a document are found; what is found shares most words."""
    docs = {r.doc_id: r.text or "" for r in queries.documents(spark, FOLDER).collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    wanted, held = {i: shingles(t) for i, t in items.items()}, defaultdict(set)
    for d, t in docs.items():
        own = shingles(t)
        for i, s in wanted.items():
            if len(s & own) >= 0.5 * len(s):
                held[d].add(i)
    got = queries.QUERIES["op7_contamination"](spark, FOLDER).collect()
    assert {(d, i) for d, x in held.items() for i in x} <= {(r.doc_id, r.item_id) for r in got}
    assert all(r.lcs_share >= 0.6 for r in got)


def test_paraphrases_and_clean_texts(spark):
    item = "the quick harbour master counted nine grey barges before the evening tide and wrote all their names in ink"
    rows = [(1, f"{prose(1, 300)} {item} {prose(2, 200)}"), (2, f"{prose(3, 50)} {item.replace('grey', 'old').replace('quick ', '').replace('counted', 'tallied')} {prose(4, 50)}"),
            (3, prose(5, 400)), (4, " ".join(sorted(item.split())) + " " + prose(6, 100)), (5, item.upper().replace(" ", "\n")), *odd_rows()]
    benchmark = spark.createDataFrame([(7, item, 1), (8, "too short", 1), (9, None, 1), (10, "", 1)], "item_id long, text string, doc_id int")
    got = contamination.leaks(frame(spark, rows), benchmark).collect()
    assert sorted({(r.doc_id, r.item_id) for r in got}) == [(1, 7), (2, 7), (5, 7)]
    kept = contamination.keep_clean(frame(spark, rows), benchmark)
    assert kept.columns == frame(spark, rows).columns and {1, 2}.isdisjoint(r.doc_id for r in kept.collect() if r.text and item[:20] in r.text)
    assert contamination.leaks(frame(spark, rows), benchmark.limit(0)).count() == 0
    assert contamination.leaks(frame(spark, []), benchmark).count() == 0


def test_items_of_any_length_are_found(spark):
    """Heads of 5 to 12 words among many passages, a long item whole and in part, and a place with the answer beside a better one without."""
    rng = np.random.default_rng(3)
    common = [f"c{k}" for k in range(300)]
    heads = [" ".join(rng.choice(common, n)) for n in (5, 6, 8, 10, 12) for _ in range(6)]
    long_item = prose(70, 500, 3000)
    answered = [f"q{k}" for k in range(40)]
    first = answered[:20] + ["x"] * 15 + answered[-5:]
    second = answered[:30] + ["y"] * 10
    filler = [prose(800 + k, 150, 50_000) for k in range(400)]
    rows = [(k, f"{filler[k]} {h} {filler[-k]}") for k, h in enumerate(heads)]
    rows += [(100, f"{filler[50]} {long_item} {filler[51]}"), (101, f"{filler[52]} {' '.join(long_item.split()[213:263])} {filler[53]}"), (102, " ".join([*first, filler[54], *second]))]
    rows += [(200 + k, " ".join([x, *rng.choice(common, 30)])) for k, x in enumerate(filler)]
    items = [(k, h) for k, h in enumerate(heads)] + [(100, long_item), (102, " ".join(answered))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contamination.leaks(frame(spark, rows), benchmark).collect()}
    assert {(k, k) for k in range(len(heads))} | {(100, 100), (101, 100), (102, 102)} <= got
    assert not any(d >= 200 for d, _ in got)
    assert {r.doc_id for r in contamination.keep_clean(frame(spark, rows), benchmark).collect()} == {200 + k for k in range(len(filler))}


def test_places_are_judged_one_by_one(spark):
    item = [f"q{k}" for k in range(40)]
    first, second = item[:20] + ["x"] * 15 + item[-5:], item[:28] + ["y"] * 12
    text = " ".join([prose(1, 100), *first, prose(2, 200), *second, prose(3, 100)])
    got = contamination.leaks(frame(spark, [(1, text)]), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.answer_share) for r in got] == [(1, 7, 1.0)]


@pytest.mark.parametrize("times", [1, 30, 200, 1000])
def test_repeats_of_what_is_not_shared_lose_no_pair(times):
    """104 shared words, 20 more that one text repeats: the set similarity stays just above 0.8."""
    for seed in range(60):
        shared = [f"s{seed}x{k}" for k in range(104)]
        more = [f"m{seed}x{k}" for k in range(20)] * times
        a, b = " ".join(shared), " ".join(shared + more)
        own, other = shingles(a), shingles(b)
        assert len(own & other) / len(own | other) > 0.8 or times > 1
        _, left = near_duplicates.bands_of(a)
        _, right = near_duplicates.bands_of(b)
        if len(own & other) >= 0.8 * len(own | other):
            assert set(left.tolist()) & set(right.tolist()), seed


def test_one_of_each_class_keeps_all_columns(spark):
    rows = [(k, prose(k // 3, 60)) for k in range(60)]
    df = frame(spark, rows).withColumn("_id", near_duplicates.F.col("doc_id") + 1000).withColumn("_own", near_duplicates.F.lit("own")).withColumn("row", near_duplicates.F.lit(1))
    kept = near_duplicates.keep_one(df)
    want = [r for r in df.collect() if r.doc_id % 3 == 0]
    assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted(map(str, want))
