"""Counts against brute force, monotone trees, exact neighbours, held-out accuracy."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from millrace.llm import quality, queries, toxicity
from tests.llm.helpers import frame, odd_rows, prose

FOLDER = "/root/testdata/sf0.01"


def brute(text: str) -> list[int]:
    words, seen, dup, covered = quality.WORDS.findall(text), set(), 0, set()
    for line in text.split("\n"):
        if quality.WORDS.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    n = Counter(windows)
    for k, w in enumerate(windows):
        if n[w] > 1:
            covered |= set(range(k, k + 5))
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


def test_counts_equal_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "c\n", "#", "é|", "\x0b", "\x1c", "\n", " ", "a b c d e f\n"]) for _ in range(rng.randint(0, 60)))
        assert quality.statistics(text)[0] == brute(text)


def test_trees_follow_directions():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.FEATURES)))
    y = (rng.random(3000) < np.where(x[:, 2] > 0.5, 0.3, 0.7) + 0.2 * np.sin(9 * x[:, 2])).astype(float)
    trees = quality.fit(x, y, np.array(list(quality.FEATURES.values())))
    line = np.tile(x[0], (200, 1))
    for f, way in enumerate(quality.FEATURES.values()):
        if way:
            moved = line.copy()
            moved[:, f] = np.linspace(0, 1, 200)
            assert (way * np.diff(trees.probability(moved)) >= -1e-12).all()


def test_quality_of_odd_rows(spark):
    rows = odd_rows()
    trees = quality.train(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int"))
    got = quality.judge(frame(spark, rows), trees).collect()
    assert sorted((str(r.doc_id), *r[1:6]) for r in got) == sorted((str(i), *brute(t or "")) for i, t in rows)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    kept = quality.keep(frame(spark, rows), trees)
    assert kept.columns == frame(spark, rows).columns and kept.count() == sum(r.kept for r in got)
    assert quality.judge(frame(spark, []), trees).count() == 0


def test_quality_query_equals_brute_force_and_learns(spark):
    docs = {r.doc_id: r.text or "" for r in queries.documents(spark, FOLDER).collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op2_quality_rules"](spark, FOLDER).collect()}
    assert got.keys() == docs.keys()
    assert all(list(got[k][1:6]) == brute(t) for k, t in docs.items())
    labels = [r for r in queries.labels(spark, FOLDER).collect() if not got[r.doc_id].base_failed]
    assert np.mean([got[r.doc_id].kept == bool(r.quality) for r in labels]) > 0.95


def test_neighbours_are_exact():
    rng = np.random.default_rng(2)
    rows = np.where(rng.random((1500, 200)) < 0.05, rng.random((1500, 200)) * rng.random(200) ** 6, 0)
    rows[40:60] = rows[39]  # ties
    rows = rows[rows.any(axis=1)]
    rows /= np.sqrt((rows**2).sum(1))[:, None]
    sparse = [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in rows]
    index = toxicity.Examples({str(k): k for k in range(200)}, np.ones(200), list(range(len(rows))), rng.integers(0, 2, len(rows)).astype(float)).build(sparse)
    for j in range(0, 300, 3):
        without = j if j % 2 else -1
        found, sims = index.nearest(*sparse[j], without=without)
        cosines = rows @ rows[j]
        if without >= 0:
            cosines[without] = 0.0
        want = np.lexsort((np.arange(len(rows)), -np.round(cosines, 12)))[: toxicity.NEIGHBOURS]
        want = want[cosines[want] > 0]
        assert found.tolist() == want.tolist() and np.allclose(sims, cosines[want])


def test_every_term_is_indexed_and_rare_telling_words_count():
    """Four toxic texts of sixty, one insult in each two: no list of terms, no least number of texts."""
    texts = [prose(k, 50) + (" gruesome" if k < 2 else " vile" if k < 4 else "") + f" only{k}" for k in range(60)]
    terms = {w: k for k, w in enumerate(sorted({w for t in texts for w in toxicity.TERM.findall(t)}))}
    counts = [toxicity._counts(t, terms) for t in texts]
    having = np.bincount([k for c in counts for k in c], minlength=len(terms)).astype(float)
    index = toxicity.index(terms, having, len(texts), list(range(60)), (np.arange(60) < 4).astype(float), counts)
    assert (index.weight > 0).all() and len(index.example) == sum(map(len, counts))
    assert (np.diff(index.first) > 0).all()
    for word in ("gruesome", "vile"):
        c = toxicity._counts(prose(999, 40) + " " + word, terms)
        assert index.vote(*index.nearest(*index.vector(c))) > 0.3
    assert index.vote(*index.nearest(*index.vector(toxicity._counts(prose(998, 40), terms)))) < 0.3


def test_toxicity_query_on_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op1_toxicity"](spark, FOLDER).collect()}
    labels = [r for r in queries.labels(spark, FOLDER).collect() if got[r.doc_id].held_out]
    assert len(got) == queries.documents(spark, FOLDER).count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    hits = [r for r in labels if got[r.doc_id].predicted]
    assert len(hits) >= 5 and sum(r.toxic for r in hits) >= 0.8 * len(hits)
    assert sum(got[r.doc_id].predicted for r in labels if r.toxic) >= 0.7 * sum(r.toxic for r in labels)
    texts = {r.doc_id: r.text or "" for r in queries.documents(spark, FOLDER).collect()}
    assert sum(not r.evidence for r in got.values() if toxicity.TERM.search(texts[r.doc_id])) <= 0.01 * len(got)
    toxic, clean = [[got[r.doc_id].score for r in labels if r.toxic == y] for y in (1, 0)]
    assert np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean]) > 0.85


def test_toxicity_of_odd_rows(spark):
    rows = [(k, prose(k, 60) + (" gruesome" if k % 3 == 0 else "")) for k in range(100, 400)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    examples = toxicity.learn(frame(spark, rows), labels)
    assert "gruesome" in examples.terms
    got = toxicity.score(frame(spark, [*odd_rows(), (9, "GRUESOME!")]), examples).collect()
    assert len(got) == len(odd_rows()) + 1 and {r.doc_id for r in got if r.predicted} == {9}
    assert all(k % 3 == 0 for r in got for k in r.evidence)
    nothing = toxicity.learn(frame(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(frame(spark, odd_rows()), nothing).collect()} == {0.0}
    assert toxicity.score(frame(spark, []), examples).count() == 0
