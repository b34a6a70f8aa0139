"""Hilbert shards: the curve, the law, the pruning, odd rows."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import hilbert_shards as hs
from millrace.llm import queries
from tests.llm.helpers import frame, odd_rows

FOLDER = "/root/testdata/sf0.01"


def test_curve_steps_to_neighbours():
    for dims, bits in ((1, 4), (2, 4), (3, 3), (4, 2)):
        grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1)
        index = hs.hilbert_index(grid, bits)
        assert sorted(index) == list(range(1 << bits * dims))
        path = grid[:, np.argsort(index)]
        assert (np.abs(np.diff(path, axis=1)).sum(axis=0) == 1).all()


def _check_law(rows, total, shards=16):
    counts = Counter(r.shard for r in rows)
    full = [counts.get(s, 0) for s in range(shards)]
    assert sum(full) == total and max(full) - min(full) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_query_against_plain_python(spark):
    rows = queries.QUERIES["op13_shards"](spark, FOLDER).collect()
    texts = {r.doc_id: r.text or "" for r in queries.documents(spark, FOLDER).collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    _check_law(rows, len(texts))


def test_shards_follow_the_curve_and_prune(spark):
    docs = queries.documents(spark, FOLDER)
    layout = hs.document_shards(docs)
    assert sorted(layout.read().columns) == sorted(docs.columns)
    for ranges, condition in (({"source": ("src3", "src3")}, "source = 'src3'"), ({"lang": ("de", "de"), "size": (0, 500)}, "lang = 'de' AND octet_length(text) <= 500")):
        shards = layout.shards_for(**ranges)
        assert len(shards) < 16
        want = docs.where(condition)
        got = layout.read(**ranges).where(condition)
        assert want.count() > 0 and sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want.collect())


def test_one_cell_and_odd_rows(spark):
    same = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("one text").alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    _check_law(hs.document_shards(same).rows().collect(), 1000)
    rows = odd_rows()
    df = frame(spark, rows).withColumn("shard", F.lit("mine")).withColumn("slot", F.lit(None).cast("double"))
    layout = hs.write_shards(df, {"y": "y", "text": "text", "null": "n_chars"})
    _check_law(layout.rows().collect(), len(rows))
    back = layout.read()
    assert back.columns == df.columns
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    empty = hs.document_shards(queries.documents(spark, FOLDER).limit(0))
    assert empty.rows().count() == 0 and empty.shards_for() == []
