"""The pipeline keeps its contract, stage by stage."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import near_duplicates, quality, queries
from tests.llm.helpers import frame, odd_rows
from tests.llm.test_duplicates import brute_classes
from tests.llm.test_private_urls import base

FOLDER = "/root/testdata/sf0.001"


def test_stages_of_the_small_corpus(spark):
    docs = queries.documents(spark, FOLDER)
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, FOLDER).persist()
        frames[name] = {r.doc_id: r for r in docs.collect()}
        if name != "encoding":
            assert docs.columns == before.columns
    names = list(frames)
    assert names == [n for n, _ in corpus_pipeline.STAGES] and len(names) == 5
    # Copies: one of each class of what the first stage kept.
    kept = {i: r.text for i, r in frames["quality_rules"].items()}
    classes = brute_classes(sorted(kept.items()))
    assert frames["near_dedup"].keys() == set(classes.values())
    assert all(len(quality.WORDS.findall(t)) >= quality.MIN_WORDS for t in kept.values())
    # Texts without personal data are untouched; of the others none is left.
    for i, r in frames["personal_data"].items():
        old = frames["decontamination"][i].text
        assert base(r.text) == [] and r.n_chars == len(r.text)
        assert r.text == old or base(old)
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in frames["encoding"].items():
        text = frames["personal_data"][i].text
        ids = tool.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    ran = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, ran.collect())) == sorted(tuple(r) for r in frames["encoding"].values())


def test_stages_bear_odd_rows(spark):
    docs = frame(spark, odd_rows())
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() <= len(odd_rows())
    assert near_duplicates.SIMILARITY == 0.8
