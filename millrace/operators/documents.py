"""Text operators: tokens, tf-idf, keywords, chunks, extractive digests,
sentiment, transcripts, call and article records, duplicate stories."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from millrace.functions import text as tx
from millrace.functions import vocabulary as v
from millrace.operators.aggregates import ordered_text
from millrace.operators.ranking import first_by, top_k
from millrace.session import scratch_path

# A run of letters that is a whole word (no digit or underscore beside it).
WORD = r"(?<![\p{L}\p{N}_])\p{L}+(?![\p{L}\p{N}_])"
SENTENCE_END = r"[.!?\n]+"


def tokens(text: Column, stop_words: Sequence[str] = v.STOP_WORDS) -> Column:
    """Lower-case words made of letters only, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.filter(words, lambda x: ~x.isin(list(stop_words))) if stop_words else words


# Documents of an Arrow batch whose words are counted or scored together.
DOCUMENTS_AT_A_TIME = 500


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype("int64")


def term_counts(df: DataFrame, identifier: str, text: str, stop_words: Sequence[str] = v.STOP_WORDS) -> DataFrame:
    """(document, length, term, n), without an exchange: a document is one row,
    so its words are counted in place, some documents of an Arrow batch at a time."""
    words = df.select(identifier, tokens(F.col(text), stop_words).alias("_w"))
    schema = StructType([words.schema[0], StructField("n_tokens", LongType()), StructField("term", StringType()), StructField("n", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENTS_AT_A_TIME):
                identifiers, lists = batch.slice(at, DOCUMENTS_AT_A_TIME).columns
                lengths, coded = _lengths(lists), lists.flatten().dictionary_encode()
                if not len(coded):
                    continue
                places = np.repeat(np.arange(len(lengths)), lengths) * len(coded.dictionary) + coded.indices.to_numpy()
                found, n = np.unique(places, return_counts=True)
                row, code = np.divmod(found, len(coded.dictionary))
                columns = [identifiers.take(pa.array(row)), pa.array(lengths[row]), coded.dictionary.take(pa.array(code)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return words.mapInArrow(count, schema)


def tf_idf(df: DataFrame, identifier: str, text: str, stop_words: Sequence[str] = v.STOP_WORDS) -> DataFrame:
    """tf = n / length, idf = ln((N + 1) / (1 + df)) + 1, one row per term that
    occurs. Terms with no occurrence would be zero and are left out; an empty
    document has no rows.

    The counts are written once and read twice, as the words cost more than the
    file. The join back on the term is where a very common term gathers; the
    document frequencies are unique per term, so the adaptive join splits the
    other side, and a partition's terms are hashed: nothing is sorted.
    """
    written = scratch_path(df.sparkSession, "term-counts")
    counts = term_counts(df, identifier, text, stop_words)
    counts.write.parquet(written)
    counts = df.sparkSession.read.schema(counts.schema).parquet(written)
    frequency = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    documents = df.agg(F.count(F.lit(1))).scalar()
    tf = F.col("n") / F.col("n_tokens")
    idf = F.log((documents + 1) / (F.col("df") + 1)) + 1
    return counts.join(frequency.hint("shuffle_hash"), "term").select(
        identifier, "term", "n", F.round(tf, 9).alias("tf"), F.round(idf, 9).alias("idf"), F.round(tf * idf, 9).alias("tf_idf")
    )


def keywords(weights: DataFrame, identifier: str, k: int = 5) -> DataFrame:
    return top_k(weights, [identifier], [F.desc("tf_idf"), F.col("term")], k)


# --- chunks --------------------------------------------------------------------


def chunk_texts(text: Column, size: int, overlap: int) -> Column:
    """The texts of all chunks, in order."""
    step = size - overlap
    length = F.length(text)
    n = F.when(length > 0, 1 + F.ceil(F.greatest(length - size, F.lit(0)) / step)).otherwise(0).cast("int")
    # One pass over the text: look ahead for a whole chunk, then move one step.
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1))
    return F.slice(pieces, F.lit(1), n)


def chunks(df: DataFrame, identifier: str, text: str, size: int, overlap: int) -> DataFrame:
    """Overlapping pieces of ``size`` characters with their start; the last one
    reaches the end, an empty text has none."""
    cut = df.select(identifier, F.posexplode(chunk_texts(F.col(text), size, overlap)).alias("chunk", "text"))
    return cut.select(identifier, "chunk", (F.col("chunk") * (size - overlap)).alias("start"), "text")


def lines(df: DataFrame, identifier: str, text: str, separator: str = "\n") -> DataFrame:
    """Pieces between separators, numbered."""
    return df.select(identifier, F.posexplode(F.split(text, separator)).alias("piece", "text"))


# --- extractive digests --------------------------------------------------------


@F.arrow_udf(ArrayType(LongType()))
def _summed(words: pa.Array, terms: pa.Array, weights: pa.Array) -> pa.Array:
    """For every list of words of a document the sum of its terms' weights; null where no word is a term."""
    sums = []
    for at in range(0, len(words), DOCUMENTS_AT_A_TIME):
        lists, vocabulary, values = (x.slice(at, DOCUMENTS_AT_A_TIME) for x in (words, terms, weights))
        n_lists, n_terms, inner = _lengths(lists), _lengths(vocabulary), lists.flatten()
        n_words, listed = _lengths(inner), vocabulary.flatten()
        coded = pa.concat_arrays([listed, inner.flatten()]).dictionary_encode()
        codes, size = coded.indices.to_numpy(), len(coded.dictionary)
        rows = np.arange(len(n_lists))
        known = np.repeat(rows, n_terms) * size + codes[: len(listed)]
        asked = np.repeat(np.repeat(rows, n_lists), n_words) * size + codes[len(listed) :]
        order = np.argsort(known)
        # Behind all others one that no word has, so that every place is a place.
        known, value = np.append(known[order], -1), np.append(values.flatten().to_numpy()[order], 0)
        place = np.searchsorted(known[:-1], asked)
        hit = known[place] == asked
        ends = np.append(0, np.cumsum(n_words))
        total = np.diff(np.append(0, np.cumsum(np.where(hit, value[place], 0)))[ends])
        missed = np.diff(np.append(0, np.cumsum(hit))[ends]) == 0
        sums.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_lists)), pa.int32()), pa.array(total, pa.int64(), mask=missed)))
    return pa.concat_arrays(sums) if sums else pa.array([], pa.list_(pa.int64()))


def _scored(df: DataFrame, identifier: str, pieces: Column, weights: DataFrame) -> DataFrame:
    """One row per document: ``_s``, its sentences with a score as (chunk, sentence, text, score), in order.

    The weights of a document's terms, no more than its text, meet the text in
    one row; its sentences are cut and summed there, in billionths, exactly.
    """
    weight = F.rint(F.col("tf_idf") * 1e9).cast("long").alias("weight")
    known = weights.groupBy(identifier).agg(F.collect_list(F.struct("term", weight)).alias("_t"))
    cut = F.transform(pieces, lambda p, c: F.transform(
        F.split(p, SENTENCE_END), lambda s, i: F.struct(c.alias("chunk"), i.alias("sentence"), F.trim(s).alias("text"))))
    sentences = df.join(known, identifier).select(identifier, "_t", F.filter(F.flatten(F.filter(cut, F.isnotnull)), lambda x: x["text"] != "").alias("_s"))
    words = F.transform("_s", lambda x: tokens(x["text"]))
    # Marked so that no filter or lambda behind it takes the function in, or calls it twice.
    summed = sentences.select(identifier, "_s", _summed.asNondeterministic()(words, F.col("_t.term"), F.col("_t.weight")).alias("_n"))
    billionth = F.lit(Decimal("0.000000001"))
    score = lambda n: F.round(n.cast("decimal(19,0)") * billionth, 6).cast("double").alias("score")
    all_of_them = F.zip_with("_s", "_n", lambda s, n: F.struct(s["chunk"].alias("chunk"), s["sentence"].alias("sentence"), s["text"].alias("text"), score(n)))
    return summed.select(identifier, F.filter(all_of_them, lambda x: x["score"].isNotNull()).alias("_s"))


def sentence_scores(df: DataFrame, identifier: str, pieces: Column, weights: DataFrame) -> DataFrame:
    """Sentences of every piece of a document (``pieces``: an array of texts) with the summed tf-idf of their words;
    a sentence without a word that the document has is left out."""
    return _scored(df, identifier, pieces, weights).select(identifier, F.inline("_s"))


def map_reduce_digest(df: DataFrame, identifier: str, text: str, size: int, overlap: int, per_chunk: int = 1) -> DataFrame:
    """The best sentences of every chunk, put together per document in order."""
    scored = _scored(df, identifier, chunk_texts(F.col(text), size, overlap), tf_idf(df, identifier, text))
    return _digest(scored, identifier, per_chunk)


def stuffed_digest(df: DataFrame, identifier: str, text: str, sentences: int = 3) -> DataFrame:
    """The best sentences of the whole document, in order."""
    return _digest(_scored(df, identifier, F.array(text), tf_idf(df, identifier, text)), identifier, sentences)


def _digest(scored: DataFrame, identifier: str, per_chunk: int) -> DataFrame:
    """The best sentences of every chunk of a document, in order; documents without any have no row.
    The rows are dealt by document already, so neither step deals them again."""
    best = top_k(scored.select(identifier, F.inline("_s")), [identifier, "chunk"], [F.desc("score"), F.col("sentence")], per_chunk)
    collected = best.groupBy(identifier).agg(F.array_sort(F.collect_list(F.struct("chunk", "sentence", "text"))).alias("_i"))
    return collected.select(
        identifier, F.size("_i").cast("long").alias("n_sentences"),
        F.array_join(F.transform("_i", lambda x: x["text"]), ". ").alias("digest"),
    )


def text_map(df: DataFrame, column: str, function: Callable[[pd.Series], pd.DataFrame], schema: StructType) -> DataFrame:
    """Add columns made by a Python function of a batch of texts.

    The seam for an external model: ``function`` takes a series of texts and
    returns a frame with one row per text. Arrow batches, no row-by-row calls.
    """
    added = StructType(df.schema.fields + schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = function(batch[column]).set_index(batch.index)
            yield pd.concat([batch, made], axis=1)

    return df.mapInPandas(run, added)


# --- sentiment and records -----------------------------------------------------


def polarity(df: DataFrame, keys: Sequence[str], text: str, lexicon: DataFrame) -> DataFrame:
    """Summed word polarity and its label; texts without a hit are Neutral.

    ``lexicon`` has term and polarity, unique per term. Words meet it before
    anything is summed, so only hits go on.
    """
    words = df.select(*keys, F.explode(tokens(F.col(text), ())).alias("term"))
    sums = words.join(lexicon, "term").groupBy(*keys).agg(F.sum("polarity").alias("polarity"))
    scored = df.select(*keys).distinct().join(sums, list(keys), "left")
    value = F.coalesce(F.col("polarity"), F.lit(0)).cast("long")
    return scored.select(*keys, value.alias("polarity"), tx.polarity_label(value).alias("sentiment"))


def transcripts(df: DataFrame, conversation: str, turn: str, text: str, part_rows: int = 1000) -> DataFrame:
    """Pieces of a conversation joined by spaces in order, as numbered parts."""
    line = F.replace(F.col(text), F.lit("\n"), F.lit(" "))
    return ordered_text(df.select(conversation, turn, text), [conversation], [F.col(turn)], line, " ", part_rows)


def call_records(df: DataFrame, conversation: str, turn: str, role: str, text: str, lexicon: DataFrame,
                 actions: Sequence[tuple[str, str]], default_action: str, caller: str = "user") -> DataFrame:
    """Sentiment, reason (the caller's first turn) and action (first rule whose
    pattern the reason matches) per conversation, by aggregates only."""
    turn_polarity = polarity(df, [conversation, turn], text, lexicon)
    overall = turn_polarity.groupBy(conversation).agg(F.sum("polarity").alias("polarity"), F.count(F.lit(1)).alias("n_turns"))
    reasons = df.filter(F.col(role) == caller).groupBy(conversation).agg(F.min_by(text, turn).alias("reason"))
    chain = F
    for pattern, action in actions:
        chain = chain.when(F.col("reason").rlike("(?iu)" + pattern), action)
    return (
        overall.join(reasons, conversation, "left")
        .withColumn("sentiment", tx.polarity_label(F.col("polarity")))
        .withColumn("action", chain.otherwise(default_action))
    )


def article_records(df: DataFrame, identifier: str, parts: Column, description: Column) -> DataFrame:
    """Content merged from its parts, else the description; the first image;
    the cleaned text."""
    content = F.when(F.size(parts) > 0, F.array_join(parts, "")).otherwise(F.coalesce(description, F.lit("")))
    return df.select(identifier, content.alias("_c")).select(
        identifier,
        F.regexp_extract("_c", r"""<img[^>]*src=["']([^"']*)["']""", 1).alias("image"),
        tx.clean_html(F.col("_c")).alias("content"),
    )


def most_trusted(df: DataFrame, story: Sequence[str], rank: Column, identifier: str) -> DataFrame:
    """One row per story: the most trusted source, then the lowest id."""
    return first_by(df.withColumn("trust", rank), story, [F.col("trust"), F.col(identifier)])
