import html
import math
import random
import re
import time

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import documents as dx
from millrace.operators import splitting as sp


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_clean_html_like_the_standard_library(spark):
    for raw in ["<p>a&amp;b</p>  c", "x &#8217;&#x2019; &#X41; y", "&amp;lt; &lt;i&gt;", "a&nbsp;&nbsp;b", "&hellip;&unknown; &", "", "<br>\n\t<b>q</b>"]:
        want = re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", raw))).strip()
        assert one(spark, raw, tx.clean_html) == want
    assert one(spark, None, tx.clean_html) == ""


def test_domain(spark):
    assert one(spark, "HTTPS://www.News.example.COM:80/a?b", tx.domain_of) == "news.example.com:80"
    assert one(spark, "no url", tx.domain_of) == ""


def test_topic_gate_uses_whole_words_in_any_script(spark):
    cases = {"New AI model": "ai", "A.I. rises": "ai", "maison": "off_topic", "çai thé": "off_topic", "Robotics lab": "stem_science", "GPT-4 out": "ai", "text-to-video": "ai", "": "off_topic"}
    for text, topic in cases.items():
        assert one(spark, text, tx.topic_of) == topic, text


def test_bullets_and_dates(spark):
    assert one(spark, "- one\n\n* two\n3) three\n`• four`", tx.bullets) == ["one", "two", "three", "four`"]
    assert str(one(spark, "Tue, 02 Jan 2024 10:00:00 GMT", tx.mail_date)) == "2024-01-02 10:00:00"
    assert one(spark, "not a date", tx.mail_date) is None
    assert str(one(spark, " ", lambda c: tx.date_or_default(c, "2020-02-03"))) == "2020-02-03"


def test_trust_counts_subdomains(spark):
    assert [one(spark, d, tx.trust_rank) for d in ("openai.com", "cs.stanford.edu", "wired.com", "ft.com", "notopenai.com")] == [0, 1, 2, 3, 4]


def test_tf_idf_of_three_sentences(spark):
    docs = spark.createDataFrame([(0, "this is a sample"), (1, "this is another example example"), (2, "example 3x different_ one"), (3, "")], "d long, t string")
    got = {(r.d, r.term): (r.n, r.tf_idf) for r in dx.tf_idf(docs, "d", "t").collect()}
    assert got[1, "example"] == (2, round(2 / 3 * (math.log(5 / 3) + 1), 9))
    assert got[0, "sample"] == (1, round(math.log(5 / 2) + 1, 9))
    assert set(got) == {(0, "sample"), (1, "another"), (1, "example"), (2, "example"), (2, "one")}


def test_term_counts_need_no_exchange(spark):
    docs = spark.createDataFrame([(0, "b a b")], "d long, t string")
    counts = dx.term_counts(docs, "d", "t", ())
    assert sorted((r.term, r.n, r.n_tokens) for r in counts.collect()) == [("a", 1, 3), ("b", 2, 3)]
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()


def test_chunks_rejoin_to_the_text(spark):
    texts = ["", "x", "y" * 100, "z" * 101, "".join(chr(97 + i % 26) for i in range(777)) + "😀é\nend"]
    df = spark.createDataFrame(list(enumerate(texts)), "d long, t string")
    got = {}
    for r in dx.chunks(df, "d", "t", 100, 25).orderBy("d", "chunk").collect():
        assert texts[r.d][r.start:r.start + 100] == r.text
        got[r.d] = got.get(r.d, "")[:r.start] + r.text
    assert [got.get(i, "") for i in range(len(texts))] == texts


def test_packed_chunks_rejoin_and_fit(spark):
    text = "\n".join("w" * (i * 13 % 47) for i in range(60))
    rows = sp.packed_chunks(spark.createDataFrame([(1, text)], "d long, t string"), "d", "t", 80).orderBy("chunk").collect()
    assert "\n".join(r.text for r in rows) == text and all(len(r.text) <= 80 for r in rows)
    assert all(len(a.text) + 1 + len(b.text.split("\n")[0]) > 80 for a, b in zip(rows, rows[1:]))


def test_separated_chunks_cover_fit_and_overlap(spark):
    rng = random.Random(8)
    texts = ["", None, "x" * 900, "\n\n\n", "one line", "a b\n\nc"] + ["".join(rng.choice(["word", "w", " ", " ", "\n", "\n\n", "é😀"]) for _ in range(rng.randrange(400))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "d long, t string").repartition(5)
    for size, overlap, hard in ((50, 10, False), (20, 0, True), (7, 7, True)):
        got = {}
        for r in sp.separated_chunks(df, "d", "t", size, overlap, hard=hard).orderBy("d", "chunk").collect():
            got.setdefault(r.d, []).append((r.start, r.start + len(r.text), r.text))
        for i, text in enumerate(texts):
            spans = got.get(i, [])
            assert [text[a:b] for a, b, _ in spans] == [x for _, _, x in spans] and bool(spans) == bool(text)
            ends = sp.borders(text or "", size, hard=hard)
            assert ends[0] == 0 and ends[-1] == len(text or "") and ends == sorted(set(ends))
            for (a, b, _), (c, e, _) in zip(spans, spans[1:]):
                assert a < c <= b < e and b - c <= overlap and {a, b, c, e} <= set(ends)
                assert max(x for x in ends if x <= max(a + size, ends[ends.index(a) + 1])) == b
            assert all(b - a <= size or ends.index(b) == ends.index(a) + 1 for a, b, _ in spans)


def test_refined_digest_keeps_every_state(spark):
    df = spark.createDataFrame([(1, "aa\nb\n\ncccc"), (2, ""), (3, None)], "d long, t string")
    row = sp.refined_digest(df, "d", "t").first()
    assert (row.steps, row.digest, row.n_steps) == (["aa", "aa", "cccc"], "cccc", 3)
    states = sp.refined_states(df, "d", "t", lambda summary, piece: f"{summary}<{piece}>").orderBy("step").collect()
    assert [(r.d, r.step, r.piece, r.summary) for r in states] == [(1, 1, "aa", "<aa>"), (1, 2, "b", "<aa><b>"), (1, 3, "cccc", "<aa><b><cccc>")]


def test_many_pieces_cost_no_square(spark):
    text = "\n".join(f"p{k}" for k in range(20_000))
    df = spark.createDataFrame([(1, text)], "d long, t string")
    started = time.perf_counter()
    assert sp.refined_states(df, "d", "t").count() == 20_000
    assert sp.packed_chunks(df, "d", "t", 10).count() > 8_000 and sp.separated_chunks(df, "d", "t", 10, 3).count() > 8_000
    assert time.perf_counter() - started < 30


def test_ordered_text_parts_join_to_the_whole(spark):
    rows = [(i, "hot" if i % 3 else "cold", f"line {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "i long, c string, t string").repartition(6)
    parts = dx.transcripts(df, "c", "i", "t", part_rows=7).orderBy("c", "part").collect()
    for group in ("hot", "cold"):
        assert " ".join(p.text for p in parts if p.c == group) == " ".join(t for _, c, t in rows if c == group)
    assert max(p.n_lines for p in parts) == 7


def test_empty_texts_are_neutral(spark):
    lexicon = spark.createDataFrame([("good", 1), ("bad", -1)], "term string, polarity int")
    df = spark.createDataFrame([(1, "good good bad"), (2, "Bad!"), (3, ""), (4, None)], "k long, t string")
    got = {r.k: (r.polarity, r.sentiment) for r in dx.polarity(df, ["k"], "t", lexicon).collect()}
    assert got == {1: (1, "Positive"), 2: (-1, "Negative"), 3: (0, "Neutral"), 4: (0, "Neutral")}


def test_unescape_equals_the_standard_library(spark):
    import html

    texts = ["&#38;lt;b", "&amp;lt;", "&#128;", "&#0;", "&#xD800;", "&#x0001F600;", "&#x110000;", "&#99999999999999999999;", "&#11;x", "&#13;", "&#xFFFE;", "&frac12;", "&lambda;", "&Auml;", "&amp", "&ampx",
             "&notit;", "&notin;", "&copy2024", "&unknown;", "& &", "&&&", "&;", "&#;", "&#x;", "&#x0;", "&#65", "&#X41;", "a&lt;b&gt;c", "&NotEqualTilde;", "", "plain", "&" + "a" * 60 + ";", "x&nbsp;y", "&#129;"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(tx.unescape(F.col("t"))).collect()]
    assert got == [html.unescape(t) for t in texts]


def test_bullets_lose_any_white_space(spark):
    df = spark.createDataFrame([("\t- item\r",), ("Use `x`",), ("` - a`",), ("3) three ",)], "t string")
    assert [r[0] for r in df.select(tx.without_bullet(F.col("t"))).collect()] == ["item", "Use `x`", "a`", "three"]


def test_clean_html_of_closed_references_as_its_sql_reads_them(spark, tmp_path):
    import duckdb
    from __spark_entry__ import oracle_sql, queries

    rows = [(1, "<title>und&amp;&amp</title><p>&amp &copy; &copy 2</p>"), (2, "&ampersand &amp;quot; &middot;&quot;"), (3, "a&amp")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(map(tuple, queries()["F_clean_html"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(oracle_sql()["F_clean_html"]).fetchall())
    assert one(spark, "&notit; &#65 &#65;&notin;", lambda c: tx.unescape(c, closed=True)) == "&notit; &#65 A∉"


def test_pieces_leave_in_batches_of_about_a_million_characters():
    """What a task holds does not grow with its texts: 400 texts of 1 MB of pieces in all come in one batch and leave in many."""
    schema = pa.schema([("d", pa.int64()), ("piece", pa.string())])
    texts = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(["\n".join([f"{i:03}" + "é" * 96] * 100) for i in range(400)])], ["d", "t"])
    out = list(sp._batches(iter([texts]), lambda whole: ((x,) for x in whole.split("\n")), schema))
    assert max(b.nbytes for b in out) < 2_500_000 and len(out) == 8
    assert [(r["d"], r["piece"][:3]) for b in out for r in b.to_pylist()] == [(i, f"{i:03}") for i in range(400) for _ in range(100)]


def test_words_are_cut_once_for_counts_and_frequencies(spark):
    """The counts are written and read twice; the join on the term hashes the frequencies, so nothing is sorted by term."""
    docs = spark.createDataFrame([(1, "red green red _x 1a"), (2, ""), (3, None), (4, "the and"), (5, "Green blue")], "d int, t string")
    weights = dx.tf_idf(docs, "d", "t")
    plan = weights._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "shuffle_hash" in plan
    assert sorted((r.d, r.term, r.n) for r in weights.collect()) == [(1, "green", 1), (1, "red", 2), (5, "blue", 1), (5, "green", 1)]
    ranked = dx.keywords(weights, "d", 1).collect()
    assert sorted((r.d, r.term, r["rank"]) for r in ranked) == [(1, "red", 1), (5, "blue", 1)]


def test_sentences_are_scored_in_the_row_of_their_document(spark):
    """More documents than are scored together; words cut by a chunk count only where the document has them whole."""
    docs = spark.createDataFrame([(i, f"red w{i}x bluegreen. The and. green blue red!{'' if i % 2 else ' green'}", 0) for i in range(1200)], "d int, t string, other int")
    weights = spark.createDataFrame([(i, t, w) for i in range(1200) if i != 7 for t, w in (("red", 0.1), ("blue", 0.000000007), ("green", 0.25 + i))], "d int, term string, tf_idf double")
    pieces = F.array(F.lit(None).cast("string"), "t", F.lit(""), F.lit("bluegre. en"))
    found = dx.sentence_scores(docs.repartition(2), "d", pieces, weights)
    got = {(r.d, r.chunk, r.sentence): (r.text, r.score) for r in found.collect()}
    want = {}
    for i in range(1200):
        if i != 7:
            last = round(0.35 + i, 6)
            want[i, 1, 0] = (f"red w{i}x bluegreen", 0.1)
            want[i, 1, 2] = ("green blue red", last)
            if i % 2 == 0:
                want[i, 1, 3] = ("green", 0.25 + i)
    assert got == want
    assert "explode(" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row per word
