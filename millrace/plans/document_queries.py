"""Text, retrieval and neighbour queries: X1-X14, J13, M7-M9, F1-F4."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.functions import text as tx
from millrace.operators import aggregates as ag
from millrace.operators import documents as dx
from millrace.operators import neighbours as nb
from millrace.operators import sampling
from millrace.operators import splitting as sp
from millrace.plans.registry import query

STOPS = "[" + ",".join(f"'{w}'" for w in dx.v.STOP_WORDS) + "]"
TOKENS = ("list_filter(regexp_extract_all(lower({c}), '[\\p{L}\\p{N}_]+'), lambda x: regexp_matches(x, '^\\p{L}+$')"
          " AND NOT list_contains(" + STOPS + ", x))")


def tokens_sql(column: str) -> str:
    return TOKENS.replace("{c}", column)


TF_IDF = f"""
words AS (SELECT doc_id, len(w) AS n_tokens, unnest(w) AS term FROM (SELECT doc_id, {tokens_sql('text')} AS w FROM documents)),
tf AS (SELECT doc_id, term, n_tokens, count(*) AS n FROM words GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT doc_id, term, n, round(n / n_tokens, 9) AS tf,
  round(ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1, 9) AS idf,
  round(n / n_tokens * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1), 9) AS tf_idf FROM tf JOIN df USING (term))"""


@query("X1_tokens", f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", dx.tokens(F.col("text")).alias("tokens"))


@query("X2_tf_idf", f"WITH {TF_IDF} SELECT doc_id, term, n, tf, idf, tf_idf FROM weights")
def _(t):
    return dx.tf_idf(t.documents, "doc_id", "text")


@query("X3_keywords", f"""
WITH {TF_IDF} SELECT doc_id, term, tf_idf, r::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf_idf DESC, term) AS r FROM weights) WHERE r <= 5""")
def _(t):
    return dx.keywords(dx.tf_idf(t.documents, "doc_id", "text"), "doc_id").select("doc_id", "term", "tf_idf", "rank")


def chunks_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""chunks AS (
  SELECT doc_id, chunk::INTEGER AS chunk, (chunk * {step})::INTEGER AS start, substr(text, chunk * {step} + 1, {size}) AS text
  FROM (SELECT doc_id, text, unnest(range((1 + ceil(greatest(length(text) - {size}, 0) / {step}))::BIGINT)) AS chunk FROM documents WHERE length(text) > 0))"""


@query("X4_chunks", f"WITH {chunks_sql(100, 25)} SELECT doc_id, chunk, start, text FROM chunks")
def _(t):
    return dx.chunks(t.documents, "doc_id", "text", 100, 25)


@query("X4_line_pieces", """
SELECT doc_id, (i - 1)::INTEGER AS piece, pieces[i] AS text FROM (
  SELECT doc_id, string_split(text, chr(10)) AS pieces, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)""")
def _(t):
    return dx.lines(t.documents, "doc_id", "text")


# Chunks as a recursion over the borders between pieces: i is where a chunk begins, j where it ends.
PACKED = """
state AS (
  SELECT doc_id, 0 AS chunk, 0 AS i, greatest(1, len(list_filter(b, lambda x: x <= {size})) - 1) AS j FROM ends WHERE len(b) > 1
  UNION ALL
  SELECT doc_id, chunk + 1, i, greatest(i + 1, len(list_filter(b, lambda x: x - b[i + 1] <= {size})) - 1) FROM (
    SELECT doc_id, chunk, b, least(j, greatest(len(list_filter(b, lambda x: x < b[j + 1] - {overlap})), len(list_filter(b, lambda x: x < b[j + 2] - {size})))) AS i
    FROM state JOIN ends USING (doc_id) WHERE j + 1 < len(b)))"""


def parts_sql(text: str, separator: str) -> str:
    """Pieces of a text, each with its separator."""
    pieces = f"string_split({text}, {separator})"
    return f"list_filter(list_concat(list_transform({pieces}[1:-2], lambda y: y || {separator}), {pieces}[-1:]), lambda y: y <> '')"


def cut_sql(pieces: str, separator: str, size: int) -> str:
    return f"flatten(list_transform({pieces}, lambda x: CASE WHEN length(x) > {size} THEN {parts_sql('x', separator)} ELSE [x] END))"


LINE, BLANK_LINE = "chr(10)", "chr(10) || chr(10)"
PIECES = cut_sql(cut_sql(cut_sql("[text]", f"({BLANK_LINE})", 500), LINE, 500), "' '", 500)


@query("X4_separated_chunks", f"""
WITH RECURSIVE lengths AS (SELECT doc_id, text, list_transform({PIECES}, lambda x: length(x)) AS n FROM documents WHERE text <> ''),
steps AS (SELECT doc_id, unnest(n) AS n, generate_subscripts(n, 1) AS k FROM lengths),
sums AS (SELECT doc_id, k, sum(n) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS b FROM steps),
ends AS (SELECT doc_id, list_concat([0::BIGINT], list(b ORDER BY k)) AS b FROM sums GROUP BY doc_id),
{PACKED.format(size=500, overlap=50)}
SELECT doc_id, chunk::INTEGER AS chunk, b[i + 1]::INTEGER AS start, substr(text, b[i + 1] + 1, b[j + 1] - b[i + 1]) AS text
FROM state JOIN ends USING (doc_id) JOIN lengths USING (doc_id)""")
def _(t):
    """Paragraphs, or where these are too long lines, or words, in chunks of 500 characters that share up to 50."""
    return sp.separated_chunks(t.documents, "doc_id", "text", 500, 50)


@query("X4_packed_chunks", f"""
WITH RECURSIVE steps AS (SELECT doc_id, length(p[k]) + 1 AS n, k FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS k FROM (
  SELECT doc_id, string_split(coalesce(text, ''), {LINE}) AS p FROM documents))),
sums AS (SELECT doc_id, k, sum(n) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS b FROM steps),
ends AS (SELECT doc_id, list_concat([0::BIGINT], list(b ORDER BY k)) AS b FROM sums GROUP BY doc_id),
{PACKED.format(size=501, overlap=0)}
SELECT doc_id, chunk::INTEGER AS chunk, substr(coalesce(text, ''), b[i + 1] + 1, b[j + 1] - b[i + 1] - 1) AS text FROM state JOIN ends USING (doc_id) JOIN documents USING (doc_id)""")
def _(t):
    return sp.packed_chunks(t.documents, "doc_id", "text", 500)


# The question set: every vector whose id is divisible by 20, against all other vectors.
EVERY = 20
SPLIT = "split AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
DISTANCE = {
    "euclidean": "sqrt(list_sum(list_transform(list_zip(q.v, s.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))",
    "manhattan": "list_sum(list_transform(list_zip(q.v, s.v), lambda x: abs(x[1] - x[2])))",
    "minkowski": "pow(list_sum(list_transform(list_zip(q.v, s.v), lambda x: pow(abs(x[1] - x[2]), 3))), 1.0::DOUBLE / 3)",
    "cosine": "1 - list_cosine_similarity(q.v, s.v)",
}


def found_sql(metric: str, k: int) -> str:
    return f"""{SPLIT}, found AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, row_id)::INTEGER AS rank FROM (
    SELECT q.vec_id AS query_id, s.vec_id AS row_id, s.label, {DISTANCE[metric]} AS distance FROM split q, split s WHERE q.vec_id % {EVERY} = 0 AND s.vec_id <> q.vec_id))
  WHERE rank <= {k})"""


def sides(t):
    queries = t.embeddings.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return queries, t.embeddings.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))


def nearest(t, k, metric="euclidean", p=2.0, search=nb.nearest):
    return search(*sides(t), k, metric, p, others=True)


def labels(t):
    return t.embeddings.select(F.col("vec_id").alias("row_id"), "label")


def rounded(found):
    return found.withColumn("distance", F.round("distance", 6))


for _metric in ("euclidean", "manhattan", "minkowski"):
    @query(f"J13_nearest_{_metric}", f"WITH {found_sql(_metric, 10)} SELECT query_id, row_id, round(distance, 6) AS distance, rank FROM found")
    def _(t, metric=_metric):
        return rounded(nearest(t, 10, metric, 3.0))

    @query(f"J13_pivot_{_metric}", f"WITH {found_sql(_metric, 10)} SELECT query_id, row_id, round(distance, 6) AS distance, rank FROM found")
    def _(t, metric=_metric):
        """The same through pivots, as for more questions than can be broadcast."""
        return rounded(nearest(t, 10, metric, 3.0, nb.nearest_by_pivots))


@query("X5_nearest_chunks", f"WITH {found_sql('cosine', 4)} SELECT query_id, row_id, round(1 - distance, 6) AS similarity, rank FROM found")
def _(t):
    found = nearest(t, 4, "cosine")
    return found.select("query_id", "row_id", F.round(1 - F.col("distance"), 6).alias("similarity"), "rank")


@query("X5_pivot_chunks", f"WITH {found_sql('cosine', 4)} SELECT query_id, row_id, round(1 - distance, 6) AS similarity, rank FROM found")
def _(t):
    found = nearest(t, 4, "cosine", search=nb.nearest_by_pivots)
    return found.select("query_id", "row_id", F.round(1 - F.col("distance"), 6).alias("similarity"), "rank")


PROMPT = "Use the following context to answer the question.\n\n{context}\n\nQuestion: document {question}\nAnswer:"


@query("X6_prompt_from_context", f"""
WITH {found_sql('cosine', 2)}, context AS (
  SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_chunks FROM found JOIN documents ON row_id = doc_id GROUP BY query_id)
SELECT query_id, n_chunks, 'Use the following context to answer the question.' || chr(10) || chr(10) || context || chr(10) || chr(10)
  || 'Question: document ' || query_id || chr(10) || 'Answer:' AS prompt FROM context""")
def _(t):
    """Two texts per question, so its context is small whatever the store holds."""
    found = nearest(t, 2, "cosine")
    texts = t.documents.select(F.col("doc_id").alias("row_id"), "text")
    parts = found.join(texts, "row_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_c"))
    context = F.array_join(F.transform("_c", lambda x: x["text"]), "\n\n")
    before, rest = PROMPT.split("{context}")
    middle, after = rest.split("{question}")
    return parts.select("query_id", F.size("_c").cast("long").alias("n_chunks"),
                        F.concat(F.lit(before), context, F.lit(middle), F.col("query_id").cast("string"), F.lit(after)).alias("prompt"))


def scored_sql(pieces: str, keys: str) -> str:
    return f"""pieces AS ({pieces}), sentences AS (
  SELECT * FROM (SELECT {keys}, (i - 1)::INTEGER AS sentence, trim(s[i]) AS text FROM (
    SELECT {keys}, regexp_split_to_array(text, '[.!?\\n]+') AS s, unnest(range(1, len(regexp_split_to_array(text, '[.!?\\n]+')) + 1)) AS i FROM pieces)) WHERE text <> ''),
scored AS (
  SELECT {keys}, sentence, any_value(text) AS text, round(sum(tf_idf::DECIMAL(18,9)), 6)::DOUBLE AS score
  FROM (SELECT {keys}, sentence, text, unnest({tokens_sql('text')}) AS term FROM sentences) JOIN weights USING (doc_id, term) GROUP BY {keys}, sentence)"""


@query("X7_sentence_scores", f"""
WITH {TF_IDF}, {chunks_sql(500, 5)}, {scored_sql('SELECT doc_id, chunk, text FROM chunks', 'doc_id, chunk')} SELECT doc_id, chunk, sentence, text, score FROM scored""")
def _(t):
    weights = dx.tf_idf(t.documents, "doc_id", "text")
    return dx.sentence_scores(t.documents, "doc_id", dx.chunk_texts(F.col("text"), 500, 5), weights)


@query("X7_map_reduce_digest", f"""
WITH {TF_IDF}, {chunks_sql(500, 5)}, {scored_sql('SELECT doc_id, chunk, text FROM chunks', 'doc_id, chunk')},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk ORDER BY score DESC, sentence) AS r FROM scored) WHERE r = 1)
SELECT doc_id, count(*) AS n_sentences, string_agg(text, '. ' ORDER BY chunk, sentence) AS digest FROM best GROUP BY doc_id""")
def _(t):
    return dx.map_reduce_digest(t.documents, "doc_id", "text", 500, 5)


@query("X8_stuffed_digest", f"""
WITH {TF_IDF}, {scored_sql('SELECT doc_id, text FROM documents', 'doc_id')},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sentence) AS r FROM scored) WHERE r <= 3)
SELECT doc_id, count(*) AS n_sentences, string_agg(text, '. ' ORDER BY sentence) AS digest FROM best GROUP BY doc_id""")
def _(t):
    return dx.stuffed_digest(t.documents, "doc_id", "text")


@query("X9_refined_digest", """
WITH pieces AS (SELECT doc_id, i, p[i] AS piece FROM (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS p, unnest(range(1, len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) + 1)) AS i FROM documents)),
steps AS (SELECT doc_id, i, (SELECT q.piece FROM pieces q WHERE q.doc_id = p.doc_id AND q.i <= p.i ORDER BY length(q.piece) DESC, q.i LIMIT 1) AS state FROM pieces p)
SELECT doc_id, count(*) AS n_steps, list(state ORDER BY i) AS steps, last(state ORDER BY i) AS digest FROM steps GROUP BY doc_id""")
def _(t):
    return sp.refined_digest(t.documents, "doc_id", "text")


@query("X9_refined_states", """
WITH pieces AS (SELECT doc_id, i, p[i] AS piece FROM (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS p, unnest(range(1, len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) + 1)) AS i FROM documents))
SELECT doc_id, i::INTEGER AS step, piece, arg_max(piece, length(piece) * 10000000 - i) OVER (PARTITION BY doc_id ORDER BY i) AS summary FROM pieces""")
def _(t):
    """Every state of the refinement, by a Python step."""
    return sp.refined_states(t.documents, "doc_id", "text")


# A small word list with signs for the synthetic prose.
LEXICON = [("the", 1), ("with", 1), ("that", -1), ("les", 1), ("que", -1), ("der", 1), ("nicht", -1), ("por", 1), ("los", -1), ("not", -1), ("was", -1)]
LEXICON_SQL = "lexicon(term, polarity) AS (VALUES " + ",".join(f"('{w}', {s})" for w, s in LEXICON) + ")"
PLAIN_TOKENS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: regexp_matches(x, '^\p{L}+$'))"
POLARITY = f"""
turns AS (SELECT c.conv_id, c.turn, coalesce(sum(polarity), 0)::BIGINT AS polarity FROM conversations c
  LEFT JOIN (SELECT conv_id, turn, unnest({PLAIN_TOKENS}) AS term FROM conversations) w USING (conv_id, turn) LEFT JOIN lexicon USING (term) GROUP BY c.conv_id, c.turn)"""
LABEL = "CASE WHEN polarity > 0 THEN 'Positive' WHEN polarity < 0 THEN 'Negative' ELSE 'Neutral' END"


def lexicon(t):
    return t.spark.createDataFrame(LEXICON, "term string, polarity int")


@query("X10_sentiment", f"WITH {LEXICON_SQL}, {POLARITY} SELECT conv_id, turn, polarity, {LABEL} AS sentiment FROM turns")
def _(t):
    return dx.polarity(t.conversations, ["conv_id", "turn"], "text", lexicon(t))


@query("X11_transcripts", """
SELECT conv_id, (place - 1) // 4 AS part, count(*) AS n_lines, string_agg(line, ' ' ORDER BY place) AS text FROM (
  SELECT conv_id, replace(text, chr(10), ' ') AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations)
GROUP BY conv_id, (place - 1) // 4""")
def _(t):
    return dx.transcripts(t.conversations, "conv_id", "turn", "text", part_rows=4)


ACTIONS = [("the .* and", "call back"), ("que|der", "send form")]


@query("X12_call_records", f"""
WITH {LEXICON_SQL}, {POLARITY}, overall AS (SELECT conv_id, sum(polarity)::BIGINT AS polarity, count(*) AS n_turns FROM turns GROUP BY conv_id),
reasons AS (SELECT conv_id, arg_min(text, turn) AS reason FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT conv_id, polarity, n_turns, reason, {LABEL} AS sentiment,
  CASE WHEN regexp_matches(reason, '(?i)the .* and') THEN 'call back' WHEN regexp_matches(reason, '(?i)que|der') THEN 'send form' ELSE 'close' END AS action
FROM overall LEFT JOIN reasons USING (conv_id)""")
def _(t):
    return dx.call_records(t.conversations, "conv_id", "turn", "role", "text", lexicon(t), ACTIONS, "close")


@query("X13_article_records", r"""
WITH c AS (SELECT page_id, CASE WHEN len(p) > 0 THEN array_to_string(p, '') ELSE html END AS content FROM (SELECT page_id, html, regexp_extract_all(html, '<p>([^<]*)', 1) AS p FROM pages))
SELECT page_id, regexp_extract(content, '<img[^>]*src=["'']([^"'']*)["'']', 1) AS image,
  trim(regexp_replace(replace(replace(replace(replace(regexp_replace(content, '<[^>]+>', ' ', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '"""
       + tx.SPACES + "', ' ', 'g')) AS content FROM c")
def _(t):
    parts = F.regexp_extract_all("html", F.lit("<p>([^<]*)"), F.lit(1))
    return dx.article_records(t.pages, "page_id", parts, F.col("html"))


TRUST = [["src7", "src11"], ["src2", "src5"]]


@query("X14_most_trusted_story", """
SELECT doc_id, source, story, trust FROM (
  SELECT *, row_number() OVER (PARTITION BY story ORDER BY trust, doc_id) AS r FROM (
    SELECT doc_id, source, md5(lower(trim(text))) AS story, CASE WHEN source IN ('src7', 'src11') THEN 0 WHEN source IN ('src2', 'src5') THEN 1 ELSE 2 END AS trust FROM documents)) WHERE r = 1""")
def _(t):
    rows = t.documents.select("doc_id", "source", F.md5(F.lower(F.trim("text"))).alias("story"))
    return dx.most_trusted(rows, ["story"], tx.trust_rank(F.col("source"), TRUST), "doc_id")


@query("M7_knn_classify", f"""
WITH {found_sql('euclidean', 5)}, votes AS (SELECT query_id, label, count(*) AS votes FROM found GROUP BY ALL)
SELECT query_id, label AS predicted, votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS r FROM votes) WHERE r = 1""")
def _(t):
    return nb.classify(nearest(t, 5), labels(t))


@query("M7_knn_accuracy", f"""
WITH {found_sql('manhattan', 5)}, votes AS (SELECT query_id, label, count(*) AS votes FROM found GROUP BY ALL),
best AS (SELECT query_id, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS r FROM votes) WHERE r = 1)
SELECT count(*) AS n, round(100 * avg(CASE WHEN label = predicted THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy_percent FROM best JOIN embeddings ON vec_id = query_id""")
def _(t):
    predicted = nb.classify(nearest(t, 5, "manhattan"), labels(t))
    actual = t.embeddings.select(F.col("vec_id").alias("query_id"), "label")
    return ag.accuracy_percent(predicted.join(actual, "query_id"), "label", "predicted")


@query("M8_knn_regress", f"WITH {found_sql('euclidean', 5)} SELECT query_id, round(avg(label), 6) AS predicted, count(*) AS n FROM found GROUP BY query_id")
def _(t):
    targets = t.embeddings.select(F.col("vec_id").alias("row_id"), F.col("label").alias("target"))
    return nb.regress(nearest(t, 5), targets)


@query("M9_kmeans_one_step", """
WITH start AS (SELECT row_number() OVER (ORDER BY md5(vec_id || ':seed'), vec_id) - 1 AS i, embedding::DOUBLE[] AS c FROM embeddings ORDER BY md5(vec_id || ':seed'), vec_id LIMIT 4),
d AS (SELECT vec_id, i, list_sum(list_transform(list_zip(embedding::DOUBLE[], c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d FROM embeddings, start)
SELECT vec_id, i::INTEGER AS cluster FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, i) AS r FROM d) WHERE r = 1""")
def _(t):
    points = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    centres = nb.initial_centres(points, "vec_id", "embedding", 4, "seed")
    return nb.assigned(points, "embedding", centres).select("vec_id", "cluster")


@query("M9_kmeans_new_centres", """
WITH start AS (SELECT row_number() OVER (ORDER BY md5(vec_id || ':seed'), vec_id) - 1 AS i, embedding::DOUBLE[] AS c FROM embeddings ORDER BY md5(vec_id || ':seed'), vec_id LIMIT 4),
d AS (SELECT vec_id, embedding::DOUBLE[] AS v, i, list_sum(list_transform(list_zip(embedding::DOUBLE[], c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d FROM embeddings, start),
a AS (SELECT v, i FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, i) AS r FROM d) WHERE r = 1)
SELECT i AS cluster, position - 1 AS position, round(avg(x), 6) AS mean FROM (SELECT i, unnest(v) AS x, generate_subscripts(v, 1) AS position FROM a) GROUP BY ALL""")
def _(t):
    points = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    moved = nb.updated_centres(points, "embedding", nb.initial_centres(points, "vec_id", "embedding", 4, "seed"))
    rows = [(i, j, round(x, 6)) for i, centre in enumerate(moved) for j, x in enumerate(centre)]
    return t.spark.createDataFrame(rows, "cluster long, position long, mean double")


@query("M9_kmeans_clusters")
def _(t):
    clusters, _centres, _n = nb.k_means(t.embeddings, "vec_id", "embedding", 3, "seed")
    return clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def _counted(texts: pd.Series) -> pd.DataFrame:
    """A stand-in for an external model: words and characters of each text."""
    return pd.DataFrame({"n_words": texts.str.split().str.len().astype("int64"), "n_letters": texts.str.len().astype("int64")})


@query("F1_text_map", "SELECT conv_id, turn, len(regexp_extract_all(text, '\\S+')) AS n_words, length(text) AS n_letters FROM conversations")
def _(t):
    schema = StructType([StructField("n_words", LongType()), StructField("n_letters", LongType())])
    return dx.text_map(t.conversations, "text", _counted, schema).select("conv_id", "turn", "n_words", "n_letters")


@query("F2_array_aggregate", """
SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings""")
def _(t):
    squares = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)
    return t.embeddings.select("vec_id", "label", F.round(F.sqrt(squares), 6).alias("norm"))


@query("F3_text_to_chunks", f"WITH {chunks_sql(500, 5)} SELECT doc_id, count(*) AS n_chunks, max(start)::INTEGER AS last_start FROM chunks GROUP BY doc_id")
def _(t):
    return dx.chunks(t.documents, "doc_id", "text", 500, 5).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("start").alias("last_start"))


def _fold_fit(frame: pd.DataFrame) -> pd.DataFrame:
    """A model per fold: the least-squares slope over the fold's cell means."""
    x, y, n = (frame[c].to_numpy(float) for c in ("size", "mean_price", "n"))
    mx, my = np.average(x, weights=n), np.average(y, weights=n)
    slope = np.sum(n * (x - mx) * (y - my)) / np.sum(n * (x - mx) ** 2)
    return pd.DataFrame({"fold": [frame["fold"].iloc[0]], "n": [int(n.sum())], "slope": [round(float(slope), 6)]})


@query("F4_model_per_fold", """
SELECT fold, count(*) AS n, round(regr_slope(p_retailprice, p_size::DOUBLE), 6) AS slope FROM (
  SELECT *, ((row_number() OVER (PARTITION BY p_type ORDER BY md5(p_partkey || ':fold'), p_partkey) - 1) % 5)::INTEGER AS fold FROM part) GROUP BY fold""")
def _(t):
    """Rows are reduced to (fold, size) cells first: the Python function of a
    fold sees at most one row per size, however many rows the fold has."""
    rows = sampling.folds(t.part, ["p_type"], "p_partkey", 5, "fold")
    grouped = rows.groupBy("fold", F.col("p_size").alias("size")).agg(F.avg("p_retailprice").alias("mean_price"), F.count(F.lit(1)).alias("n"))
    return grouped.groupBy("fold").applyInPandas(_fold_fit, "fold int, n long, slope double")
