"""Personal data: fixed patterns, and words that give a protected value away.

The main path is DataFrame functions only. Spans of the four fixed kinds are
found first. Then the corpus says how much each word near such a value tells
about it: with n documents, n(e) with the value, n(t) with the word and n(e, t)
with the word next to the value, the value carries log(n / n(e)) bits and the
word gives away PMI(e, t) = log(n * n(e, t) / (n(e) * n(t))) of them. Where the
share reaches a threshold, the word is generalised wherever it stands in the
documents that hold the value; where it is close to all, it is removed.

Spans are written before anything is worked out from them, so that no expression
looks for them again at each of them: a text of many thousand values costs its
length a few times, not once for each value and step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written
from millrace.session import scratch_path, spread

KINDS = ("email", "ip", "card", "phone")
# Leftmost matches of the four kinds. A run of characters is tried from its
# start only, or from where the match before ended, which finds the same
# matches without trying each tail of a long run; possessive repeats keep the
# matcher from recursing on very long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold at least for a kind to be looked for.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
CONTEXT = 64  # characters looked at on either side of a value
FOLDED = 128  # items of an array that one inner fold takes
MIN_TEXTS = 3  # different texts in which word and value must meet
GENERALISE, REMOVE = 0.9, 0.98  # shares of a value's information
WORD = r"\p{L}++"
SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches, in code points. ``split`` gives the lengths between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.split(text, pattern, -1)
    steps = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("value"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["value"])
        return F.struct(end.alias("at"), F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")).alias("made"))

    return F.when(F.size(found) > 0, _folded(steps, step, "struct<start:int,end:int,value:string>")["out"]).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _folded(items: Column, step: Callable[[Column, Column], Column], made: str) -> Column:
    """``at`` and ``out`` of a fold from ``at`` 0: ``step(acc, item)`` gives the next ``at`` and what is ``made`` of the item.

    Items go in blocks, so that the growing array is copied once a block and not once an item.
    """
    empty = F.array().cast(f"array<{made}>")
    # Bound to a variable: in the function of each block the expression itself would be worked out anew.
    blocks = _bound(items, lambda own: F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / FOLDED).cast("int")), lambda k: F.slice(own, k * FOLDED + 1, FOLDED)))

    def add(acc: Column, x: Column) -> Column:
        return _bound(step(acc, x), lambda new: F.struct(new["at"].alias("at"), F.concat(acc["out"], F.array(new["made"])).alias("out")))

    def block(acc: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(acc["at"].alias("at"), empty.alias("out")), add)
        return _bound(inner, lambda new: F.struct(new["at"].alias("at"), F.concat(acc["out"], new["out"]).alias("out")))

    return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), empty.alias("out")), block)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if the check digit of a string of digits is right."""
    turned = F.reverse(number)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(turned, k, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(k % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(digits(value))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All valid spans of the fixed kinds, by kind and then by start."""
    parts = []
    for k, kind in enumerate(KINDS):
        spans = F.filter(located(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
        spans = F.transform(spans, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
        hint = F.contains(text, F.lit(HINTS[kind])) if HINTS[kind] else text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")
        parts.append(F.when(hint, spans).otherwise(F.array().cast(SPAN)))
    return F.concat(*parts)


def _line(spans: Column) -> Column:
    """Spans in the order of the text."""
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))


def _entity(kind: Column, value: Column) -> Column:
    return F.concat_ws(":", kind.cast("string"), F.lower(value))


def _context(text: Column, line: Column) -> Column:
    """Words next to each span of a written ``line``, with the value they stand beside. Windows end at the next span; cut words are left out."""
    n = F.size(line)

    def side(s: Column, window: Column, cut_left: Column, cut_right: Column) -> Column:
        def words(own: Column) -> Column:
            inner = F.filter(located(own, WORD), lambda w: ~(cut_left & (w["start"] == 0)) & ~(cut_right & (w["end"] == F.length(own))))
            return F.transform(inner, lambda w: F.struct(_entity(s["kind"], s["value"]).alias("entity"), F.lower(w["value"]).alias("term")))

        return _bound(window, words)

    def around(s: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get(line, k - 1)["end"]).otherwise(F.lit(0))
        after = F.when(k + 1 < n, F.get(line, k + 1)["start"]).otherwise(F.length(text))
        left = F.greatest(before, s["start"] - CONTEXT)
        right = F.least(after, s["end"] + CONTEXT)
        return F.concat(
            side(s, F.substring(text, left + 1, F.greatest(F.lit(0), s["start"] - left)), left > before, F.lit(False)),
            side(s, F.substring(text, s["end"] + 1, F.greatest(F.lit(0), right - s["end"])), F.lit(False), right < after))

    return F.flatten(F.transform(line, around))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_texts: int = MIN_TEXTS, generalise: float = GENERALISE) -> tuple[DataFrame, DataFrame]:
    """Base spans of every row (``doc_id``, ``key``, ``spans``) and words that give a value away (``key``, ``terms``: start, end, share).

    ``key`` stands for the text. What the patterns find is written to the shared
    folder, with the text where there is a value in it, and so are the words
    around the values.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "private")
    source = spread(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")))
    found = written(source.withColumn("spans", base_spans(F.col("text")))
                    .select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"), "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text")), f"{folder}/found")
    total = found.count()
    holding = found.where("text IS NOT NULL")
    lines = written(spread(holding.select("key", "text", _line(F.col("spans")).alias("line"))), f"{folder}/lines")
    near = written(lines.select("key", F.array_distinct(_context(F.col("text"), F.col("line"))).alias("context")).where(F.size("context") > 0), f"{folder}/near")
    words = F.array_distinct(F.split(F.lower(F.col("text")), r"[^\p{L}]+"))
    held = source.select(F.explode(words).alias("term")).where("term != ''").groupBy("term").agg(F.count("*").alias("n_term"))
    named = holding.select("key", F.explode(F.array_distinct(F.transform("spans", lambda s: _entity(s["kind"], s["value"])))).alias("entity"))
    values = named.groupBy("entity").agg(F.count("*").alias("n_entity"))
    # Once a row and once a text: copies weigh in the shares as in the other counts, but are one witness.
    rows = near.select("key", F.explode("context").alias("p"))
    pairs = (rows.groupBy("p.entity", "p.term", "key").agg(F.count("*").alias("n")).groupBy("entity", "term")
             .agg(F.sum("n").alias("n_both"), F.count("*").alias("n_texts")).where(F.col("n_texts") >= min_texts))
    n = F.lit(float(max(total, 1)))
    told = F.log(n * F.col("n_both") / (F.col("n_entity") * F.col("n_term"))) / F.log(n / F.col("n_entity"))
    giving = written(pairs.join(values, "entity").join(held, "term").withColumn("share", told).where(F.col("share") >= generalise).select("entity", "term", "share"), f"{folder}/giving")
    # Each text that holds the value: all places of its words there.
    told_in = named.distinct().join(giving, "entity").groupBy("key", "term").agg(F.max("share").alias("share"))
    asked = told_in.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("asked"))
    texts = lines.join(asked, "key").groupBy("key").agg(F.first("text").alias("text"), F.first("asked").alias("asked"))
    placed = F.filter(located(F.col("text"), WORD), lambda w: F.map_contains_key("asked", F.lower(w["value"])))
    terms = texts.select("key", F.transform(placed, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.element_at("asked", F.lower(w["value"])).alias("share"))).alias("terms"))
    # Written, so that the join of the rows splits a text of many copies.
    return found.select("doc_id", "key", "spans"), written(terms.where(F.size("terms") > 0), f"{folder}/terms")


def _joined(kinds: Column) -> Column:
    return F.concat_ws(",", kinds)


def _named(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_texts: int = MIN_TEXTS, generalise: float = GENERALISE) -> DataFrame:
    """Per row: ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans`` (kind:start:end, base kinds first, then ``term``) and ``n_term``.

    A null or empty text has no spans. Repeated rows each get the same result;
    null keys stay; an empty table gives no rows; other columns are ignored.
    """
    found, terms = find(docs, id_col, text_col, min_texts, generalise)
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    flat = found.select("doc_id", "key", *counts, _named(F.col("spans")).alias("_base"))
    extra = F.transform(F.coalesce(F.col("terms"), F.array().cast("array<struct<start:int,end:int,share:double>>")),
                        lambda t: F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["end"].cast("string")))
    return flat.join(terms, "key", "left").select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.sha2(_joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat("_base", extra)).alias("spans"), F.size(extra).cast("long").alias("n_term"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_texts: int = MIN_TEXTS,
          generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``docs`` with every base span replaced by ``<EMAIL>``, ``<IP>``, ``<CARD>``, ``<PHONE>``, words that give a value
    away by ``<TERM>``, and those that tell nearly all of it removed. All columns stay, whatever their names; texts without
    spans stay as they are, null ones null; repeated rows are each cleaned; an empty table stays empty. Where spans of two
    kinds overlap, the first in the text is replaced and the rest of the other goes.
    """
    _, terms = find(docs, id_col, text_col, min_texts, generalise)
    # All columns travel in one, so that none can clash.
    packed = spread(docs).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").alias("text"))
    marked = packed.withColumn("spans", F.when(F.col("text").isNotNull(), base_spans(F.col("text"))).otherwise(F.array().cast(SPAN)))
    plain = marked.where(F.size("spans") == 0).select("row.*")
    named = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(named, s["kind"]).alias("mark")))
    held = written(marked.where(F.size("spans") > 0).select("row", F.md5(F.col("text").cast("binary")).alias("key"), base.alias("base")), scratch_path(docs.sparkSession, "held"))
    extra = F.transform(F.coalesce(F.col("terms"), F.array().cast("array<struct<start:int,end:int,share:double>>")),
                        lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["share"] >= remove, "").otherwise("<TERM>").alias("mark")))
    text = F.col("row")[text_col]

    def put(acc: Column, s: Column) -> Column:
        between = F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(between, s["mark"])).otherwise("").alias("made"))

    folded = _folded(F.array_sort(F.concat("base", extra)), put, "string")
    done = _bound(folded, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    cleaned = held.join(terms, "key", "left").select(*(done.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
    return plain.unionByName(cleaned)


__all__ = ["clean", "find", "spans"]
