"""Repair of conversations at the least cost, in linear space.

A repaired conversation reads ``(s?(ua)+)?`` in the first letters of its roles: perhaps a system turn, then user and
assistant in turn, or nothing. Four states say how far that has come. Edits, with cost: Keep 0, Rerole 3, Delete 4
(the only one for blank and duplicate rows), Insert 3; a truncated row that stays adds 3. Of the cheapest edits those
count whose initials come first in ASCII order.

Hirschberg's division. A pass from the front gives the least cost of arriving in each state behind the middle row and
the ASCII order of the four arriving audits (two different audits that end with the same row are never prefixes of each
other, so this order decides whatever follows). A pass from the back gives the least cost from each state to the end.
They meet in the middle; of the cheapest crossings the one with the first audit is taken, and both halves are solved
likewise. Vectors count up from their least entry, so there are few different ones and each step is looked up.

No conversation has to fit into a task. Rows are sorted by range, conversation and turn together, and packed into blocks
of at most 4,096 rows. A block is summed up as costs and orders from each state to each; those of a conversation are
put together (a few hundred bytes a block), which gives the states at the borders, and each block is solved by itself.
Only the digest of a conversation (its audit and its SHA-256, which no tasks can share) streams its rows through one
task, in sorted order and one batch at a time.

Nulls: a null role or text is one space, which like an empty role cannot be kept; null turns come first; rows of a null conversation are one conversation. Rows
of one turn stand in the order of role and then of a hash, copies next to each other (the later ones are duplicates,
counted and never multiplied out before the digest). A conversation whose rows are all gone has zeros, an empty audit
and the hash of the empty string. No conversations, no rows. A very long text costs its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, written
from millrace.session import scratch_path

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK = 4096
INITIALS = "sua"
SPACE = " \t\n\x0b\x0c\r"
FAR = 1 << 40  # no way leads there
# States: nothing yet, a system turn, a user turn, an assistant turn. What the grammar wants next, and where a kept role leads.
WANTED = ("user", "user", "assistant", "user")
NEXT = (2, 2, 3, 2)
KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
TO_END = (0, 2, 1, 0)  # turns still to insert
OK, CUT, GONE = 0, 4, 8  # a row's code: place of its initial in INITIALS (3: another) plus one of these


@lru_cache(None)
def _ways(state: int, code: int) -> tuple[tuple[str, int, int], ...]:
    """Edits that lead over one row: letters (inserts before it, then its own), state behind it, cost."""
    out = []
    for inserts in range(3):
        paid, before = INSERT * inserts, "I" * inserts
        out.append((before + "D", state, paid + DELETE))
        if code < GONE:
            stays = paid + (TRUNCATED if code >= CUT else 0)
            if (state, code & 3) in KEPT:
                out.append((before + "K", KEPT[state, code & 3], stays + KEEP))
            out.append((before + "R", NEXT[state], stays + REROLE))
        state = NEXT[state]
    return tuple(out)


@lru_cache(None)
def _forward(costs: tuple, ranks: tuple, code: int) -> tuple[tuple, tuple, int]:
    """Least costs of arriving behind a row, the order of the arriving audits, and what was taken off the costs."""
    best: list = [(FAR,)] * 4
    for s in range(4):
        if costs[s] < FAR:
            for letters, t, paid in _ways(s, code):
                best[t] = min(best[t], (costs[s] + paid, ranks[s], letters))
    order = sorted((b[1:], t) for t, b in enumerate(best) if b[0] < FAR)
    place = {t: k for k, (_, t) in enumerate(order)}
    least = min(b[0] for b in best)
    return tuple(b[0] - least if b[0] < FAR else FAR for b in best), tuple(place.get(t, 4) for t in range(4)), least


@lru_cache(None)
def _backward(costs: tuple, code: int) -> tuple:
    """Least costs from before a row to the end, less the least of them."""
    out = [min(min(paid + costs[t] for _, t, paid in _ways(s, code)), FAR) for s in range(4)]
    least = min(out)
    return tuple(c - least if c < FAR else FAR for c in out)


def _only(state: int) -> tuple:
    return tuple(0 if s == state else FAR for s in range(4))


def _arrive(codes: bytes, state: int) -> tuple[tuple, tuple, int]:
    costs, ranks, total = _only(state), _only(state), 0
    for code in codes:
        costs, ranks, more = _forward(costs, ranks, code)
        total += more
    return costs, ranks, total


def solve(codes: bytes, start: int, end: int) -> list[str]:
    """Letters for each row (inserts before it included) of the cheapest, then ASCII-least way between two states."""
    out: list[str] = []
    todo = [(0, len(codes), start, end)] if codes else []
    while todo:  # a stack: the left half is always solved before the right one
        low, high, s, t = todo.pop()
        if high - low == 1:
            out.append(min((paid, letters) for letters, to, paid in _ways(s, codes[low]) if to == t)[1])
            continue
        mid = (low + high) // 2
        costs, ranks, _ = _arrive(codes[low:mid], s)
        rest = _only(t)
        for code in reversed(codes[mid:high]):
            rest = _backward(rest, code)
        _, _, cross = min((costs[x] + rest[x], ranks[x], x) for x in range(4))
        todo += [(mid, high, cross, t), (low, mid, s, cross)]
    return out


# ---------------------------------------------------------------- rows

def _key(column: Column) -> Column:
    """A conversation's name; a null has one too."""
    return F.coalesce(F.concat(F.lit("v"), column.cast("string")), F.lit("null"))


def turns_of(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The four columns under fixed names; null roles and texts as one space."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role_col, text_col))
    return df.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"), text.alias("text"))


def damage(turns: DataFrame) -> DataFrame:
    """Some rows, by a hash of conversation and turn: dropped, emptied, without their full stops, doubled, of role user."""
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")])
    hurt = F.crc32(name.cast("binary")) % 20
    text = F.when(hurt == 1, "").when(hurt == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(hurt == 4, "user").otherwise(F.col("role"))
    return turns.where(hurt != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(hurt == 3, 2).otherwise(1))).alias("_")).drop("_")


def _coded(rows: DataFrame, folder: str) -> DataFrame:
    """Rows with their codes; a row of a conversation that others repeat knows whether it is the first."""
    turn = F.struct(F.col("turn").isNotNull().alias("later"), F.col("turn"))
    firsts = written(rows.groupBy("conv", "said").agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("conv", "said", "first"),
                     f"{folder}/firsts")
    kept = F.expr(f"trim(TRAILING '{SPACE}' FROM text)")
    ended = F.substring(kept, -1, 1).isin(".", "!", "?")
    small = rows.select("conv", "turn", "role", "row", "said", "copies", (kept == "").alias("blank"), ended.alias("ended"))
    later = F.coalesce(turn > F.col("first"), F.lit(False))
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    place = F.when((F.length("role") == 0) | (initial == 0), 3).otherwise(initial - 1)
    kind = F.when(F.col("blank") | F.col("later"), GONE).when(F.col("ended"), OK).otherwise(CUT)
    return small.join(firsts, ["conv", "said"], "left").withColumn("later", later).select(
        "conv", "turn", "role", "row", (place + kind).cast("int").alias("code"), "copies", "blank", "later")


_LONG, _INTS = pa.int64(), pa.list_(pa.int64())
_SUMS = ["illegal", "turns", "blank", "duplicate", "truncated"]
_BLOCK = pa.schema([("conv", pa.string()), ("block", _LONG), ("codes", pa.binary()), ("copies", _INTS), ("rows", pa.list_(pa.binary())),
                    ("costs", _INTS), ("ranks", _INTS), ("first", _LONG), ("last", _LONG), ("low", _LONG), ("high", _LONG),
                    ("first_turn", _LONG), ("last_turn", _LONG), *[(c, _LONG) for c in _SUMS]])
_BLOCK_SQL = ("conv string, block long, codes binary, copies array<long>, rows array<binary>, costs array<long>, ranks array<long>, first long, last long, "
              "low long, high long, first_turn long, last_turn long, illegal long, turns long, blank long, duplicate long, truncated long")


def _legal(one: int, two: int) -> bool:
    return (one, two) in ((0, 1), (1, 2), (2, 1))


def _spread_codes(codes: bytes, copies: list[int]) -> tuple[bytes, list[tuple[int, int]]]:
    """Codes with one deleted row more for all further copies of a row; for each: the row it is of, and how many it stands for."""
    out, what = bytearray(), []
    for k, (code, n) in enumerate(zip(codes, copies)):
        out.append(code)
        what.append((k, 1))
        if n > 1:
            out.append(code & 3 | GONE)
            what.append((k, n - 1))
    return bytes(out), what


def _summed_up(conv: str, block: int, rows: list[tuple]) -> dict:
    """rows: conv, turn, row, code, copies, blank, later."""
    codes, copies = bytes(r[3] for r in rows), [r[4] for r in rows]
    run, _ = _spread_codes(codes, copies)
    costs, ranks = [], []
    more = DELETE * sum(n - 2 for n in copies if n > 1)
    for s in range(4):
        c, r, total = _arrive(run, s)
        costs += [x + total + more if x < FAR else FAR for x in c]
        ranks += r
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [code & 3 for code in codes]
    blank = sum(n for r, n in zip(rows, copies) if r[5])
    duplicate = sum(n if r[6] else n - 1 for r, n in zip(rows, copies) if not r[5])
    return dict(conv=conv, block=block, codes=codes, copies=copies, rows=[r[2] for r in rows], costs=costs, ranks=ranks, first=initials[0], last=initials[-1],
                low=min(turns, default=None), high=max(turns, default=None), first_turn=rows[0][1], last_turn=rows[-1][1], turns=len(set(turns)), blank=blank,
                duplicate=duplicate, truncated=sum(CUT <= c < GONE for c in codes),
                illegal=sum(n - 1 for n in copies) + sum(not _legal(a, b) for a, b in zip(initials, initials[1:])))


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 500) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed():
        block = TaskContext.get().partitionId() << 32
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            held = []
            for row in rows:
                held.append(row)
                if len(held) == BLOCK:
                    yield _summed_up(conv, block, held)
                    block, held = block + 1, []
            if held:
                yield _summed_up(conv, block, held)
                block += 1
    return _batches(packed(), _BLOCK, 50)


_SUMMARY = ["conv", "block", "costs", "ranks", "first", "last", "low", "high", "first_turn", "last_turn", *_SUMS]
_BORDER = pa.schema([("conv", pa.string()), ("block", _LONG), ("start", _LONG), ("end", _LONG), ("inserts", _LONG), ("gaps", _LONG), *[(c, _LONG) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]])
_BORDER_SQL = "conv string, block long, start long, end long, inserts long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _conversation(blocks: list[dict]) -> Iterator[dict]:
    """States at the borders of a conversation's blocks; the last block's row also has its figures."""
    costs, ranks, ways = _only(0), _only(0), []
    for b in blocks:
        best: list = [(FAR,)] * 4
        for s in range(4):
            if costs[s] < FAR:
                for t in range(4):
                    if b["costs"][4 * s + t] < FAR:
                        best[t] = min(best[t], (costs[s] + b["costs"][4 * s + t], ranks[s], b["ranks"][4 * s + t], s))
        order = sorted((x[1:3], t) for t, x in enumerate(best) if x[0] < FAR)
        place = {t: k for k, (_, t) in enumerate(order)}
        costs, ranks = tuple(x[0] for x in best), tuple(place.get(t, 4) for t in range(4))
        ways.append(tuple(x[-1] for x in best))
    cost, _, state = min((costs[t] + INSERT * TO_END[t], ranks[t], t) for t in range(4))
    inserts = TO_END[state]
    sums = {c: sum(b[c] for b in blocks) for c in _SUMS}
    for a, b in zip(blocks, blocks[1:]):
        sums["illegal"] += not _legal(a["last"], b["first"])
        sums["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    low, high = min((b["low"] for b in blocks if b["low"] is not None), default=None), max((b["high"] for b in blocks if b["high"] is not None), default=None)
    figures = dict(gaps=0 if low is None else high - low + 1 - sums.pop("turns"), cost=cost, **sums)
    for k in range(len(blocks) - 1, -1, -1):
        start = ways[k][state]
        yield dict(conv=blocks[k]["conv"], block=blocks[k]["block"], start=start, end=state, inserts=inserts, **{c: figures.get(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")})
        state, inserts, figures = start, 0, {}


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def solved():
        for _, blocks in groupby(_rows(batches), key=lambda r: r[0]):
            yield from _conversation([dict(zip(_SUMMARY, b)) for b in blocks])
    return _batches(solved(), _BORDER)


_EDIT = pa.schema([("conv", pa.string()), ("block", _LONG), ("nth", _LONG), ("row", pa.binary()), ("edit", pa.string()), ("times", _LONG), ("new_role", pa.string())])
_EDIT_SQL = "conv string, block long, nth long, row binary, edit string, times long, new_role string"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made():
        for conv, block, codes, copies, rows, start, end, inserts in _rows(batches):
            nth, state = 0, start
            run, what = _spread_codes(codes, copies)
            letters = solve(run, start, end)
            for code, (k, times), word in zip(run, what, letters):
                for edit in word:
                    own = edit != "I"
                    yield dict(conv=conv, block=block, nth=nth, row=rows[k] if own else None, edit=edit, times=times if own else 1, new_role=WANTED[state] if edit in "IR" else None)
                    state = NEXT[state] if edit in "IR" else KEPT[state, code & 3] if edit == "K" else state
                    nth += 1
            for _ in range(inserts):
                yield dict(conv=conv, block=block, nth=nth, row=None, edit="I", times=1, new_role=WANTED[state])
                state, nth = NEXT[state], nth + 1
    return _batches(made(), _EDIT, 2000)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits and figures of conversations, given as ``turns_of`` or ``damage`` return them.

    Edits, in order of (conv, block, nth): the edit's letter, how often it stands there (copies of a row are deleted
    together), and the role and text of the row it leaves (of a deleted one: as it was). Figures, a row per conversation:
    gaps, blank, duplicate, truncated, illegal, cost. ``conv`` is the conversation's name.
    """
    folder = scratch_path(turns.sparkSession, "repair")
    named = turns.groupBy(_key(F.col("conv_id")).alias("conv"), "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    said = F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"))
    rows = written(named.withColumn("said", F.unhex(said)).withColumn(
        "row", F.unhex(F.md5(F.concat_ws(":", F.length("conv").cast("string"), "conv", F.coalesce(F.col("turn").cast("string"), F.lit("-")), F.hex("said")).cast("binary")))), f"{folder}/rows")
    order = ["conv", F.asc_nulls_first("turn"), "role", "row"]
    sorted_rows = _coded(rows, folder).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = written(arrow_map(sorted_rows.select("conv", "turn", "row", "code", "copies", "blank", "later"), _blocks, _BLOCK_SQL), f"{folder}/blocks")
    summaries = blocks.select(*_SUMMARY).repartition("conv").sortWithinPartitions("conv", "block")
    borders = written(arrow_map(summaries, _borders, _BORDER_SQL), f"{folder}/borders")
    joined = blocks.select("conv", "block", "codes", "copies", "rows").join(borders.select("conv", "block", "start", "end", "inserts"), ["conv", "block"])
    edits = written(arrow_map(joined.select("conv", "block", "codes", "copies", "rows", "start", "end", "inserts"), _edits, _EDIT_SQL), f"{folder}/edits")
    old = edits.where("row IS NOT NULL").join(rows.select("row", "role", "text"), "row")
    kept = old.select("conv", "block", "nth", "edit", "times", F.coalesce("new_role", "role").alias("role"), "text")
    new = edits.where("row IS NULL").select("conv", "block", "nth", "edit", "times", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return kept.unionByName(new), borders.where("cost IS NOT NULL").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")


_DIGEST = pa.schema([("conv", pa.string()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def hashed():
        for conv, edits in groupby(_rows(batches), key=lambda r: r[0]):
            audit, sha, first = bytearray(), hashlib.sha256(), True
            for _, edit, times, role, text in edits:
                audit += edit.encode() * times
                if edit != "D":
                    sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            yield dict(conv=conv, audit=audit.decode(), repaired_sha256=sha.hexdigest())
    return _batches(hashed(), _DIGEST)


def digests(edits: DataFrame) -> DataFrame:
    """Per conversation the audit and the hash of what is left of it, one ``role:text`` a line."""
    ordered = edits.repartition("conv").sortWithinPartitions("conv", "block", "nth")
    return arrow_map(ordered.select("conv", "edit", "times", "role", "text"), _digests, "conv string, audit string, repaired_sha256 string")


def report(turns: DataFrame, everyone: DataFrame) -> DataFrame:
    """Figures, audit and hash for every ``conv_id`` of ``everyone``, with zeros where ``turns`` has no row of it."""
    edits, figures = repair(turns)
    ids = everyone.groupBy(_key(F.col("conv_id")).alias("conv")).agg(F.min("conv_id").alias("conv_id"))
    joined = ids.join(figures, "conv", "left").join(digests(edits), "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256().hexdigest()
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
