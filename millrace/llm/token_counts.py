"""Token counts without token ids.

Texts are cut at white space, where no token can span, so that a text of any
length is encoded in short pieces. Pieces not met before are packed into
strings of equal size in bytes and encoded as one batch by the public library;
only their lengths are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import PIECE, SPACE, arrow_map, by_bytes, doc_type, id_text, keep_smaller

PACK_BYTES = 4096
BATCH_PACKS = 64
MOST_CACHED = 600_000
LONGEST_CACHED = 48
_COUNTERS: dict[str, PieceCounter | WholeCounter] = {}  # one per worker process and vocabulary
_BLANK = frozenset("\t\n\x0b\x0c\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B))))


class PieceCounter:
    """Counts with a ``tokenizers`` file. Lengths of short pieces are remembered, up to a bound."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def _alone(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for part in by_bytes([len(p) for p in pieces], PACK_BYTES * BATCH_PACKS):
            out += map(len, self.tokenizer.encode_batch_fast(pieces[part], add_special_tokens=False))
        return out

    def _packed(self, pieces: list[str]) -> Iterator[int]:
        """Pieces that begin with white space and end without stay apart when they are joined."""
        packs = list(by_bytes([len(p) for p in pieces], PACK_BYTES))
        for k in range(0, len(packs), BATCH_PACKS):
            some = packs[k : k + BATCH_PACKS]
            for part, got in zip(some, self.tokenizer.encode_batch(["".join(pieces[p]) for p in some], add_special_tokens=False), strict=True):
                ends = np.cumsum([len(p) for p in pieces[part]])
                starts = np.fromiter((a for a, _ in got.offsets), np.int64, len(got))
                yield from np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(ends)).tolist()

    def measure(self, pieces: set[str]) -> dict[str, int]:
        inner = [p for p in pieces if p[0] in _BLANK and p[-1] not in _BLANK]
        edge = [p for p in pieces if not (p[0] in _BLANK and p[-1] not in _BLANK)]
        out = dict(zip(edge, self._alone(edge), strict=True))
        out.update(zip(inner, self._packed(inner), strict=True))
        return out

    def count(self, texts: list[str]) -> list[int]:
        keep_smaller(self.known, MOST_CACHED)
        pieces = [PIECE.findall(t) for t in texts]
        counts = [list(map(self.known.get, p)) for p in pieces]
        open_rows = [k for k, c in enumerate(counts) if None in c]
        fresh = self.measure({p for k in open_rows for p, c in zip(pieces[k], counts[k], strict=True) if c is None})
        for k in open_rows:
            counts[k] = [fresh[p] if c is None else c for p, c in zip(pieces[k], counts[k], strict=True)]
        self.known.update((p, n) for p, n in fresh.items() if len(p) <= LONGEST_CACHED)
        return [sum(c) for c in counts]


class WholeCounter:
    """Counts with a ``sentencepiece`` file, whose normaliser looks over white space: texts stay whole."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for part in by_bytes([len(t) for t in texts], PACK_BYTES * BATCH_PACKS):
            out += map(len, self.model.encode(texts[part], num_threads=1))
        return out


def counter(path: str) -> PieceCounter | WholeCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = (WholeCounter if path.endswith(".model") else PieceCounter)(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    ``path``: a ``.json`` file of the tokenizers library or a ``.model`` file
    of sentencepiece, readable on every executor. No special tokens are added;
    their strings inside a text count as the library reads them. A null or
    empty text has 0 bytes and 0 tokens; repeated rows are counted one by one;
    null keys stay; an empty table gives no rows; other columns are ignored.
    """
    source = id_text(docs, id_col, text_col)
    schema = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = pa.compute.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(tool.count(texts), pa.int64())],
                                             names=["doc_id", *schema.names])

    out = arrow_map(source, run, f"doc_id {doc_type(docs, id_col)}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


__all__ = ["SPACE", "token_counts"]
