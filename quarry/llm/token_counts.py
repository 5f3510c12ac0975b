"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at white space, which the tokenizer drops, so the pieces' counts
add up to the text's count however long it is.  Pieces that a worker has not
counted yet are encoded in batches of bounded bytes; counts of known pieces come
from a bounded table.  No shuffle.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_rows import slices
from .common import col_of

SLICE_BYTES = 4 << 20
BATCH_BYTES = 64 << 10
TABLE_SIZE = 700_000
_COUNTERS: dict[int, "Counter"] = {}


def cuts_at_white_space(spec: dict) -> bool:
    """Whether a tokenizer's tokens never touch white space, so that a text may be cut there.

    True for: no prefix put before texts, a splitting pattern of which only the matches
    stay and whose last alternative excludes white space, and added tokens that hold none and
    strip none.
    """
    def steps(part, many):
        return [] if not part else part[many] if part.get("type") == "Sequence" else [part]

    split = [p for p in steps(spec.get("pre_tokenizer"), "pretokenizers") if p["type"] == "Split"]
    keeps = any(p["behavior"] == "Removed" and p.get("invert") and r"[^\s" in p["pattern"].get("Regex", "") for p in split[:1])
    local = all(n["type"] in ("NFC", "Lowercase", "Replace") for n in steps(spec.get("normalizer"), "normalizers"))
    bare = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
    return keeps and local and bare and not any(p.get("add_prefix_space") for p in steps(spec.get("pre_tokenizer"), "pretokenizers"))


class Counter:
    """Counts of tokens of UTF-8 texts under one tokenizer."""

    def __init__(self, data: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(data)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cut = cuts_at_white_space(json.loads(data))
        self.known: dict[bytes, int] = {}

    def _encode(self, pieces: list[bytes]) -> None:
        """Counts of new pieces, encoded in batches of at most ``BATCH_BYTES`` (a longer piece alone)."""
        lo = size = 0
        for k, piece in enumerate([*pieces, None]):
            if piece is None or k > lo and size + len(piece) > BATCH_BYTES:
                batch = [p.decode() for p in pieces[lo:k]]
                found = self.tokenizer.encode_batch_fast(batch, add_special_tokens=False) if batch else []
                self.known.update(zip(pieces[lo:k], map(len, found)))
                lo, size = k, 0
            size += len(piece or b"")

    def counts(self, texts: list[bytes]) -> list[int]:
        split = [t.split() if self.cut else [t] for t in texts]
        if len(self.known) > TABLE_SIZE:
            self.known.clear()
        self._encode(sorted({p for pieces in split for p in pieces}.difference(self.known), key=len))
        get = self.known.__getitem__
        return [sum(map(get, pieces)) for pieces in split]


def _counter(data: str) -> Counter:
    key = hash(data)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(data)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, as the tokenizers library counts them for the whole text.

    No begin, end or added special tokens, no truncation or padding; special
    strings inside texts are handled as the library does by default.  Null or
    empty text: 0 and 0.  Repeated rows and null ids are counted like any row;
    other input columns are ignored.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(col_of(docs, id_col).alias("id"), col_of(docs, text_col).cast("binary").alias("text"))

    def run(batches):
        counter = _counter(data.value)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                texts = [t or b"" for t in part.column("text").to_pylist()]
                n_bytes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n_bytes), pa.array(counter.counts(texts), pa.int64())],
                                                 ["id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_bytes long, n_tokens long")
