"""SentencePiece encoding and decoding by a streaming Viterbi pass (see ``piece_model``), in Arrow functions.

Texts stay where they are: no shuffle, one pass.  The model file is read once on
the driver and travels as a broadcast (its size is that of the file).  A worker
keeps bounded caches of words already encoded; slices of bounded bytes bound the
memory of a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_rows import list_column, slices
from .common import col_of
from .piece_model import PieceModel, StreamingCoder

SLICE_BYTES = 4 << 20
_WORKER: dict[tuple, object] = {}


def _once(kind, data: bytes):
    """One coder or model per worker process and model file."""
    key = kind, hash(data)
    if key not in _WORKER:
        _WORKER[key] = kind(data)
    return _WORKER[key]


def _new_coder(data: bytes) -> StreamingCoder:
    return StreamingCoder(PieceModel(data))


def _model_bytes(model_path: str) -> bytes:
    with open(model_path, "rb") as f:
        return f.read()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(col_of(docs, id_col).alias("id"), col_of(docs, text_col).alias("text"))


def _encoded(coder: StreamingCoder, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts behind each other, and how many each has."""
    out = [coder.encode(t or "") for t in texts]
    return np.frombuffer(b"".join(out), dtype=np.int32), np.fromiter(map(len, out), dtype=np.int64, count=len(out)) // 4


def _decoded(model: PieceModel, flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The bytes of each list of ids, without the blank that encoding puts first."""
    joined, ends = model.decode(flat.astype(np.int64))
    raw, out, start = joined.tobytes(), [], 0
    for last in np.cumsum(counts).tolist():
        end = int(ends[last - 1]) if last else 0
        drop = model.dummy_prefix and end > start and raw[start] == 32
        out.append(raw[start + drop:end])
        start = end
    return out


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text, ids (array of int).

    The ids are those of the SentencePiece library for the model, without begin
    or end ids.  Null or empty text: no ids.  Repeated rows and null ids are
    encoded like any row; other input columns are ignored.
    """
    data = docs.sparkSession.sparkContext.broadcast(_model_bytes(model_path))
    rows = _rows(docs, id_col, text_col)

    def run(batches):
        coder = _once(_new_coder, data.value)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                flat, counts = _encoded(coder, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, list_column(flat, counts)], ["id", "text", "ids"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, text string, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """The rows with ``decoded``: the text of their ids.

    Pieces are joined, the mark of white space becomes a blank, and the blank
    that encoding puts first is taken away.  Bytes that are no UTF-8 become the
    replacement character.  Null or no ids: empty text.
    """
    data = encoded.sparkSession.sparkContext.broadcast(_model_bytes(model_path))

    def run(batches):
        model = _once(PieceModel, data.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            counts = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
            flat, texts, at, lo = np.asarray(lists.flatten(), dtype=np.int32), [], 0, 0
            while lo < len(counts):
                hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(counts[lo:]), SLICE_BYTES // 4, "right")))
                n = int(counts[lo:hi].sum())
                texts += [t.decode("utf-8", "replace") for t in _decoded(model, flat[at:at + n], counts[lo:hi])]
                at, lo = at + n, hi
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    spec = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(run, f"{spec}, decoded string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoded and decoded again in one pass: id, n_chars, n_tokens, ids, same (the decoded bytes are the text's, a null one being empty)."""
    data = docs.sparkSession.sparkContext.broadcast(_model_bytes(model_path))
    rows = _rows(docs, id_col, text_col)

    def run(batches):
        coder = _once(_new_coder, data.value)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                texts = [t or "" for t in part.column("text").to_pylist()]
                flat, counts = _encoded(coder, texts)
                same = [t.encode() == d for t, d in zip(texts, _decoded(coder.m, flat, counts))]
                n_chars = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n_chars), pa.array(counts), list_column(flat, counts), pa.array(same)],
                                                 ["id", "n_chars", "n_tokens", "ids", "same"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_chars long, n_tokens long, ids array<int>, same boolean")
