"""Suffix-array dedup: bytes of long strings that an earlier document holds already.

Bucket-pointer refinement over a sparse set of suffixes, in Spark joins and groups:

1. Each string of ``WIDTH`` bytes is pointed to by its smallest q-gram hash.
   Neighbouring strings with one pointer form a run, so there are few runs per text.
   The pointers are the initial buckets; buckets within one document are finished.
2. The runs of unfinished buckets are refined by the string that they span from
   their first to their last offset.  Of each refined bucket the smallest
   document stays, the runs of all others repeat it as a whole.
3. Buckets of which several refinements are left are refined again, now by the
   single strings at all later offsets of a run.  Strings of a bucket with a smaller
   document are repeats.
4. What is covered is cut out of the texts.

Each refinement reads the result of the one before as its candidates, so most
suffixes are finished after step 1 and never move again.  Records travel as
packed arrays, dealt by bucket; a task sends one record per bucket and document
set (the smallest document; the others it knows to be repeats), so a string that a
third of all documents hold is one record per task.  Groups of texts are dealt by
document id, a few MB each.  Every hash is of the bytes themselves; a bucket is told
apart by 64 bits, a refinement by 128.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_rows import list_column, slices
from .common import col_of, discard, stored
from .shingles import mixed, powers

WIDTH = 50
GRAM = 24
PIECE_BYTES = 512 << 10
SEND_BYTES = 8 << 20
GROUP_BYTES = 2 << 20
_VALUE = np.random.default_rng(0xB17E5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PACKED = "kind int, bucket int, data binary"
CUT = "id long, n_bytes long, n_removed long, n_spans long, starts array<long>, ends array<long>, kept binary"
DONE, OPEN = 1, 0  # kinds of records: decided, or to be compared within their bucket


def prime_from(n: int) -> int:
    """The smallest prime from n on: ids at any regular distance spread over so many groups."""
    n = max(n, 2)
    while any(n % k == 0 for k in range(2, int(n ** 0.5) + 1)):
        n += 1
    return n


def pack(*columns: np.ndarray) -> bytes:
    """64-bit columns, byte plane by byte plane: the equal high bytes of ids and offsets lie together and compress."""
    return b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)


def unpack(blobs: list[bytes], n: int) -> list[np.ndarray]:
    """The ``n`` columns of many packed records, joined."""
    planes = [np.frombuffer(b, dtype=np.uint8).reshape(n, 8, -1) for b in blobs]
    joined = np.concatenate(planes, axis=2) if planes else np.zeros((n, 8, 0), np.uint8)
    return [np.ascontiguousarray(c.T).view(np.uint64).ravel() for c in joined]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours: smallest so far from the left and from the right of blocks of w."""
    n = len(x)
    padded = np.concatenate([x, np.full(-n % w + w, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - w + 1], left[w - 1:n])


class Block:
    """Pieces of texts side by side, with hashes of any of their strings."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.n = len(raw)
        up, self.down = powers(self.n + 1)
        self.total = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(_VALUE[raw] * up[:-1], out=self.total[1:])

    def hashes(self, lo, hi) -> np.ndarray:
        return mixed((self.total[hi] - self.total[lo]) * self.down[lo])

    def runs(self):
        """First offset, number of strings and pointer of each run."""
        if self.n < WIDTH:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        grams = mixed((self.total[GRAM:] - self.total[:-GRAM]) * self.down[:self.n - GRAM + 1])
        least = sliding_min(grams, WIDTH - GRAM + 1)
        long = self.sizes >= WIDTH
        mark = np.zeros(self.n + 1, dtype=np.int8)
        mark[self.starts[long]] += 1
        mark[(self.starts + self.sizes)[long] - WIDTH + 1] -= 1
        inside = np.cumsum(mark[:len(least)], dtype=np.int8) > 0
        differ = least[1:] != least[:-1]
        lo = np.flatnonzero(inside & np.concatenate([[True], differ | ~inside[:-1]]))
        hi = np.flatnonzero(inside & np.concatenate([differ | ~inside[1:], [True]]))
        return lo, hi - lo + 1, least[lo]


def _pieces(text: bytes):
    """(offset, bytes): parts of a text, each string of WIDTH bytes in exactly one."""
    for at in range(0, max(1, len(text) - WIDTH + 1), PIECE_BYTES):
        yield at, text[at:at + PIECE_BYTES + WIDTH - 1]


def _blocks(texts):
    """Blocks of bounded size over (document, base offset, bytes); with each, its pieces' documents and offsets."""
    docs, offsets, pieces, size = [], [], [], 0
    for doc, base, text in texts:
        for at, piece in _pieces(text):
            if pieces and size + len(piece) > PIECE_BYTES + WIDTH:
                yield Block(pieces), np.array(docs, np.int64), np.array(offsets, np.int64)
                docs, offsets, pieces, size = [], [], [], 0
            docs.append(doc)
            offsets.append(base + at)
            pieces.append(piece)
            size += len(piece)
    if pieces:
        yield Block(pieces), np.array(docs, np.int64), np.array(offsets, np.int64)


def _dealt(kind: int, to: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Records grouped by the bucket that each goes to."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(to) else np.zeros(1, np.int64)
    columns = [c[order] for c in columns]
    return [(kind, int(to[a]), pack(*[c[a:b] for c in columns])) for a, b in zip(cuts[:-1], cuts[1:])]


def _table(records) -> pa.Table:
    kinds, buckets, data = zip(*records) if records else ((), (), ())
    return pa.table({"kind": pa.array(kinds, pa.int32()), "bucket": pa.array(buckets, pa.int32()), "data": pa.array(data, pa.binary())})


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys together (the last key decides within), and the number of each row's group by all but the last."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for k in keys[:-1]:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def _first(group: np.ndarray) -> np.ndarray:
    """Of sorted rows, where each row's group begins."""
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    return begins[group - group[0]] if len(group) else begins


def _pointers(rows: DataFrame, n: int) -> DataFrame:
    """Step 1, in tasks: one record per pointer, with the smallest and the largest document that the task saw it in."""
    def send(h, d):
        order, group = _groups(h, d)
        h, d = h[order], d[order]
        at = _first(group)
        last = np.flatnonzero(np.concatenate([group[1:] != group[:-1], [True]])) if len(group) else at
        head = np.flatnonzero(at == np.arange(len(at)))
        yield from _dealt(OPEN, h[head] % np.uint64(n), h[head], d[head], d[last])
        other = (d != d[at]) & np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
        yield from _dealt(DONE, d[other] % n, d[other], h[other])

    def run(batches):
        hs, ds, size = [], [], 0
        for part in (p for batch in batches for p in slices(batch, "text", PIECE_BYTES)):
            texts = ((i.as_py(), 0, t) for i, t in zip(part.column("id"), (v.as_py() for v in part.column("text"))) if t)
            for block, docs, _ in _blocks(texts):
                lo, _, h = block.runs()
                hs.append(h)
                ds.append(docs[np.searchsorted(block.starts, lo, "right") - 1])
                size += block.n
                if size >= SEND_BYTES:
                    yield from sent(hs, ds)
                    hs, ds, size = [], [], 0
        if hs:
            yield from sent(hs, ds)

    def sent(hs, ds):
        return _table(list(send(np.concatenate(hs), np.concatenate(ds)))).to_batches()

    return rows.mapInArrow(run, PACKED)


def _in_two_documents(n: int):
    """Step 1, by bucket: (document, pointer) of pointers that more than one document has, dealt by document."""
    def run(table: pa.Table) -> pa.Table:
        if table["kind"][0].as_py() == DONE:
            return table
        h, lo, hi = unpack(table["data"].to_pylist(), 3)
        lo, hi = lo.view(np.int64), hi.view(np.int64)
        order, group = _groups(h, lo)
        h, lo, hi = h[order], lo[order], hi[order]
        if not len(h):
            return _table([])
        begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        shared = (np.maximum.reduceat(hi, begins) != lo[begins])[group]
        return _table(_dealt(DONE, lo[shared] % n, lo[shared], h[shared]))

    return run


def _grouped_texts(rows: DataFrame, n: int) -> DataFrame:
    """bucket, data: the rows of each bucket of documents as compressed Arrow streams, which move in half the bytes of single rows."""
    def run(batches):
        for batch in (p for whole in batches for p in slices(whole, "text", SEND_BYTES)):
            to = np.asarray(batch.column("id")) % n
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order], prepend=-1, append=-1))
            buckets, data = [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch.take(pa.array(order[a:b])))
                buckets.append(int(to[order[a]]))
                data.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])

    return rows.mapInArrow(run, "bucket int, data binary")


def _rows_of(left: pa.Table) -> tuple[list, list]:
    """Ids and texts of a group of documents."""
    parts = [pa.ipc.open_stream(b).read_all() for b in left["data"].to_pylist()]
    return [i for p in parts for i in p["id"].to_pylist()], [t for p in parts for t in p["text"].to_pylist()]


def _texts_of(ids: list, texts: list):
    """(id, base offset, bytes) of a group of documents; different texts of one id follow each other in a fixed order."""
    found = sorted({(i, t) for i, t in zip(ids, texts) if t})
    base = 0
    for k, (i, t) in enumerate(found):
        base = base if k and found[k - 1][0] == i else 0
        yield i, base, t
        base += len(t)


def _send_refined(h, key, doc, pos, length, n: int) -> pa.Table:
    """Records of (pointer, key): those of the group's smallest document are compared further, the others repeat it."""
    order, group = _groups(h, key, doc.view(np.uint64))
    h, key, doc, pos, length = (c[order] for c in (h, key, doc, pos, length))
    least = doc == doc[_first(group)]
    more = ~least
    return _table(_dealt(OPEN, (h[least] ^ key[least]) % np.uint64(n), h[least], key[least], doc[least], pos[least], length[least])
                  + _dealt(DONE, doc[more] % n, doc[more], pos[more], length[more]))


def _refined(n: int):
    """By bucket of (pointer, key): runs of other than the smallest document are repeats; the smallest's stay open."""
    def run(table: pa.Table) -> pa.Table:
        if table["kind"][0].as_py() == DONE:
            return table
        h, key, doc, pos, length = unpack(table["data"].to_pylist(), 5)
        doc, pos, length = (c.view(np.int64) for c in (doc, pos, length))
        order, group = _groups(h, key, doc.view(np.uint64))
        h, key, doc, pos, length = (c[order] for c in (h, key, doc, pos, length))
        least = doc == doc[_first(group)]
        more = ~least
        bucket = np.full(int(least.sum()), table["bucket"][0].as_py())
        return _table(_dealt(DONE, doc[more] % n, doc[more], pos[more], length[more])
                      + _dealt(OPEN, bucket, h[least], key[least], doc[least], pos[least], length[least]))

    return run


def _whole_runs(n: int):
    """Step 2: the string that each candidate run spans."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, h = unpack(right["data"].to_pylist(), 2)
        wanted = np.unique(mixed(h ^ mixed(doc)))
        found = [[np.zeros(0, t)] for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]
        for block, docs, offsets in _blocks(_texts_of(*_rows_of(left))):
            lo, length, h = block.runs()
            piece = np.searchsorted(block.starts, lo, "right") - 1
            doc = docs[piece]
            k = np.isin(mixed(h ^ mixed(doc.view(np.uint64))), wanted)
            lo, length, h, piece, doc = lo[k], length[k], h[k], piece[k], doc[k]
            for out, c in zip(found, (h, block.hashes(lo, lo + length + WIDTH - 1), doc, lo - block.starts[piece] + offsets[piece], length)):
                out.append(c)
        return _send_refined(*map(np.concatenate, found), n)

    return run


def _single_strings(n: int):
    """Step 3: the strings at all offsets of each open run."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        h, doc, pos, length = (np.asarray(right[c]) for c in ("h", "doc", "pos", "length"))
        order = np.lexsort((pos, doc))
        h, doc, pos, length = h[order].view(np.uint64), doc[order], pos[order], length[order]
        found = [[np.zeros(0, t)] for t in (np.uint64, np.uint64, np.int64, np.int64)]
        for block, docs, offsets in _blocks(_texts_of(*_rows_of(left))):
            # Pieces are in the order of documents and offsets, and so are runs.
            first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
            ends = np.append(first[1:], len(docs))
            for a, b in zip(first.tolist(), ends.tolist()):
                lo, hi = np.searchsorted(doc, docs[a]), np.searchsorted(doc, docs[a], "right")
                if lo == hi:
                    continue
                piece = a + np.searchsorted(offsets[a:b], pos[lo:hi], "right") - 1
                at = pos[lo:hi] - offsets[np.maximum(piece, a)] + block.starts[np.maximum(piece, a)]
                held = (piece >= a) & (at + length[lo:hi] + WIDTH - 1 <= block.starts[np.maximum(piece, a)] + block.sizes[np.maximum(piece, a)])
                sizes = length[lo:hi][held]
                step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                at = np.repeat(at[held], sizes) + step
                for out, c in zip(found, (np.repeat(h[lo:hi][held], sizes), block.hashes(at, at + WIDTH), np.full(len(at), docs[a]),
                                          np.repeat(pos[lo:hi][held], sizes) + step)):
                    out.append(c)
        h, key, doc, pos = map(np.concatenate, found)
        return _send_refined(h, key, doc, pos, np.ones(len(pos), np.int64), n)

    return run


def _cut(left: pa.Table, right: pa.Table) -> pa.Table:
    """Step 4: every row of a group of documents without its repeats."""
    doc, pos, length = (c.view(np.int64) for c in unpack(right["data"].to_pylist(), 3))
    order = np.argsort(doc, kind="stable")
    doc, pos, length = doc[order], pos[order], length[order]
    ids, texts = _rows_of(left)
    base = {(i, t): b for i, b, t in _texts_of(ids, texts)}
    sizes, removed, kept, starts, ends = [], [], [], [], []
    for i, t in zip(ids, texts):
        t, edges = t or b"", np.zeros(0, np.int64)
        rest = t
        if (i, t) in base:
            a, b = np.searchsorted(doc, i), np.searchsorted(doc, i, "right")
            lo = pos[a:b] - base[i, t]
            k = (lo >= 0) & (lo < len(t))
            lo, hi = lo[k], lo[k] + length[a:b][k] + WIDTH - 1
            if len(lo):
                change = np.bincount(lo, minlength=len(t) + 1) - np.bincount(hi, minlength=len(t) + 1)
                gone = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                rest = np.frombuffer(t, np.uint8)[~gone].tobytes()
        sizes.append(len(t))
        removed.append(len(t) - len(rest))
        kept.append(rest)
        starts.append(edges[::2])
        ends.append(edges[1::2])
    counts = np.array([len(s) for s in starts], dtype=np.int64)
    flat = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
    return pa.table({"id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                     "n_spans": pa.array(counts), "starts": list_column(flat(starts), counts), "ends": list_column(flat(ends), counts),
                     "kept": pa.array(kept, pa.binary())})


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, starts and ends (of the removed runs), kept (the bytes left).

    A byte is removed if a string of ``WIDTH`` bytes that covers it also starts in a
    document of a smaller id; strings never cross texts and are judged on the
    input.  Null or empty text: no bytes.  Repeated rows and rows of one id are
    never smaller than each other; each keeps what its own text is left with.  A null
    id takes no part and keeps its text: such rows are never dealt out.  Other input columns are ignored.  Empty
    table: no rows.
    """
    every = docs.select(col_of(docs, id_col).cast("long").alias("id"), col_of(docs, text_col).cast("binary").alias("text"))
    rows = every.where("id IS NOT NULL")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = prime_from(total // GROUP_BYTES + 1)
    dealt = _grouped_texts(rows, n)

    def grouped(packed: DataFrame, step) -> DataFrame:
        return packed.groupBy("kind", "bucket").applyInArrow(step, PACKED)

    def with_texts(others: DataFrame, step, schema: str) -> DataFrame:
        return dealt.groupBy("bucket").cogroup(others.groupBy("bucket")).applyInArrow(step, schema)

    candidates = stored(grouped(_pointers(rows, n), _in_two_documents(n)), "pointers")
    runs = stored(grouped(with_texts(candidates, _whole_runs(n), PACKED), _refined(n)), "runs")
    discard(candidates)

    def rows_of(batches):
        for batch in batches:
            columns = unpack(batch.column("data").to_pylist(), 5)
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], ["h", "key", "doc", "pos", "length"])

    open_runs = runs.where(F.col("kind") == OPEN).mapInArrow(rows_of, "h long, key long, doc long, pos long, length long")
    several = open_runs.groupBy("h").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("h")
    open_runs = stored(open_runs.join(several, "h").select(F.pmod("doc", F.lit(n)).cast("int").alias("bucket"), "h", "doc", "pos", "length"), "open")
    strings = stored(grouped(with_texts(open_runs, _single_strings(n), PACKED), _refined(n)).where(F.col("kind") == DONE), "strings")
    discard(open_runs)
    repeats = runs.where(F.col("kind") == DONE).unionByName(strings)
    cut = with_texts(repeats, _cut, CUT)
    whole, none, no_runs = F.coalesce("text", F.lit(b"")), F.lit(0).cast("long"), F.array().cast("array<long>")
    alone = every.where("id IS NULL").select("id", F.length(whole).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"),
                                             no_runs.alias("starts"), no_runs.alias("ends"), whole.alias("kept"))
    return cut.unionByName(alone)
