"""A SentencePiece model file as plain values, and the streaming Viterbi coder over its pieces.

The model files at hand are of the BPE kind: a text's ids are those that merging
the best-ranked neighbours gives, which the path of greatest summed score is
not.  A path here is therefore a sequence of pieces in which every two
neighbours survive merging, i.e. merging their joined text gives these two
pieces back; a text has exactly one such path, and every prefix has one too.  The
coder keeps, for each end inside a window of the longest piece's length, the
backpointer of the one surviving path, and commits ids as soon as the paths of
all ends in the window run through one boundary.
"""

from __future__ import annotations

import re
import struct
from array import array

import numpy as np

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)  # piece kinds of the file format
NEVER = 1 << 60


def _fields(data: bytes):
    """(number, value) of one protocol buffer message; length-delimited values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at:at + size]
            at += size


class PieceModel:
    """Pieces, ranks and flags of a BPE model file without a character map."""

    def __init__(self, data: bytes):
        pieces, kind, self.dummy_prefix, squeeze, char_map, bpe = [], {}, True, True, b"", False
        for n, v in _fields(data):
            if n == 1:
                f = dict(_fields(v))
                pieces.append((f[1].decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
            elif n == 2:
                bpe = dict(_fields(v)).get(3, 1) == 2
            elif n == 3:
                f = dict(_fields(v))
                self.dummy_prefix, squeeze, char_map = bool(f.get(3, 1)), bool(f.get(4, 1)), f.get(2, b"")
        if not bpe or squeeze or char_map:
            raise ValueError("only BPE models without character map and white space removal are read")
        self.pieces = [p for p, _, _ in pieces]
        self.kinds = [k for _, _, k in pieces]
        order = sorted((i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)), key=lambda i: -pieces[i][1])
        self.rank = {self.pieces[i]: r for r, i in enumerate(order)}
        self.id_of = {self.pieces[i]: i for i in order}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.longest = max(map(len, self.id_of))
        as_bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN
                    else p.replace(SPACE, " ").encode() for p, _, k in pieces]
        self.piece_size = np.array([len(b) for b in as_bytes], dtype=np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(as_bytes), dtype=np.uint8)

    def char_ids(self, char: str) -> list[int]:
        """Ids of a character that is no piece: its bytes, or the unknown id."""
        return [self.byte_id[b] for b in char.encode("utf-8", "surrogatepass")] if len(self.byte_id) == 256 else [self.unknown]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the joined pieces, and the end of each piece in them (the dummy prefix's blank included)."""
        size = self.piece_size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.piece_start[ids] - (ends - size), size) + np.arange(ends[-1] if len(ids) else 0)
        return self.piece_bytes[at], ends


class StreamingCoder:
    """Ids of texts under a ``PieceModel``; memory is bounded by the window and the two bounded caches."""

    def __init__(self, model: PieceModel, cache_size: int = 300_000):
        self.m, self.cache_size = model, cache_size
        self.words: dict[str, bytes] = {}     # what stands between two blanks
        self.cache: dict[str, bytes] = {}     # segments
        self.pairs: dict[str | None, dict[str, bool]] = {}
        self.n_pairs = 0
        self.spines: dict[str, tuple] = {}
        self.trie: dict = {}  # pieces by their characters; at "" the piece itself
        for p in [*model.id_of, *{c for p in model.id_of for c in p}]:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        # Between two characters that no piece holds side by side, every path has a boundary: texts are cut there.
        inner = {b for p in model.id_of for b in zip(p, p[1:])}
        joined = {c for pair in inner for c in pair}
        self.opener = SPACE if all(a == SPACE for a, b in inner if b == SPACE) else ""
        joined.discard(self.opener)
        letters = {c for c in joined if c.isalpha()} if not any(a.isalpha() and not b.isalpha() for a, b in inner) else set()
        of = lambda chars: "[" + re.escape("".join(sorted(chars))) + "]" if chars else "(?!)"
        run, rest = f"{self.opener}*" if self.opener else "", of(joined - letters)
        forms = [f"{run}{rest}*{of(letters)}+"] * bool(letters) + [f"{run}{rest}+"] + [f"{self.opener}+"] * bool(self.opener) + ["."]
        self.segment = re.compile("|".join(forms), re.S)

    def encode(self, text: str) -> bytes:
        """Ids as packed 32-bit integers."""
        if not text:
            return b""
        if not (self.opener and self.m.dummy_prefix) or "  " in text or text[0] == " " or SPACE in text:
            return self._encode((SPACE if self.m.dummy_prefix else "") + text.replace(" ", SPACE))
        # Each blank opens a new segment, as does the beginning.
        words, parts = self.words, text.split(" ")
        out = list(map(words.get, parts))
        if None in out:
            if len(words) > self.cache_size:
                words.clear()
            for k, ids in enumerate(out):
                if ids is None:
                    w = parts[k]
                    out[k] = ids = self._encode(SPACE + w)
                    if len(w) <= 32:
                        words[w] = ids
        return b"".join(out)

    def _encode(self, marked: str) -> bytes:
        cache, out = self.cache, []
        for s in self.segment.findall(marked):
            ids = cache.get(s)
            if ids is None:
                ids = array("i", [i for piece in self.path(s) for i in self._ids(piece)]).tobytes()
                if len(cache) > self.cache_size:
                    cache.clear()
                if len(s) <= 32:
                    cache[s] = ids
            out.append(ids)
        return b"".join(out)

    def _ids(self, piece: str) -> list[int]:
        i = self.m.id_of.get(piece)
        return self.m.char_ids(piece) if i is None else [i]

    def path(self, text: str) -> list[str]:
        """Pieces of a text: one pass from left to right, with backpointers for a window of ends only."""
        longest, trie, n = self.m.longest, self.trie, len(text)
        done: list[str] = []
        base = 0                         # everything before it is committed
        last: list = [None] * (n + 1 if n <= 8 * longest else 9 * longest + 2)  # last piece of the surviving path to each end
        for i in range(n):
            before = last[i - base]
            known = self.pairs.get(before)
            if known is None:
                known = self._room(before)
            node, j = trie, i
            while j < n:
                node = node.get(text[j])
                if node is None:
                    break
                j += 1
                piece = node.get("")
                if piece is not None and last[j - base] is None:
                    fit = known.get(piece)
                    if fit is None:
                        fit = known[piece] = self._fits(before, piece)
                        self.n_pairs += 1
                    if fit:
                        last[j - base] = piece
            if j == i:                   # a character of no piece
                last[i + 1 - base] = text[i]
            if i + 1 - base >= 8 * longest:
                boundary = self._converged(last, i + 1 - base, longest)
                if boundary:
                    done += self._back(last, boundary)
                    base += boundary
                    last = last[boundary:]
                last += [None] * (max(i + 2 - base, 8 * longest + 2) + longest - len(last))
        return done + self._back(last, n - base)

    def _room(self, before: str | None) -> dict[str, bool]:
        """Where the neighbours of a piece are noted; all are forgotten when they are too many."""
        if self.n_pairs > self.cache_size:
            self.pairs, self.n_pairs = {}, 0
        return self.pairs.setdefault(before, {})

    @staticmethod
    def _converged(last: list, end: int, longest: int) -> int:
        """The last boundary that the paths of all ends in the window share; 0 if it is the committed one."""
        live = set(range(end - longest + 1, end + 1))
        while len(live) > 1:
            e = max(live)
            live.discard(e)
            live.add(e - len(last[e]) if e > 0 else 0)
        return max(live.pop(), 0)

    @staticmethod
    def _back(last: list, end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def _fits(self, a: str | None, b: str) -> bool:
        """Whether merging leaves ``a`` and ``b`` (or ``b`` alone) as they are."""
        right_of_b = self._spine(b)
        if right_of_b is None:
            return False
        if a is None:
            return True
        # The symbols at both sides of the joint grow as merging goes on; the joint is lost
        # if their union outranks what either side waits for.  Of equal ranks the left one goes first.
        (xs, wait_x), (ys, wait_y) = self._spine(a)[0], right_of_b[1]
        i = j = 0
        while True:
            union = self.m.rank.get(xs[i] + ys[j], NEVER)
            if union < wait_x[i] and union <= wait_y[j] and union < NEVER:
                return False
            if wait_x[i] == NEVER and wait_y[j] == NEVER:
                return True
            if wait_x[i] <= wait_y[j]:
                i += 1
            else:
                j += 1

    def _spine(self, piece: str):
        """The symbols at the right and at the left edge while the piece is merged, each with the worst rank to wait for before
        it grows; None if merging the piece's text does not give the piece."""
        if piece not in self.spines:
            symbols = list(piece)
            right, left = ([symbols[-1]], []), ([symbols[0]], [])
            worst_r = worst_l = -1
            while len(symbols) > 1:
                r, k = min((self.m.rank.get(symbols[k] + symbols[k + 1], NEVER), k) for k in range(len(symbols) - 1))
                if r == NEVER:
                    break
                worst_r, worst_l = max(worst_r, r), max(worst_l, r)
                symbols[k:k + 2] = [symbols[k] + symbols[k + 1]]
                if k == len(symbols) - 1:
                    right[0].append(symbols[-1])
                    right[1].append(worst_r)
                    worst_r = -1
                if k == 0:
                    left[0].append(symbols[0])
                    left[1].append(worst_l)
                    worst_l = -1
            right[1].append(NEVER)
            left[1].append(NEVER)
            self.spines[piece] = (right, left) if len(symbols) == 1 else None
        return self.spines[piece]
