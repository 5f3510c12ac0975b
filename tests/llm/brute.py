"""Plain versions of the operators, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingle_set(text, width=5):
    w = WORD.findall((text or "").translate(LOW))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1)))


def near_duplicates(rows, percent=80):
    """{id: (set size, component)} for rows of (id, text) with distinct ids."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    pairs = {(a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1:]}
    for a, b in pairs:
        x, y = sets[a], sets[b]
        common = len(x & y)
        if 100 * common >= percent * (len(x) + len(y) - common):
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    return {i: (len(s), root(i)) for i, s in sets.items()}


def repeated_bytes(rows, width=50):
    """{id: (bytes, removed, runs, hash of the rest)}: bytes covered by a string that also starts in a smaller id's text."""
    first = {}
    raw = {i: (t or "").encode() for i, t in rows}
    for i in sorted(raw):
        b = raw[i]
        for p in range(len(b) - width + 1):
            first.setdefault(b[p:p + width], i)
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p:p + width]] < i:
                gone[p:p + width] = b"\x01" * width
        rest = bytes(c for c, g in zip(b, gone) if not g)
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(rest).hexdigest())
    return out


def base_counts(text):
    """The fixed counts of the quality query for one text."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "base_failed": len(w) < 50 or 100 * len(covered) > 50 * len(w)}


def dedup_lines(rows, min_chars=10):
    """[(id, lines, dropped, text)] for rows of (id, text); a null id takes no part."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = {}
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < min_chars or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def overlaps(docs, items):
    """{(id, item): (matched, window)} for rows of (id, text)."""
    split = lambda t: re.split(r"[\W_]+", (t or "").lower())
    out = {}
    for i, t in docs:
        words = split(t)
        for k, it in items:
            item = [w for w in split(it) if w]
            if i is None or k is None or len(item) < 9:
                continue
            n = min(13, len(item))
            allowed = 2 if n == 13 else n // 6
            best = max((sum(a == b for a, b in zip(item[s:s + n], words[p:p + n]))
                        for s in range(len(item) - n + 1) for p in range(len(words) - n + 1)), default=0)
            if best >= n - allowed:
                out[i, k] = (best, n)
    return out


SECRETS = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 12),
           ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile(r"[0-9a-f]+"), 0, 16)]


def base_spans(text):
    """[(start, order, end, kind)] of the fixed patterns."""
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, g, least) in enumerate(SECRETS) for m in p.finditer(text or "") if len(m[g]) >= least]
    return sorted(found)
