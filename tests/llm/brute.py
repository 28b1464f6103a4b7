"""Plain versions of the contracts, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

SPACE = re.compile(r"[\x20\x09-\x0D]")


def word_tokenizer(name="word_bpe_49k.json"):
    return Tokenizer.from_file(public_tokenizers.path(name))


def u32(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


def op2(rows):
    tok, start, out = word_tokenizer(), 0, {}
    for key, text in sorted(rows):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        out[key] = (start, len(ids), zlib.crc32(u32(ids)))
        start += len(ids)
    return out


def op3(rows):
    tok, out = word_tokenizer(), {}
    for key, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        out[key] = (len(ids), hashlib.sha256(u32(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    return out


def op4(rows):
    tok, out = word_tokenizer("byte_bpe_50k.json"), {}
    for key, text in rows:
        n = len(tok.encode(text or "", add_special_tokens=False).ids)
        out[key] = (len((text or "").encode()), n, n > 512)
    return out


KINDS = [
    ("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def op5(rows):
    out = {}
    for key, text in rows:
        spans = [
            (m.start(), i, m.end()) for i, (_, p, group, least) in enumerate(KINDS)
            for m in p.finditer(text or "") if len(m.group(group)) >= least
        ]
        text_spans = ",".join(f"{KINDS[k][0]}:{s}:{e}" for s, k, e in sorted(spans))
        n = Counter(k for _, k, _ in spans)
        out[key] = (n[0], n[1], n[2], hashlib.sha256(text_spans.encode()).hexdigest(), text_spans)
    return out


def op6(rows, capacity=4096):
    tok, out = word_tokenizer(), {}
    for key, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        for i, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            out[key, i] = (at, len(part), zlib.crc32(u32(part)))
    return out


def check_packing(rows, capacity=4096):
    """rows: (length, sequence, offset).  Gapless, within capacity; gives the number of sequences."""
    by = defaultdict(list)
    for length, sequence, offset in rows:
        by[sequence].append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def op8(rows):
    groups = defaultdict(list)
    for key, text in rows:
        clean = SPACE.sub("", text or "")
        groups[hashlib.sha256(clean.encode()).hexdigest()].append((-len(text or ""), key))
    return {
        key: (min(g)[1], len(g), key == min(g)[1], digest) for digest, g in groups.items() for _, key in g
    }


def op9(rows, k=5):
    """rows: (vec_id, components or None)."""
    clean = {}
    for key, vector in rows:
        if vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        clean[key] = [int(np.floor(256 * float(x))) for x in vector]
    out = []
    for q, a in clean.items():
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), v) for v, b in clean.items() if v != q)
            out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(scored[:k])]
    return out


def shingles(text, size=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def op10(rows):
    sets = [(key, shingles(text)) for key, text in rows]
    parent = {key: key for key, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            holders[g].append(i)
    shared = Counter()
    for docs in holders.values():
        for a in range(len(docs)):
            for b in range(a):
                shared[docs[b], docs[a]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a][1]) + len(sets[b][1]) - n):
            x, y = root(sets[a][0]), root(sets[b][0])
            parent[max(x, y)] = min(x, y)
    return {key: (len(s), root(key)) for key, s in sets}


TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def op11(rows, items, k=10):
    """[(item, rank, key, score)]; null keys last among equal scores."""
    docs = [(key, Counter(TERM.findall((text or "").encode().translate(LOWER)))) for key, text in rows]
    docs = [(key, c) for key, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    held = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        terms = TERM.findall((text or "").encode().translate(LOWER))
        scored = []
        for key, c in docs:
            m = 25 + (75 * sum(c.values()) * n) // total
            s = sum(int(np.floor(1000 * np.log((2 * n + 2) / (2 * held[t] + 1)))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, key is None, key or 0, key))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:k])]
    return out


def op12(rows, k=16, rounds=3, scale=64, width=64):
    """Sorted [(key, cluster, distance, cluster_inertia, inertia, centroid)], in Python's whole numbers."""
    kept = []
    for key, v in rows:
        if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v):
            kept.append((key, tuple(int(np.floor(scale * float(x))) for x in v)))
    hashed = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(x) for _, x in hashed[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids)) for _, x in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            own = [x for (_, x), (_, c) in zip(kept, at) if c == j]
            if own:
                centroids[j] = [sum(col) // len(own) for col in zip(*own)]
    at = assign()
    inertia = Counter()
    for d, j in at:
        inertia[j] += d
    return sorted(((key, j, d, inertia[j], sum(inertia.values()), ",".join(map(str, centroids[j])))
                   for (key, _), (d, j) in zip(kept, at)), key=repr)


def op13(rows, items, size=10):
    """{key: (n_words, n_hit, items, spans)} with spans in code points."""
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall((text or "").encode().translate(LOWER))
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[i:i + size])].add(item)
    out = {}
    for key, text in rows:
        data = (text or "").encode()
        found = list(WORD.finditer(data.translate(LOWER)))
        words, hit, names = [m.group() for m in found], set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if (own := windows.get(tuple(words[i:i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    names |= own
        spans = []
        for i in sorted(hit):
            if i - 1 in hit:
                spans[-1][1] = found[i].end()
            else:
                spans.append([found[i].start(), found[i].end()])
        points = [(len(data[:a].decode()), len(data[:b].decode())) for a, b in spans]
        out[key] = (len(words), len(hit), sorted(str(x) for x in names if x is not None), points)
    return out
