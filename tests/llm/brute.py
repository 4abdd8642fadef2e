"""Plain Python twins of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def spans(text, window):
    """Marks of a sequence of hashable windows' symbols."""
    return [tuple(text[s:s + window]) for s in range(len(text) - window + 1)]


def removal(sequences, window):
    seen = Counter(w for x in sequences for w in spans(x, window))
    out = []
    for x in sequences:
        gone = [False] * len(x)
        for s, w in enumerate(spans(x, window)):
            if seen[w] > 1:
                gone[s:s + window] = [True] * window
        out.append(gone)
    return out


def suffix_bytes(rows, window=400):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), b, gone in zip(rows, texts, removal(texts, window)):
        runs = sum(1 for p, g in enumerate(gone) if g and not (p and gone[p - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def suffix_words(rows, window=35):
    texts = [WORD.findall(t or "") for _, t in rows]
    return [(i, len(w), sum(gone), hashlib.sha256(" ".join(c for c, g in zip(w, gone) if not g).encode()).hexdigest())
            for (i, _), w, gone in zip(rows, texts, removal(texts, window))]


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def near(rows):
    """(id, shingles, component) by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x])
        for j, both in common.items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                parent[root(i)] = root(j)
        for x in s:
            holders[x].append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, len(s), least.get(root(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets))]


def smith_waterman(a, b, cost=0.5):
    best, held = 0.0, [0.0] * (len(a) + 1)
    for y in b:
        row = [0.0]
        for j, x in enumerate(a):
            row.append(max(0.0, held[j] + (1 if x == y else -cost), held[j + 1] - cost, row[j] - cost))
        held = row
        best = max(best, max(row))
    return best


def conversations(rows, family=20, shared=4):
    """Rebuilt conversations: id to its (role, text) turns."""
    import zlib

    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(x, key=lambda y: y[0])] for c, x in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % shared
        base = c - (c % family if c >= 0 else -(-c % family))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def trie(rows):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    members = defaultdict(list)
    whole = conversations(rows)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    total = {}
    for node in sorted(members, key=len, reverse=True):
        below = [total[x] for x in children[node]]
        saved = (len(members[node]) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        total[node] = (sum(x[0] for x in below) or 1, saved + sum(x[1] for x in below))
    return [(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), *total[n],
             hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(n)).encode()).hexdigest()) for n, m in members.items()]


def negatives(rows, positives=5, many=10, step=100, low=30, high=90):
    """(anchor, positive, rank, negative, positive score, negative score) by scoring every pair; rows: (id, label, vector)."""
    import math

    taken = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            row = (i, label, tuple(math.floor(256 * x) for x in v))
            if row not in taken:
                taken.append(row)
    out = []
    for i, label, q in taken:
        if i % step:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, own) for j, own, v in taken if j != i)
        for p, j, own in [x for x in scored if x[2] == label][:positives]:
            p = -p
            fit = [(-n, k) for n, k, other in scored if other != label and 30 * p <= 100 * -n <= 90 * p]
            out += [(i, j, r + 1, k, p, n) for r, (n, k) in enumerate(fit[:many])]
    return out
