"""Plain versions of the operators, over lists of (doc_id, text)."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def without_repeats(rows, size=35):
    each = [(i, words(t)) for i, t in rows]
    count = Counter(tuple(w[j : j + size]) for _, w in each for j in range(len(w) - size + 1))
    out = []
    for i, w in each:
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if count[tuple(w[j : j + size])] > 1:
                gone[j : j + size] = [True] * size
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def near_groups(rows):
    sets = defaultdict(list)
    for i, t in rows:
        w = words(t, True)
        sets[i].append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and any(x and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    out = []
    for i, t in rows:
        w = words(t, True)
        n = len({tuple(w[j : j + 5]) for j in range(len(w) - 4)}) if len(w) >= 5 else min(len(w), 1)
        out.append((i, n, None if i is None else root(i), i is None or root(i) == i))
    return out


def base_scores(rows):
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows}
    count = Counter()
    for i, t in rows:
        if not held[i]:
            count.update([*words(t, True), None])
    total, kinds = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        w = [*words(t, True), None]
        out.append((i, held[i], len(w), sum(count[x] > 0 for x in w), total, sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in w)))
    return out


BASE = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 12),
    ("access", r"AKIA[A-Z0-9]+", re.A, 0, 18),
    ("hex", r"[0-9a-f]+", re.A, 0, 16),
]


def base_secrets(text):
    found = []
    for rank, (kind, pattern, flags, group, least) in enumerate(BASE):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "", flags) if len(m[group]) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]
