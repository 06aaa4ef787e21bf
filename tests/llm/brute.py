"""Plain versions of the operators, row by row, that the tests hold the Spark ones against."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(ids, links):
    """The smallest id reachable from each."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def base_rules(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def shingles(text, size):
    words = WORD.findall((text or "").translate(FOLD))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def near_duplicates(rows, size, percent):
    """{id: (n_shingles, component_id)} of rows (id, text), by all pairs that share a shingle."""
    sets = {i: shingles(t, size) for i, t in rows}
    having = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    common = Counter()
    for owners in having.values():
        for k, a in enumerate(owners):
            for b in owners[k + 1 :]:
                common[a, b] += 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    of = components(sets, links)
    return {i: (len(sets[i]), of[i]) for i in sets}


def near_vectors(rows, least):
    """{id: (n_links, component_id)} of rows (id, label, vector)."""
    import numpy as np

    by = defaultdict(list)
    for i, label, v in rows:
        if label is None or v is None or not len(v) or any(x is None for x in v):
            continue
        v = np.array(v, float)
        if np.isfinite(v).all() and v.any():
            by[label, len(v)].append((i, v / np.linalg.norm(v)))
    links, counts = [], Counter()
    for group in by.values():
        x = np.array([v for _, v in group])
        a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            links.append((group[i][0], group[j][0]))
            counts[group[i][0]] += 1
            counts[group[j][0]] += 1
    of = components([r[0] for r in rows], links)
    return {r[0]: (counts[r[0]], of[r[0]]) for r in rows}


def repeated_strings(rows, length=50):
    """{id: (n_bytes, n_removed, n_spans, sha256)}"""
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        body = (t or "").encode()
        for k in range(len(body) - length + 1):
            first.setdefault(body[k : k + length], i)
    out = {}
    for i, t in rows:
        body = (t or "").encode()
        gone = [False] * len(body)
        for k in range(len(body) - length + 1):
            if first[body[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        out[i] = (len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeated_strings_of_rows(rows, length=50):
    """[(n_bytes, n_removed, n_spans, sha256)] of rows (id, text) with any ids: a null id is after all others."""
    order = [float("inf") if i is None else i for i, _ in rows]
    bodies = [(t or "").encode() for _, t in rows]
    out = []
    for own, body in zip(order, bodies, strict=True):
        earlier = {b[k : k + length] for i, b in zip(order, bodies, strict=True) if i < own for k in range(len(b) - length + 1)}
        gone = [False] * len(body)
        for k in range(len(body) - length + 1):
            if body[k : k + length] in earlier:
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(body), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(body, gone, strict=True) if not g)).hexdigest()))
    return out


def line_dedup(rows, width=3):
    """{id: (text, n_lines, n_removed, n_windows_removed)} of rows (id, text) with distinct ids."""
    blank = " \t\n\x0b\x0c\r"
    first = {}
    windows = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        worded = [(k, x.strip(blank)) for k, x in enumerate((t or "").split("\n")) if x.strip(blank)]
        windows[i] = [(worded[k][0], worded[k + width - 1][0], tuple(x for _, x in worded[k : k + width])) for k in range(len(worded) - width + 1)]
        for a, _, w in windows[i]:
            first.setdefault(w, (i, a))
    out = {}
    for i, t in rows:
        later = [(a, b) for a, b, w in windows[i] if first[w] != (i, a)]
        gone = {k for a, b in later for k in range(a, b + 1)}
        lines = (t or "").split("\n")
        text = "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else t
        out[i] = (text, len(lines) if t is not None else 0, len(gone), len(later))
    return out


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target}: shares by weight, none above most times its size, the excess shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: float(most * sizes[s]) for s in over}
