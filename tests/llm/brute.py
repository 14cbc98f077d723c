"""Plain Python models of the text operators, written for clarity and used on small inputs only."""

import collections
import math
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def base_rules(text):
    w = words(text)
    places = collections.defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": failed,
    }


def _signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def cells(text, buckets):
    """Hash cells of words and pairs: a chained 64-bit hash with seed 42, as signed numbers."""
    w = words(text)
    one = [_signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in w]
    long = lambda v, seed: _signed(xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), seed % (1 << 64)))
    two = [long(b, long(a, 42)) for a, b in zip(one, one[1:], strict=False)]
    return [h % buckets for h in one + two]


def quality_scores(texts, trusted, buckets, smoothing):
    """Score of every text (None without words); ``trusted`` are positions."""
    found = [cells(t, buckets) for t in texts]
    raw, good = np.zeros(buckets), np.zeros(buckets)
    for k, cs in enumerate(found):
        for c in cs:
            raw[c] += 1
            good[c] += k in trusted
    if not good.sum():
        weights = np.zeros(buckets)
    else:
        share = lambda n: np.log((n + smoothing) / (n.sum() + smoothing * buckets))
        weights = share(good) - share(raw)
    return [float(weights[cs].mean()) if cs else None for cs in found]


def shingles(text):
    w = words((text or "").translate(FOLD))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def components(rows):
    """Smallest reachable id of every id; ``rows`` are (id, text) with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def best_fit_decreasing(lengths, window):
    """Room left in each window, pieces placed one by one."""
    room = []
    for size in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= size]
        if fits:
            best = min(fits, key=lambda k: room[k])
            room[best] -= size
        else:
            room.append(window - size)
    return sorted(room)


def unigram_scores(texts, training):
    """N, V and (tokens, known, base score) of every text; ``training`` says which are learned from."""
    tokens = [[*words((t or "").translate(FOLD)), " "] for t in texts]
    counts = collections.Counter(w for t, use in zip(tokens, training, strict=True) if use for w in t)
    n, v = sum(counts.values()), len(counts)
    scored = [
        (len(t), sum(counts[w] > 0 for w in t), sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        for t in tokens
    ]
    return n, v, scored
