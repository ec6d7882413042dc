"""Brute force that several tests share."""

import re

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    if len(w) >= k:
        return frozenset(zip(*(w[i:] for i in range(k))))
    return frozenset([tuple(w)]) if w else frozenset()


def jaccard_components(rows, k, threshold):
    sets = {i: shingles(x, k) for i, x in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = [i for i in sets if sets[i]]
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-12:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}
