"""Plain versions of what the corpus operators compute, for small tables."""

import re
from collections import Counter

import xxhash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def alnum(text):
    return ALNUM.findall((text or "").translate(UPPER))


def spaced(text):
    return SPACED.findall((text or "").translate(UPPER))


def hits(text, items, window=10):
    """Hit places and keys of the items found in a text."""
    words, places, found = alnum(text), set(), set()
    for key, item in items:
        own = alnum(item)
        size = min(window, len(own))
        for gram in {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else ():
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) == gram:
                    places |= set(range(i, i + size))
                    found.add(key)
    return len(words), places, found


def fingerprint(text):
    words = spaced(text)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if grams else 0


def components(rows, bits=2):
    """(key, fingerprint) rows -> smallest key reachable, for each row in order."""
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, one) in enumerate(rows):
        for j in range(i):
            if bin(one ^ rows[j][1]).count("1") <= bits:
                root[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(least.get(top(i), key), key)
    return [least.get(top(i)) for i in range(len(rows))]


def targets(sizes, share=1.5, cap=2):
    """Source -> target, from source -> size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        left = share * sum(sizes.values()) - sum(cap * sizes[s] for s in capped)
        rest = sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and left * weight[s] / rest > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in capped else left * weight[s] / rest for s in names}
        capped |= more


def count_rows(rows):
    return Counter(tuple(r) for r in rows)
