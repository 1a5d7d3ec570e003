"""Plain versions of the operators, for comparison on small tables."""

from __future__ import annotations

from collections import Counter, defaultdict


def word_shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def roots(keys, links):
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in keys}


def similar_pairs(sets, least):
    """Pairs with 100 * intersection >= least * union, by an exact prefix filter."""
    often = Counter(x for s in sets.values() for x in s)
    index, out = defaultdict(list), set()
    for key in sorted(sets, key=lambda k: len(sets[k])):
        own = sets[key]
        ordered = sorted(own, key=lambda x: (often[x], x))
        prefix = ordered[: len(own) - -(-least * len(own) // 100) + 1]
        for other in {o for x in prefix for o in index[x]}:
            both = len(own & sets[other])
            if 100 * both >= least * (len(own) + len(sets[other]) - both):
                out.add((min(key, other), max(key, other)))
        for x in prefix:
            index[x].append(key)
    return out


def near_components(texts, size, least):
    """doc -> (set size, component) by comparing whole sets."""
    sets = {k: word_shingles(t, size) for k, t in texts.items()}
    found = roots(sets, similar_pairs({k: s for k, s in sets.items() if s}, least))
    return {k: (len(sets[k]), found[k]) for k in sets}


def line_fates(texts, size, least):
    """(doc, line) -> kept (doc, line) for every line with a word."""
    first, sets, of = {}, {}, {}
    for doc in sorted(texts):
        for k, line in enumerate((texts[doc] or "").split("\n")):
            line = line.strip(" \t\n\x0b\x0c\r")
            if line:
                of[doc, k] = line
                first.setdefault(line, (doc, k))
    for line, place in first.items():
        sets[place] = frozenset(line[i : i + size] for i in range(max(1, len(line) - size + 1)))
    found = roots(sets, similar_pairs(sets, least))
    return {place: found[first[line]] for place, line in of.items()}


def repeated_cover(texts, length):
    """doc -> bytes flags: covered by a string of ``length`` bytes that starts elsewhere too."""
    seen = Counter()
    bodies = {k: (t or "").encode() for k, t in texts.items()}
    for b in bodies.values():
        seen.update(hash(b[i : i + length]) for i in range(len(b) - length + 1))
    out = {}
    for k, b in bodies.items():
        flags, until = bytearray(len(b)), 0
        for i in range(len(b) - length + 1):
            if seen[hash(b[i : i + length])] > 1:
                for j in range(max(i, until), i + length):
                    flags[j] = 1
                until = i + length
        out[k] = bytes(flags)
    return out
