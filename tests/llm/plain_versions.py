"""What the tests of this folder share: constants of the contracts and a plain Jaccard join."""

import re
from collections import Counter, defaultdict

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def components(rows):
    """Component of each row by comparing all pairs."""
    sets = [shingle_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    held = defaultdict(list)
    for i, r in enumerate(rows):
        held[root(i)].append(r[0])
    return Counter((r[0], len(sets[i]), min((x for x in held[root(i)] if x is not None), default=None)) for i, r in enumerate(rows))
