"""Brute force that tests hold operators against."""

import re

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def later(docs, windows):
    """For each document the positions covered by a window that also starts earlier; windows(text) gives (start, stop, key)."""
    seen, out = set(), []
    for d, t in sorted(docs, key=lambda x: x[0]):
        covered = set()
        for a, b, key in windows(t):
            if key in seen:
                covered.update(range(a, b))
            seen.add(key)
        out.append((d, t, covered))
    return out
