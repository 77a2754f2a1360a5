"""String similarity from public definitions, 0 to 100.

The base ratio is 200 L / (n + m) with L the longest common subsequence
(insertions and deletions only). ``token_set_ratio`` compares the sorted
common words with each side's rest and takes the best; a side whose words
are all in the other scores 100. ``partial_ratio`` is the best ratio of the
shorter text with any window of the longer one of its length.
"""

from __future__ import annotations


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if len(a) > len(b):
        a, b = b, a
    full = (1 << len(a)) - 1
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * _common_subsequence(a, b) / total


def token_set_ratio(a: str | None, b: str | None) -> float:
    left, right = set((a or "").split()), set((b or "").split())
    if not left or not right:
        return 0.0
    both = " ".join(sorted(left & right))
    if both and (left <= right or right <= left):
        return 100.0
    x, y = (" ".join(filter(None, (both, " ".join(sorted(s))))) for s in (left - right, right - left))
    best = ratio(x, y)
    if both:
        best = max(best, ratio(both, x), ratio(both, y))
    return best


def partial_ratio(a: str | None, b: str | None) -> float:
    a, b = a or "", b or ""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    if a in b:
        return 100.0
    n, best = len(a), 0.0
    # Windows may hang over either end of the longer text.
    for at in range(1 - n, len(b)):
        best = max(best, ratio(a, b[max(0, at) : at + n]))
    return best
