"""Complete retrieval of the vocabulary words within an edit distance.

A universal Levenshtein automaton is intersected with a trie: its states and
transitions don't name characters, only which of the next pattern characters
equal the one read, so they are worked out once for all words.
"""

from __future__ import annotations

from functools import lru_cache

State = frozenset  # of (offset from the base, errors)


@lru_cache(maxsize=1 << 16)
def step(state: State, hits: tuple[bool, ...], k: int) -> tuple[int, State] | None:
    """Read one character; ``hits``: which pattern characters from the base on equal it, as far as the pattern goes.

    Gives how far the base moves and the new state; None: no word can match.
    """
    new: set[tuple[int, int]] = set()
    n = len(hits)
    for i, e in state:
        if i < n and hits[i]:
            new.add((i + 1, e))
            continue
        if e < k:
            new.add((i, e + 1))  # inserted in the word
            if i < n:
                new.add((i + 1, e + 1))  # replaced
            for j in range(1, k - e + 1):  # left out of the word
                if i + j < n and hits[i + j]:
                    new.add((i + j + 1, e + j))
                    break
    kept = {(i, e) for i, e in new if not any(f < e and abs(i - j) <= e - f for j, f in new)}
    if not kept:
        return None
    base = min(i for i, _ in kept)
    return base, frozenset((i - base, e) for i, e in kept)


class Trie:
    """Vocabulary as nested dictionaries; the key '' ends a word."""

    def __init__(self, words):
        self.root: dict = {}
        for w in words:
            at = self.root
            for c in w:
                at = at.setdefault(c, {})
            at[""] = w

    def within(self, pattern: str, k: int) -> list[tuple[int, str]]:
        """All (distance, word) with distance of at most ``k``, nearest first."""
        found, n, width = [], len(pattern), 2 * k + 1
        moves: dict[tuple[State, int], dict[str, tuple[int, State] | None]] = {}  # of this pattern, as many nodes share them
        stack = [(self.root, 0, frozenset([(0, 0)]))]
        while stack:
            at, base, state = stack.pop()
            if "" in at:
                d = min(e + n - base - i for i, e in state)
                if d <= k:
                    found.append((d, at[""]))
            read = moves.get((state, base))
            if read is None:
                read = moves[state, base] = {}
                if all(e == k for _, e in state):  # only equal characters lead on
                    read |= dict.fromkeys(pattern[base + i] for i, _ in state if base + i < n)
                    for c in read:
                        read[c] = step(state, tuple(p == c for p in pattern[base : base + width]), k)
                    read[""] = None
            for c in read if "" in read else at:
                if c == "" or c not in at:
                    continue
                if c in read:
                    moved = read[c]
                else:
                    moved = read[c] = step(state, tuple(p == c for p in pattern[base : base + width]), k)
                if moved:
                    stack.append((at[c], base + moved[0], moved[1]))
        return sorted(found)
