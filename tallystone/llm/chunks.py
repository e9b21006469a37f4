"""Bounded memory of what a tokenizer gives for a white-space chunk, kept by each Python worker."""

from __future__ import annotations

from collections.abc import Callable

LONGEST = 64  # characters of a chunk that is worth keeping
KEPT = 400_000  # chunks of a generation; two generations are kept at most


class ChunkMemory:
    """chunk -> value, where `make` gives the values of a list of new chunks at once.

    A full generation becomes the old one; what is met again moves from it to the new one,
    so that frequent chunks stay and rare ones go.
    """

    def __init__(self, make: Callable[[list[str]], list]) -> None:
        self.make, self.known, self.old, self.long = make, {}, {}, []

    def learn(self, chunks: set[str]) -> dict:
        """The memory, holding a value for each of these chunks until the next call."""
        if len(self.known) > KEPT:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        new = list(chunks.difference(known))
        if old:
            again = [c for c in new if c in old]
            known.update((c, old[c]) for c in again)
            new = [c for c in new if c not in old] if again else new
        if new:
            known.update(zip(new, self.make(new), strict=True))
        self.long = [c for c in new if len(c) > LONGEST]
        return known

    def values(self, chunks: list[str]) -> list:
        """The values of distinct chunks."""
        got = list(map(self.learn(set(chunks)).__getitem__, chunks))
        self.forget()
        return got

    def forget(self) -> None:
        """Drop the long chunks of the last call."""
        for c in self.long:
            self.known.pop(c, None)
