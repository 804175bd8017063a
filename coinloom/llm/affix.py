"""Which entries of a fixed vocabulary end at a place of a text, found step by step."""

from __future__ import annotations

from collections.abc import Mapping


class EndingEntries(dict):
    """state + next character -> (next state, values of the entries that end there, longest first).

    A state is the longest end of what was read that begins an entry: with it, all entries
    that end at the next character are known. Steps are worked out when first asked for.
    """

    def __init__(self, entries: Mapping[str, object], most: int = 300_000):
        super().__init__()
        self.entries, self.most = entries, most
        self.begins = {e[:i] for e in entries for i in range(1, len(e) + 1)}

    def __missing__(self, key: str) -> tuple[str, tuple]:
        if len(self) >= self.most:
            self.clear()
        state = key
        while state and state not in self.begins:
            state = state[1:]
        ends = (key[i:] for i in range(len(key)))
        out = self[key] = (state, tuple((len(e), self.entries[e]) for e in ends if e in self.entries))
        return out
