"""A generalised suffix automaton over sequences of hashable tokens."""

from __future__ import annotations


class SuffixAutomaton:
    """All factors of the added sequences, with the smallest owner of each.

    State 0 is the root. For a state s: next[s] maps a token to a state, link[s]
    is the state of its longest shorter suffix class, length[s] the longest
    factor of its class. settle() must run after the last add().
    """

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.owners: list[set | int | None] = [None]

    def _extend(self, last: int, token) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(token)
        if q is not None:
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, q, token)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        self.owners.append(None)
        p = last
        while p >= 0 and token not in nxt[p]:
            nxt[p][token] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][token]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, token)
        return new

    def _clone(self, p: int, q: int, token) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        self.owners.append(None)
        while p >= 0 and nxt[p].get(token) == q:
            nxt[p][token] = copy
            p = link[p]
        link[q] = copy
        return copy

    def add(self, tokens, owner) -> int:
        """Add a sequence; its prefixes' states get the owner (settle() spreads it). Returns the last state."""
        last = 0
        owners = self.owners
        for t in tokens:
            last = self._extend(last, t)
            if owners[last] is None or owner < owners[last]:
                owners[last] = owner
        return last

    def settle(self) -> None:
        """Give each state the smallest owner among the sequences its factors occur in."""
        owners, link = self.owners, self.link
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            o, p = owners[s], link[s]
            if p > 0 and o is not None and (owners[p] is None or o < owners[p]):
                owners[p] = o

    def walk(self, tokens):
        """Matching statistics: for each token the state and length of the longest suffix that occurs."""
        nxt, link, length = self.next, self.link, self.length
        s = n = 0
        for t in tokens:
            while s and t not in nxt[s]:
                s = link[s]
                n = length[s]
            to = nxt[s].get(t)
            if to is None:
                s = n = 0
            else:
                s, n = to, n + 1
            yield s, n
