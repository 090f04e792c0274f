"""Suffix sorting by induction, with queues that go to disk.

Suffixes of a text of bytes are either larger (L) or smaller (S) than the one that starts at the next place. Those
S suffixes that follow an L suffix are sorted first: their substrings up to the next such place are put in order by one
induction, named by rank, and the text of names is sorted by recursion. A second induction then carries the order to
all suffixes: in ascending order, each suffix pushes the one before it, if that is L, into the queue of its first
byte; in descending order the same for S. What a queue gets, it gets in order, so it is read from its front: the
queues of all bytes are one priority queue of (byte, order of the following suffix).

At the level of bytes the queues hold numpy arrays and are written to a temporary file beyond ``MEMORY`` bytes; the text
of names has a third as many symbols at most, and is sorted in memory by the same two inductions.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of positions that the queues of one sort keep in memory.
MEMORY = 64 << 20
#: Positions that are read from a queue at once.
BLOCK = 1 << 18


class Spool:
    """One temporary file for the queues of a sort; it is deleted when the sort ends."""

    def __init__(self, memory: int = MEMORY):
        self.left, self.file, self.size = memory, None, 0

    def put(self, a: np.ndarray):
        """What stands for ``a`` in a queue."""
        if a.nbytes <= self.left:
            self.left -= a.nbytes
            return a
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="tidemark-queue-", buffering=0)
        at = self.size
        self.file.seek(at)
        self.file.write(a.tobytes())
        self.size += a.nbytes
        return (at, len(a))

    def get(self, x) -> np.ndarray:
        if isinstance(x, np.ndarray):
            return x
        return np.frombuffer(os.pread(self.file.fileno(), 8 * x[1], x[0]), dtype=np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Queue:
    """Positions in the order in which they came, on a spool."""

    def __init__(self, spool: Spool):
        self.spool, self.parts, self.read = spool, [], 0

    def push(self, a: np.ndarray) -> None:
        for i in range(0, len(a), BLOCK):
            self.parts.append(self.spool.put(a[i : i + BLOCK]))

    def _block(self, at: int, step: int) -> tuple[list, int]:
        """Parts from ``at`` on, up or down, with about BLOCK positions; the place after them."""
        out, n = [], 0
        while 0 <= at < len(self.parts) and n < BLOCK:
            x = self.parts[at]
            n += len(x) if isinstance(x, np.ndarray) else x[1]
            out.append(x)
            at += step
        return out, at

    def _join(self, parts: list) -> np.ndarray:
        return self.spool.get(parts[0]) if len(parts) == 1 else np.concatenate([self.spool.get(x) for x in parts])

    def pop(self) -> np.ndarray | None:
        """The next positions, or None while there are no more."""
        if self.read == len(self.parts):
            return None
        parts, self.read = self._block(self.read, 1)
        return self._join(parts)

    def backward(self) -> Iterator[np.ndarray]:
        at = len(self.parts) - 1
        while at >= 0:
            parts, at = self._block(at, -1)
            yield self._join(parts[::-1])[::-1]

    def forward(self) -> Iterator[np.ndarray]:
        at = 0
        while at < len(self.parts):
            parts, at = self._block(at, 1)
            yield self._join(parts)


def smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is an S suffix; the last symbol is less than all others."""
    n = len(t)
    ends = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)
    up = np.ones(len(ends), dtype=bool)
    up[:-1] = t[ends[:-1]] < t[ends[:-1] + 1]
    return np.repeat(up, np.diff(np.concatenate(([-1], ends))))


def _deal(queues: list[Queue], positions: np.ndarray, t: np.ndarray) -> None:
    first = t[positions]
    order = np.argsort(first, kind="stable")
    first = first[order]
    cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
    for part in np.split(positions[order], cuts) if len(order) else []:
        queues[int(t[part[0]])].push(part)


def _induce(t: np.ndarray, is_s: np.ndarray, seeds: list[np.ndarray], symbols: int, spool: Spool) -> tuple[list[Queue], list[Queue]]:
    """Queues of L suffixes (ascending) and S suffixes (descending) by first symbol. seeds: positions by first symbol."""
    larger = [Queue(spool) for _ in range(symbols)]
    for c in range(symbols):
        while (batch := larger[c].pop()) is not None:
            before = batch[batch > 0] - 1
            _deal(larger, before[~is_s[before]], t)
        if len(seeds[c]):
            before = seeds[c][seeds[c] > 0] - 1
            _deal(larger, before[~is_s[before]], t)
    lesser = [Queue(spool) for _ in range(symbols)]
    lesser[0].push(np.array([len(t) - 1], dtype=np.int64))
    for c in range(symbols - 1, -1, -1):
        while (batch := lesser[c].pop()) is not None:
            before = batch[batch > 0] - 1
            _deal(lesser, before[is_s[before]], t)
        for batch in larger[c].backward():
            before = batch[batch > 0] - 1
            _deal(lesser, before[is_s[before]], t)
    return larger, lesser


def _all(larger: list[Queue], lesser: list[Queue]) -> Iterator[np.ndarray]:
    for a, b in zip(larger, lesser, strict=True):
        yield from a.forward()
        yield from b.backward()


def _by_symbol(positions: np.ndarray, t: np.ndarray, symbols: int) -> list[np.ndarray]:
    order = np.argsort(t[positions], kind="stable")
    return np.split(positions[order], np.searchsorted(t[positions][order], np.arange(1, symbols)))


def names_of(t: np.ndarray, ordered: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """0, 1, ... for the substrings from each of ``ordered`` to its place in ``ends``; equal ones get equal names."""
    length = ends - ordered + 1
    same = length[1:] == length[:-1]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        live = live[length[live] > k]
        differs = t[ordered[live] + k] != t[ordered[live + 1] + k]
        same[live[differs]] = False
        live = live[~differs]
        k += 1
    return np.concatenate(([0], np.cumsum(~same)))


def suffixes(t: np.ndarray, symbols: int, memory: int = MEMORY) -> Iterator[np.ndarray]:
    """Positions of all suffixes of t in order, in pieces. t: small integers under ``symbols``, where the last is 0 and no other is."""
    is_s = smaller(t)
    starts = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    spool = Spool(memory)
    try:
        larger, lesser = _induce(t, is_s, _by_symbol(starts, t, symbols), symbols, spool)
        is_start = np.zeros(len(t), dtype=bool)
        is_start[starts] = True
        ordered = np.concatenate([x[is_start[x]] for x in _all(larger, lesser)]) if len(starts) else starts
    finally:
        spool.close()
    if len(ordered) > 1:
        rank = np.searchsorted(starts, ordered)
        ends = np.append(starts[1:], len(t) - 1)[rank]
        names = names_of(t, ordered, ends)
        if names[-1] + 1 < len(ordered):
            text = np.empty(len(ordered), dtype=np.int64)
            text[rank] = names
            ordered = starts[np.array(_sorted_names(text.tolist(), int(names[-1]) + 1), dtype=np.int64)]
    spool = Spool(memory)
    try:
        yield from _all(*_induce(t, is_s, _by_symbol(ordered, t, symbols), symbols, spool))
    finally:
        spool.close()


def _sorted_names(t: list[int], symbols: int) -> list[int]:
    """The same for a text of names in memory; its last name is 0 and no other is."""
    n = len(t)
    if symbols == n:
        out = [0] * n
        for i, c in enumerate(t):
            out[c] = i
        return out
    is_s = bytearray(n)
    is_s[n - 1] = 1
    for i in range(n - 2, -1, -1):
        a, b = t[i], t[i + 1]
        if a < b or (a == b and is_s[i + 1]):
            is_s[i] = 1
    starts = [i for i in range(1, n) if is_s[i] and not is_s[i - 1]]
    count = [0] * (symbols + 1)
    for c in t:
        count[c + 1] += 1
    for c in range(symbols):
        count[c + 1] += count[c]
    heads, tails = count[:-1], count[1:]

    def induce(seeds: list[int]) -> list[int]:
        out = [-1] * n
        at = tails[:]
        for i in reversed(seeds):
            c = t[i]
            at[c] -= 1
            out[at[c]] = i
        at = heads[:]
        for i in out:  # grows while it is read
            if i > 0 and not is_s[i - 1]:
                c = t[i - 1]
                out[at[c]] = i - 1
                at[c] += 1
        at = tails[:]
        for k in range(n - 1, -1, -1):
            i = out[k]
            if i > 0 and is_s[i - 1]:
                c = t[i - 1]
                at[c] -= 1
                out[at[c]] = i - 1
        return out

    by_symbol = sorted(starts, key=t.__getitem__)
    ordered = [i for i in induce(by_symbol) if i > 0 and is_s[i] and not is_s[i - 1]]
    follow = dict(zip(starts, [*starts[1:], n - 1], strict=True))
    place = {i: k for k, i in enumerate(starts)}
    names, name, last = [0] * len(starts), -1, None
    for i in ordered:
        part = t[i : follow[i] + 1]
        if part != last:
            name, last = name + 1, part
        names[place[i]] = name
    if name + 1 < len(ordered):
        ordered = [starts[k] for k in _sorted_names(names, name + 1)]
    return induce(ordered)
