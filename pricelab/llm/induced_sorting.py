"""Suffix order with common-prefix lengths by induced sorting, its queues on disk beyond a memory limit.

A suffix is of type S if it is smaller than the next one and of type L otherwise; an S suffix after an L one is
an S* suffix.  The S* suffixes are sorted first: one induction over their unsorted first characters sorts the
strings between neighbouring S* positions, equal strings get equal names, and if names repeat the string of names is
sorted by the same method (or, when it is short, in memory by doubling).  Two inductions then give all
suffixes: scanning upwards, each suffix passes its L predecessor to the queue of that one's first character;
scanning downwards, its S predecessor.  The queue of a character releases its suffixes in the order they
came, so the queues together are a priority queue by (character, rank of the next suffix).

Every queue entry carries the length of the common prefix with the entry before it: one more than the
smallest such value among the suffixes scanned between the two that sent them.  Values are cut at ``limit``.

Work is done on whole batches (a queue's content) with numpy.  Entries over ``memory`` are written to an unnamed temporary
file that belongs to the running task and vanishes with it; nobody else reads it.
"""

from __future__ import annotations

import tempfile
from heapq import heappop, heappush

import numpy as np

from pricelab.llm.common import mix, powers

#: Strings of names up to this length are sorted in memory.
SHORT = 1 << 22
#: Queue entries held in memory before they are written to disk.
MEMORY = 1 << 22


class Queues:
    """For each character a queue of (position, common prefix); the next character comes from a heap."""

    def __init__(self, memory: int, down: bool):
        self.memory, self.sign, self.held = memory, -1 if down else 1, 0
        self.blocks: dict[int, list] = {}
        self.heap: list[int] = []
        self.file = None
        self.spilled = 0

    def push(self, char: int, position: np.ndarray, prefix: np.ndarray) -> None:
        if char not in self.blocks:
            self.blocks[char] = []
            heappush(self.heap, self.sign * char)
        self.blocks[char].append((position, prefix))
        self.held += len(position)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for blocks in self.blocks.values():
            for k, block in enumerate(blocks):
                if len(block) == 2:
                    at = self.file.seek(0, 2)
                    self.file.write(block[0].astype(np.int64).tobytes())
                    self.file.write(block[1].astype(np.int32).tobytes())
                    blocks[k] = (at, len(block[0]), None)
                    self.spilled += len(block[0])
        self.held = 0

    def next_char(self) -> int | None:
        return self.sign * self.heap[0] if self.heap else None

    def pop(self) -> tuple[np.ndarray, np.ndarray]:
        """All entries of the next character in the order they came."""
        blocks = self.blocks.pop(self.sign * heappop(self.heap))
        out = []
        for block in blocks:
            if len(block) == 3:
                at, n, _ = block
                self.file.seek(at)
                block = (np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(4 * n), np.int32))
            else:
                self.held -= len(block[0])
            out.append(block)
        return np.concatenate([b[0] for b in out]), np.concatenate([b[1] for b in out])


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S (the end of the text is smaller than any character)."""
    n = len(text)
    less, differ = text[:-1] < text[1:], text[:-1] != text[1:]
    out = np.zeros(n, dtype=bool)
    # the next place where neighbours differ decides for the whole run
    at = np.where(differ, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1] if n > 1 else at
    inside = at < n - 1
    out[:-1][inside] = less[at[inside]]
    return out


def _runs(text: np.ndarray) -> np.ndarray:
    """Number of equal characters from each place on."""
    n = len(text)
    end = np.where(np.concatenate([text[:-1] != text[1:], [True]]), np.arange(1, n + 1), n)
    return np.minimum.accumulate(end[::-1])[::-1] - np.arange(n)


def _scan(text: np.ndarray, wanted: np.ndarray, runs: np.ndarray, feed: dict[int, tuple[np.ndarray, np.ndarray]], limit: int, memory: int, down: bool, start: tuple[np.ndarray, np.ndarray]) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], int]:
    """One induction.  ``wanted`` marks the suffixes to induce (L upwards, S downwards); ``feed`` holds for each
    character the given suffixes that are scanned after the induced ones of that character, in scan order, with common
    prefixes; ``start`` comes before all.  Returns the induced suffixes of each character in scan order."""
    queues = Queues(memory, down)
    low: dict[int, int] = {}
    since = limit  # smallest prefix of the batches scanned, kept for characters by the batch of their last entry
    marks: list[int] = []
    last_mark: dict[int, int] = {}
    done: dict[int, list] = {}

    def batch(position: np.ndarray, prefix: np.ndarray) -> None:
        nonlocal since
        before = position - 1
        sends = np.flatnonzero((position > 0) & wanted[np.maximum(before, 0)])
        if len(sends):
            chars = text[before[sends]]
            order = np.argsort(chars, kind="stable")
            sends, chars = sends[order], chars[order]
            cut = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
            for a, b in zip(cut, np.append(cut[1:], len(sends)), strict=True):
                char, k = int(chars[a]), sends[a:b]
                least = np.minimum.reduceat(prefix[: k[-1] + 1], np.concatenate([[0], k[:-1] + 1]))
                if char in low:
                    earlier = min([low[char], *marks[last_mark[char] :]]) if last_mark[char] < len(marks) else low[char]
                    least[0] = min(least[0], earlier)
                    least = np.minimum(least + 1, limit)
                else:
                    least = np.minimum(least + 1, limit)
                    least[0] = 0
                queues.push(char, before[k], least)
                low[char] = int(prefix[k[-1] + 1 :].min()) if k[-1] + 1 < len(prefix) else limit
                last_mark[char] = len(marks) + 1
        marks.append(int(prefix.min()) if len(prefix) else limit)

    if len(start[0]):
        batch(*start)
    order = sorted(feed, reverse=down)
    at = 0
    while True:
        char = queues.next_char()
        given = order[at] if at < len(order) else None
        if char is None and given is None:
            return {c: (np.concatenate([x[0] for x in v]), np.concatenate([x[1] for x in v])) for c, v in done.items()}, queues.spilled
        if given is None or char is not None and (char >= given if down else char <= given):
            position, prefix = queues.pop()
            done.setdefault(char, []).append((position, prefix))
            batch(position, prefix)  # may refill the queue of the same character
        else:
            position, prefix = feed[given]
            prefix = prefix.copy()
            if given in done:  # last induced and first given differ where the shorter run ends
                prefix[0] = min(int(runs[done[given][-1][0][-1]]), int(runs[position[0]]), limit)
            batch(position, prefix)
            at += 1


def _by_char(text: np.ndarray, position: np.ndarray, prefix: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sorted suffixes split by first character; the first of each has no common prefix with the one before."""
    out = {}
    if not len(position):
        return out
    chars = text[position]
    cut = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
    for a, b in zip(cut, np.append(cut[1:], len(chars)), strict=True):
        p = prefix[a:b].copy()
        p[0] = 0
        out[int(chars[a])] = (position[a:b], p)
    return out


def _induce(text: np.ndarray, is_s: np.ndarray, runs: np.ndarray, stars: np.ndarray, prefix: np.ndarray, limit: int, memory: int) -> tuple[np.ndarray, np.ndarray, int]:
    """All suffixes and common prefixes from the S* suffixes in order."""
    n = len(text)
    end = (np.array([n], dtype=np.int64), np.zeros(1, dtype=np.int32))
    up, spilled = _scan(text, ~is_s, runs, _by_char(text, stars, prefix), limit, memory, False, end)
    # downwards: prefixes belong to the pair with the suffix scanned before, i.e. the next larger one
    feed = {}
    for c, (p, x) in up.items():
        feed[c] = (p[::-1], np.concatenate([[0], x[1:][::-1]]).astype(np.int32))
    down, more = _scan(text, is_s, runs, feed, limit, memory, True, (np.zeros(0, np.int64), np.zeros(0, np.int32)))
    order, common = [], []
    for c in sorted(set(up) | set(down)):
        parts = [up[c]] if c in up else []
        if c in down:
            p, x = down[c]
            x = np.concatenate([[0], x[1:][::-1]]).astype(np.int32)
            if c in up:
                x[0] = min(int(runs[up[c][0][-1]]), int(runs[p[-1]]), limit)
            parts.append((p[::-1], x))
        order += [p for p, _ in parts]
        common += [x for _, x in parts]
    return np.concatenate(order), np.concatenate(common), spilled + more


def _doubling(names: np.ndarray) -> np.ndarray:
    """Suffix order of a short integer string; only groups of equal rank are sorted again."""
    n = len(names)
    _, kind, sizes = np.unique(names, return_inverse=True, return_counts=True)
    order = np.argsort(kind, kind="stable")
    rank = (np.cumsum(sizes) - sizes)[kind]
    k, todo = 1, order
    while True:
        same = np.zeros(len(todo), dtype=bool)
        r = rank[todo]
        same[1:] = r[1:] == r[:-1]
        same[:-1] |= r[:-1] == r[1:]
        todo = todo[same]
        if not len(todo):
            break
        nxt = np.where(todo + k < n, rank[np.minimum(todo + k, n - 1)] + 1, 0)
        todo = todo[np.lexsort((nxt, rank[todo]))]
        nxt = np.where(todo + k < n, rank[np.minimum(todo + k, n - 1)] + 1, 0)
        r = rank[todo]
        head = np.concatenate([[True], r[1:] != r[:-1]])
        step = np.concatenate([[True], (r[1:] != r[:-1]) | (nxt[1:] != nxt[:-1])])
        group_at = np.maximum.accumulate(np.where(head, np.arange(len(todo)), 0))
        step_at = np.maximum.accumulate(np.where(step, np.arange(len(todo)), 0))
        rank[todo] = r + step_at - group_at
        k *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def _prefix_of(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int, sums: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Common prefix lengths of pairs of suffixes, up to ``limit``, by bisection over string hashes."""
    n = len(text)
    known, room = np.zeros(len(a), dtype=np.int64), np.minimum(np.minimum(n - a, n - b), limit)
    step = 1 << max(0, int(limit).bit_length() - 1)
    while step:
        ok = known + step <= room
        x, y = a[ok] + known[ok], b[ok] + known[ok]
        same = (sums[x + step] - sums[x]) * back[x] == (sums[y + step] - sums[y]) * back[y]
        known[np.flatnonzero(ok)[same]] += step
        step >>= 1
    return known.astype(np.int32)


def suffix_order(text: np.ndarray, limit: int, memory: int = MEMORY, short: int = SHORT) -> tuple[np.ndarray, np.ndarray, int]:
    """(suffix order, common prefix with the suffix before it up to ``limit``, entries written to disk)."""
    n = len(text)
    if n < 2:
        return np.arange(n), np.zeros(n, np.int32), 0
    is_s, runs = _types(text), _runs(text)
    star = is_s.copy()
    star[0] = False
    star[1:] &= ~is_s[:-1]
    stars = np.flatnonzero(star)
    if len(stars) == 0:
        order, common, spilled = _induce(text, is_s, runs, stars, np.zeros(0, np.int32), limit, memory)
        return order, common, spilled
    spilled = 0
    # hashes of all substrings: sum of mixed characters times powers, made independent of the place by the inverse power
    base, inverse = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(text.astype(np.uint64) + np.uint64(0x51)) * powers(n, base), dtype=np.uint64)])
    back = powers(n + 1, inverse)
    if len(stars) > 1:
        # order of the strings between S* positions: induce from S* in order of their first character
        seed = stars[np.argsort(text[stars], kind="stable")]
        first, _, spilled = _induce(text, is_s, runs, seed, np.zeros(len(seed), np.int32), 1, memory)
        first = first[star[first]]
        stop = np.append(stars[1:] + 1, n)  # each string ends with the first character of the next
        size = (stop - stars)[np.searchsorted(stars, first)]
        content = (sums[first + size] - sums[first]) * back[first]
        new = np.concatenate([[True], (content[1:] != content[:-1]) | (size[1:] != size[:-1])])
        names = np.empty(len(stars), dtype=np.int64)
        names[np.searchsorted(stars, first)] = np.cumsum(new)
        if new.all():
            stars = first
        elif len(names) <= short:
            stars = stars[_doubling(names)]
        else:
            order, _, more = suffix_order(names, 1, memory, short)
            stars, spilled = stars[order], spilled + more
    prefix = np.zeros(len(stars), np.int32)
    prefix[1:] = _prefix_of(text, stars[:-1], stars[1:], limit, sums, back)
    order, common, more = _induce(text, is_s, runs, stars, prefix, limit, memory)
    return order, common, spilled + more
