"""Induced suffix sorting in numpy.

Suffixes of type L and S are induced from the sorted LMS suffixes through one queue for each first
character: what enters a queue does so in the order of its rest, so queues are read front to back,
a whole batch at a time. Equal names of LMS substrings are told apart by doubling ranks on the
reduced string, as far as `depth` characters need it.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 18  # neighbours compared at once


class _Queues:
    """A queue of positions for each character."""

    def __init__(self, text: np.ndarray, size: int):
        self.text, self.parts = text, [[] for _ in range(size)]

    def push(self, at: np.ndarray) -> None:
        if not len(at):
            return
        keys = self.text[at]
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        for lo, hi in zip(heads, [*heads[1:], len(at)]):
            self.parts[keys[lo]].append(at[lo:hi])

    def take(self, c: int) -> np.ndarray:
        parts, self.parts[c] = self.parts[c], []
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one (type S); the last one is."""
    small = np.append(text[:-1] < text[1:], True)
    equal = np.flatnonzero(text[:-1] == text[1:])
    last = np.flatnonzero(np.append(np.diff(equal) > 1, True)[: len(equal)])
    small[equal] = np.repeat(small[equal[last] + 1], np.diff(last, prepend=-1))
    return small


def _run_places(text: np.ndarray) -> np.ndarray:
    """How many equal characters stand right before each place, in as few bytes as hold the most."""
    at = np.arange(len(text), dtype=np.int32)
    start = at.copy()
    start[1:][text[1:] == text[:-1]] = 0
    np.maximum.accumulate(start, out=start)
    at -= start
    return at.astype(np.min_scalar_type(at.max()))


def _down_runs(batch: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """batch, then the suffixes one place before each within its run of equal characters, then two before, and so on; and the run starts in that order."""
    r = run[batch].astype(np.int32)
    longest = int(r.max()) if len(r) else 0
    if not longest:
        return batch, batch
    total = np.cumsum(r)
    step = np.arange(1, total[-1] + 1) - np.repeat(total - r, r)
    more = np.repeat(batch, r) - step
    done = np.concatenate([batch, more[np.argsort(step, kind="stable")]]).astype(np.int32)
    return done, (batch - r)[np.argsort(r, kind="stable")].astype(np.int32)


def _induce(text: np.ndarray, small: np.ndarray, run: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """All suffixes, in the order that seeds (LMS suffixes, by first character at least) give them."""
    cuts = np.searchsorted(text[seeds], np.arange(size + 1))
    queues, large = _Queues(text, size), []
    for c in range(size):
        done, starts = _down_runs(queues.take(c), run)
        large.append(done)
        before = starts[starts > 0] - 1
        queues.push(before[~small[before]])
        own = seeds[cuts[c] : cuts[c + 1]]
        queues.push(own[own > 0] - 1)
    order, end = np.empty(len(text), np.int32), len(text)
    for c in range(size - 1, -1, -1):
        done, starts = _down_runs(queues.take(c), run)
        before = starts[starts > 0] - 1
        queues.push(before[small[before]])
        back = large.pop()[::-1]
        for part in (done, back):
            order[end - len(part) : end] = part[::-1]
            end -= len(part)
        before = back[back > 0] - 1
        queues.push(before[small[before]])
    order[0] = len(text) - 1
    return order


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of text (uint16, ending in its only 0) ordered by their first depth characters at least."""
    n, size = len(text), int(text.max()) + 1
    if n == 1:
        return np.zeros(1, np.int32)
    small, run = _types(text), _run_places(text)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    rough = lms[np.argsort(text[lms], kind="stable")]
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sorted_lms = _induce(text, small, run, rough, size)
    sorted_lms = sorted_lms[is_lms[sorted_lms]]
    del rough, is_lms
    place = np.zeros(n, np.int32)
    place[lms] = np.arange(len(lms), dtype=np.int32)
    length = (np.diff(lms, append=lms[-1]) + 1).astype(np.int32)[place[sorted_lms]]
    equal = np.concatenate([[False], length[1:] == length[:-1]])
    for lo in range(0, len(equal), BLOCK):
        live, k = lo + np.flatnonzero(equal[lo : lo + BLOCK]), 0
        while len(live):
            same = text[sorted_lms[live] + k] == text[sorted_lms[live - 1] + k]
            equal[live[~same]] = False
            k += 1
            live = live[same]
            live = live[length[live] > k]
    rank = np.empty(len(lms), np.int64)
    rank[place[sorted_lms]] = np.cumsum(~equal)
    del sorted_lms, place, length, equal, live
    step = 1
    while rank.max() < len(rank) and 2 * step < depth + 2:
        after = np.zeros_like(rank)
        after[:-step] = rank[step:]
        after += rank * (len(rank) + 1)
        order = np.argsort(after, kind="stable")
        after = after[order]
        rank[order] = np.cumsum(np.append(True, after[1:] != after[:-1]))
        step *= 2
    seeds = lms[np.argsort(rank, kind="stable")]
    del lms, rank
    return _induce(text, small, run, seeds, size)


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number."""
    return np.ndarray((len(data) - 7,), np.dtype("<u8"), np.ascontiguousarray(data), strides=(1,))


def equal_groups(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of places starts, ordered so that those where equal strings of `length` bytes begin are neighbours; and whether each begins the same as the one before.

    data holds pieces that end at bounds; each string lies in one piece. length is a multiple of 8.
    """
    text = np.zeros(len(data) + len(bounds) + 1, np.uint16)
    inside = np.ones(len(text), bool)
    inside[bounds + np.arange(len(bounds))] = inside[-1] = False
    text[inside] = data
    text[inside] += 2
    text[:-1][~inside[:-1]] = 1
    del inside
    order = suffix_order(text, length)
    wanted = np.full(len(text), -1, np.int32)
    del text
    wanted[starts + np.searchsorted(bounds, starts, side="right")] = np.arange(len(starts), dtype=np.int32)
    order = wanted[order]
    del wanted
    order = order[order >= 0]
    same, words = np.zeros(len(order), bool), words_at(data)
    for lo in range(1, len(order), BLOCK):
        live = np.arange(lo, min(lo + BLOCK, len(order)))
        at = starts[order[lo - 1 : live[-1] + 1]]
        for k in range(0, length, 8):
            live = live[words[at[live - lo + 1] + k] == words[at[live - lo] + k]]
        same[live] = True
    return order, same
