"""Suffix sorting of a shard by external induced sorting.

The S* suffixes of a text (those at a left-most S-type place) are sorted first. Their substrings up to the
next S* place are named in order, and names of ever longer stretches are made from pairs of names,
recursively, until they reach as far as matches are long. All other suffixes are induced from the S*
suffix that follows them: suffix tuples carry the group of their S* suffix by common-prefix length and the
characters before it, a character further at each step.

Every sort goes through a priority queue that spills sorted runs to disk and hands tuples back in order,
range by range, so that a shard may be far larger than memory; long arrays are mapped files.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import xxhash

MEMORY_ROWS = 4_000_000


def scratch(n: int, dtype, memory_rows: int = MEMORY_ROWS) -> np.ndarray:
    """A zeroed array; above the bound it lies in an unnamed temporary file that goes with it."""
    if n <= memory_rows:
        return np.zeros(n, dtype)
    return np.memmap(tempfile.TemporaryFile(), dtype=dtype, shape=n, mode="w+")


class DiskPriorityQueue:
    """(key, tag) tuples in, the same in ascending order out. At most ``memory_rows`` of them are in memory."""

    def __init__(self, memory_rows: int = MEMORY_ROWS):
        self.memory_rows, self.blocks, self.held, self.runs = memory_rows, [], 0, []

    def push(self, keys: np.ndarray, tags: np.ndarray) -> None:
        self.blocks.append((keys.astype(np.uint64), tags.astype(np.int64)))
        self.held += len(keys)
        if self.held > self.memory_rows // 2:
            self._spill()

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([b[0] for b in self.blocks]) if self.blocks else np.empty(0, np.uint64)
        tags = np.concatenate([b[1] for b in self.blocks]) if self.blocks else np.empty(0, np.int64)
        self.blocks, self.held = [], 0
        order = np.argsort(keys, kind="stable")
        return keys[order], tags[order]

    def _spill(self) -> None:
        keys, tags = self._sorted()
        run = (scratch(len(keys), np.uint64, 0), scratch(len(tags), np.int64, 0))
        run[0][:], run[1][:] = keys, tags
        self.runs.append(run)

    def pop_all(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks in ascending order of keys; a key's tuples are all in one block."""
        if not self.runs:
            yield self._sorted()
            return
        if self.held:
            self._spill()
        # Splitters from every run's quantiles bound what one range holds.
        ranges = max(1, 4 * sum(len(k) for k, _ in self.runs) // self.memory_rows)
        sample = np.sort(np.concatenate([k[:: max(1, len(k) // (8 * ranges))] for k, _ in self.runs]))
        splits = np.unique(sample[:: max(1, len(sample) // ranges)])[1:]
        at = [0] * len(self.runs)
        for split in [*splits, None]:
            ends = [len(k) if split is None else int(np.searchsorted(k, split)) for k, _ in self.runs]
            keys = np.concatenate([k[a:b] for (k, _), a, b in zip(self.runs, at, ends, strict=True)])
            tags = np.concatenate([t[a:b] for (_, t), a, b in zip(self.runs, at, ends, strict=True)])
            at = ends
            if len(keys):
                order = np.argsort(keys, kind="stable")
                yield keys[order], tags[order]
        self.runs = []


def dense_ranks(keys: np.ndarray, memory_rows: int = MEMORY_ROWS) -> tuple[np.ndarray, int]:
    """Each key's place among the distinct keys, from 0, and the number of distinct keys."""
    queue, out, rank = DiskPriorityQueue(memory_rows), scratch(len(keys), np.int64, memory_rows), 0
    step = max(1, memory_rows // 4)
    for start in range(0, len(keys), step):
        queue.push(np.asarray(keys[start : start + step]), np.arange(start, min(len(keys), start + step)))
    for block, tags in queue.pop_all():
        if len(block):
            new = np.cumsum(np.concatenate(([0], block[1:] != block[:-1])))
            out[tags] = new + rank
            rank += int(new[-1]) + 1
    return out, rank


def pair_ranks(first: np.ndarray, second: np.ndarray, second_max: int, memory_rows: int) -> tuple[np.ndarray, int]:
    return dense_ranks(first.astype(np.uint64) * np.uint64(second_max + 1) + second.astype(np.uint64), memory_rows)


def s_star(text: np.ndarray, memory_rows: int = MEMORY_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Places whose suffix is smaller than the next place's, but not the place before; ends of strings (0) count.

    Also how many characters after each place must be seen to tell that it is one. Block by block from the end,
    so that arrays over all characters are never in memory.
    """
    n, found, seen = len(text), [], []
    step = max(2, memory_rows)
    later, rising, first_is_s = n - 1, False, False  # the next place where the text changes, how, and the type of the place after the block
    for start in range((n - 1) // step * step, -1, -step) if n else ():
        stop = min(n, start + step)
        own = np.asarray(text[start : stop + 1]).astype(np.int16)
        change = np.sign(np.diff(own)).astype(np.int8)
        if stop == n:
            change = np.append(change, np.int8(-1))
        where = np.where(change != 0, np.arange(len(change)), len(change))
        following = np.minimum.accumulate(where[::-1])[::-1]
        inside = following < len(change)
        is_s = np.where(inside, change[np.minimum(following, len(change) - 1)] > 0, rising)
        far = np.where(inside, following + start, later)
        star = own[: len(change)] == 0
        star[1:] |= is_s[1:] & ~is_s[:-1]
        if found and first_is_s and not is_s[-1] and not found[-1][1]:  # the first place of the block after this one
            found.append((np.array([stop]), True))
            seen.append(np.array([first_far + 1 - stop]))
        places = np.flatnonzero(star)
        found.append((places + start, bool(star[0])))
        seen.append(far[places] + 1 - (places + start))
        later, rising, first_is_s, first_far = int(far[0]), bool(is_s[0]), bool(is_s[0]), int(far[0])
    join = lambda parts: np.concatenate([np.empty(0, np.int64), *parts[::-1]]).astype(np.int64)
    return join([p for p, _ in found]), join(seen)


def _names(text: np.ndarray, places: np.ndarray, ends: np.ndarray, memory_rows: int) -> tuple[np.ndarray, int]:
    """Names, in lexicographic order, of text[places[i] : ends[i]]: eight characters (below 255) at a time, those still tied go on."""
    padded = np.concatenate((text, np.zeros(8, text.dtype)))

    def packed(at: np.ndarray, upto: np.ndarray) -> np.ndarray:
        key = np.zeros(len(at), np.uint64)
        for i in range(8):
            c = np.where(at + i < upto, padded[np.minimum(at + i, len(padded) - 1)], 255)
            key = (key << np.uint64(8)) | c.astype(np.uint64)
        return key

    rank, count = dense_ranks(packed(places, ends), memory_rows)
    depth = 8
    while True:
        active = np.flatnonzero(places + depth < ends)
        if not len(active):
            return rank, count
        # Longer substrings refine their rank. One that another goes on from sorts after it: its last place
        # is of S-type, the other's is not, and the smaller suffix is that of the L-type place.
        rest_rank, rest_count = dense_ranks(packed(places[active] + depth, ends[active]), memory_rows)
        rest = np.full(len(rank), rest_count)
        rest[active] = rest_rank
        rank, count = pair_ranks(rank, rest, rest_count, memory_rows)
        depth += 8


def sorted_s_star(text: np.ndarray, length: int, memory_rows: int = MEMORY_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """S* places in text order, their order by suffix up to ``length`` characters, and the common prefix of neighbours.

    The common prefix of an entry is that with the entry before it in the order, exact up to ``length``.
    """
    places, _ = s_star(text, memory_rows)
    nxt = np.append(places[1:], len(text))
    closed = text[places] == 0
    # A string's end is a substring of its own: nothing is read across it.
    rank, count = _names(text, places, np.where(closed, places + 1, nxt + 1), memory_rows)
    levels = [rank]
    m = len(places)
    until_end = scratch(m, np.int64, memory_rows)  # S* places up to the string's end, itself included
    stops = np.flatnonzero(closed)
    until_end[:] = stops[np.searchsorted(stops, np.arange(m))] - np.arange(m) + 1
    jump = 1
    while count < m:
        far = np.minimum(np.arange(m) + jump, m - 1)
        covered = (places[far] - places >= length) | (until_end <= jump)
        if covered.all():
            break
        after = np.where(until_end > jump, rank[far] + 1, 0)
        rank, count = pair_ranks(rank, after, count + 1, memory_rows)
        levels.append(rank)
        jump *= 2
    queue, order, at = DiskPriorityQueue(memory_rows), scratch(m, np.int64, memory_rows), 0
    queue.push(rank, np.arange(m))
    for _, tags in queue.pop_all():
        order[at : at + len(tags)] = tags
        at += len(tags)
    common = scratch(m, np.int64, memory_rows)
    step = max(1, memory_rows // 4)
    for start in range(1, m, step):
        common[start : start + step] = _common(text, places, levels, until_end, order[start - 1 : min(m, start + step) - 1], order[start : start + step], length)
    return places, order, common


def _common(text, places, levels, until_end, a, b, length) -> np.ndarray:
    """Characters that the suffixes at S* numbers a and b share, found from the longest names down, then by character."""
    a, b = a.copy(), b.copy()
    found = np.zeros(len(a), np.int64)
    m = len(places)
    going = np.ones(len(a), bool)  # neither has passed its string's end
    for level in range(len(levels) - 1, -1, -1):
        while True:
            same = going & (found < length) & (levels[level][np.minimum(a, m - 1)] == levels[level][np.minimum(b, m - 1)])
            # A name that takes in its string's end is not passed over: characters decide there.
            same &= (until_end[np.minimum(a, m - 1)] > 1 << level) & (until_end[np.minimum(b, m - 1)] > 1 << level)
            if not same.any():
                break
            found[same] += places[a[same] + (1 << level)] - places[a[same]]
            a[same] += 1 << level
            b[same] += 1 << level
    more = np.flatnonzero(found < length)
    x, y = places[a[more]], places[b[more]]
    while len(more):
        same = (text[x] == text[y]) & (text[x] != 0) & (found[more] < length)
        more, x, y = more[same], x[same] + 1, y[same] + 1
        found[more] += 1
    return np.minimum(found, length)


def repeated_places(text: np.ndarray, length: int, memory_rows: int = MEMORY_ROWS) -> np.ndarray:
    """For each place of ``text`` (strings of characters 1-254, each closed by a 0): whether the ``length``
    characters from there lie in one string and stand at another place too."""
    n = len(text)
    out = np.zeros(n, bool)
    if not n:
        return out
    places, order, common = sorted_s_star(text, length, memory_rows)
    _, seen_after = s_star(text, memory_rows)
    # Up to which distance before it a window of ``length`` shows the S* place to be one. Windows that show
    # none (almost all of one character) are not induced but compared as they are.
    shown = np.where(text[places] == 0, -1, length - 1 - seen_after)[order]
    at = places[order]
    # A suffix is induced by the next S* place after its own start: whether it starts at one depends on the
    # character before it. So each S* place induces all down to the one before, unless that ends a string.
    earlier = np.concatenate(([-1], places[:-1]))
    reach = (places - earlier - ((earlier < 0) | (text[earlier] == 0)))[order]
    stops = np.flatnonzero(text == 0)
    room = (stops[np.searchsorted(stops, places)] - places)[order]  # characters left in its string
    before = np.zeros(len(at), np.int64)  # name of the characters induced so far
    names, d, plain = 1, 0, []
    while d < length:
        d += 1
        stay = np.flatnonzero((reach >= d) & (room + reach >= length))
        if not len(stay):
            break
        # The common prefix of two that stay neighbours is the least between them.
        common = np.minimum.reduceat(common[: stay[-1] + 1], np.concatenate(([0], stay[:-1] + 1)))
        at, reach, room, shown = at[stay], reach[stay], room[stay], shown[stay]
        before, names = pair_ranks(before[stay], text[at - d], 256, memory_rows)
        # Suffixes at distance d before their S* suffix: equal if that agrees on the rest and the d characters are equal.
        group = np.cumsum(common < length - d)
        key = group.astype(np.uint64) * np.uint64(names) + before.astype(np.uint64)
        fits = room + d >= length
        plain.append((at - d)[fits & (d > shown)])
        fits &= d <= shown
        ranks, count = dense_ranks(key[fits], memory_rows)
        often = np.bincount(ranks, minlength=count) > 1
        out[at[fits][often[ranks]] - d] = True
    else:
        for s, g, r in zip(at.tolist(), reach.tolist(), room.tolist(), strict=True):
            plain.append(s - np.arange(max(d + 1, length - r), g + 1))
    rest = np.concatenate([np.empty(0, np.int64), *plain])
    data = memoryview(np.ascontiguousarray(text)).cast("B")
    digests = np.fromiter((xxhash.xxh3_64_intdigest(data[i : i + length]) for i in rest.tolist()), np.uint64, len(rest))
    ranks, count = dense_ranks(digests, memory_rows)
    out[rest[(np.bincount(ranks, minlength=count) > 1)[ranks]]] = True
    return out
