"""Words and sets of word shingles as 64-bit hashes, a batch of texts at a time in NumPy.

Words are maximal runs of bytes other than separators (ASCII white space, unless told otherwise), with A-Z lower-cased. A word's hash is a polynomial
over its bytes, a shingle's a linear form over its words' hashes; both are mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from quillstone.llm.tokens import slices

_RANDOM = np.random.default_rng(11)
_BYTES = _RANDOM.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _LENGTH = (_RANDOM.integers(0, 1 << 63, 2, np.uint64) * np.uint64(2) + np.uint64(1)).tolist()
_PLACES = _RANDOM.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_LOWER = np.arange(256, dtype=np.uint8) + np.uint8(32) * ((np.arange(256) >= 65) & (np.arange(256) <= 90)).astype(np.uint8)
#: Bytes of text that are hashed at once.
AT_ONCE = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the input reaches every bit of the output."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int, known: list = [np.ones(1, np.uint64)]) -> np.ndarray:  # noqa: B006  grows with the longest word met
    if len(known[0]) < n:
        bases = np.full(2 * n + 1, _BASE, np.uint64)
        bases[0] = 1
        known[0] = np.multiply.accumulate(bases)
    return known[0]


def _words(text: bytes, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``text`` and where they start."""
    raw = np.frombuffer(text, np.uint8)
    space = separators[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    first = np.cumsum(sizes) - sizes
    at = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
    h = np.add.reduceat(_BYTES[_LOWER[raw[~space]]] * _powers(int(sizes.max()))[at], first)
    return mixed(h + sizes.astype(np.uint64) * np.uint64(_LENGTH)), starts


def _pieces(texts: Iterable[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts, long ones in slices that end at white space, gathered to about AT_ONCE bytes."""
    owners, held, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in slices(text, AT_ONCE):
            owners.append(i)
            held.append(piece)
            size += len(piece)
            if size >= AT_ONCE:
                yield owners, held
                owners, held, size = [], [], 0
    if held:
        yield owners, held


def hashed_words(texts: list[str | None], separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, one after another, and where each text's begin (and the last one's end).

    ``separators`` says of each byte whether it is one; white space must be among them.
    """
    hashes, owners = [], []
    for who, pieces in _pieces((t or "").encode("utf-8") for t in texts):
        h, starts = _words(b"\n".join(pieces), separators)
        ends = np.cumsum([len(p) + 1 for p in pieces])
        hashes.append(h)
        owners.append(np.array(who)[np.searchsorted(ends, starts, "right")] if len(h) else np.zeros(0, np.int64))
    h, owner = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.uint64), (owners, np.int64)))
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; with fewer words than a shingle, of all the words as one; of a null or blank text none."""
    h, bounds = hashed_words(texts)
    run = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for j in range(words):
        run += h[j : j + len(run)] * _PLACES[j]
    run = mixed(run)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if 0 < b - a < words:
            short = (h[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mixed(np.array([short], np.uint64)))
        else:
            out.append(np.unique(run[a : max(a, b - words + 1)]))
    return out
