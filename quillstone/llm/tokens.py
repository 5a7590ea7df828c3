"""Whole texts to token ids, a distinct word at a time.

The vocabulary's rules never look across ASCII white space, so that a text's ids are the ids of its
white-space separated words, one after another. Each worker keeps the ids of the pieces of words it has met,
up to a bound, and encodes only the others, batch by batch.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPECIAL = re.compile(r"<\|startoftext\|>|<\|endoftext\|>")
#: Trailing characters that the word pattern always cuts off from letters before them, as one piece.
TAIL = ".,;:!?*$%#&|-"
KEPT_WORDS = 600_000
LONGEST_TAIL = 16
#: Letters of Latin-1 alone.
LETTERS = r"^[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+$"
SLICE = 1 << 20
#: Rows and bytes of an Arrow batch: the more texts are looked up together, the less a distinct word costs.
BATCH = (2000, 8 << 20)


def slices(text: bytes, size: int = SLICE) -> Iterator[bytes]:
    """A long text in slices that end at ASCII white space."""
    start = 0
    while len(text) - start > size:
        found = re.compile(rb"[ \t\n\x0b\x0c\r]").search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.end()
    yield text[start:] if start else text


def cores_and_tails(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each word as letters and their tail, which are pieces of their own; the letters in lower case where they are
    Latin-1. Words of another form stay whole and have no tail."""
    cores = pc.utf8_rtrim(words, TAIL)
    cut = pc.subtract(pc.binary_length(words), pc.binary_length(cores)).to_numpy()
    plain = pc.match_substring_regex(cores, LETTERS).to_numpy(zero_copy_only=False) & (cut <= LONGEST_TAIL)
    tails = np.full(len(words), "", object)
    for n in np.unique(cut[plain & (cut > 0)]).tolist():
        own = plain & (cut == n)
        tails[own] = pc.utf8_slice_codeunits(words.filter(pa.array(own)), -n).to_numpy(zero_copy_only=False)
    return pc.if_else(pa.array(plain), pc.utf8_lower(cores), words), pa.array(tails, pa.string())


def laid_out(pool: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``pool`` holds runs of the given sizes, one after another: the runs ``at`` in order, and where each ends (0 first)."""
    lengths = sizes[at]
    stops = np.concatenate(([0], np.cumsum(lengths)))
    return pool[np.repeat((np.cumsum(sizes) - sizes)[at] - stops[:-1], lengths) + np.arange(stops[-1])], stops


class WordIds:
    """Texts to ids. ``encode_all`` gives the ids of each of a batch's new pieces of words, so that an encoder may
    share work between them. Up to ``kept`` pieces are known; beyond, the half not met for longest goes."""

    def __init__(self, encode_all: Callable[[list[str]], Iterable[list[int]]], kept: int = KEPT_WORDS):
        self.encode_all, self.kept, self.batch = encode_all, kept, 0
        self.known = pa.array([""], pa.string())
        self.ids, self.sizes, self.met = np.empty(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def places(self, pieces: pa.Array) -> np.ndarray:
        """Where each of a batch's distinct pieces stands among the known ones; new ones become known."""
        self.batch += 1
        if len(self.known) > self.kept:
            stay = np.flatnonzero(self.met >= np.median(self.met))
            self.known, self.met = self.known.take(pa.array(stay)), self.met[stay]
            self.ids, stops = laid_out(self.ids, self.sizes, stay)
            self.sizes = np.diff(stops)
        at = pc.index_in(pieces, value_set=self.known)
        if at.null_count:
            new = sorted(pieces.filter(at.is_null()).to_pylist())
            made = [array("I", ids) for ids in self.encode_all(new)]
            base = len(self.known)
            self.known = pa.concat_arrays([self.known, pa.array(new, pa.string())])
            self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(made), "<u4")))
            self.sizes = np.append(self.sizes, np.fromiter(map(len, made), np.int64, len(made)))
            self.met = np.append(self.met, np.zeros(len(new), np.int64))
            later = pc.add(pc.index_in(pieces, value_set=self.known[base:]), pa.scalar(base, pa.int32()))
            at = pc.coalesce(at, later)
        at = at.to_numpy()
        self.met[at] = self.batch
        return at

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has; a null text has none.

        Each distinct piece of a batch's words is looked up once; ids are then laid out by whole arrays.
        """
        if (pc.sum(pc.binary_length(column)).as_py() or 0) > BATCH[1]:
            half = len(column) // 2
            parts = [column[:half], column[half:]] if half else [pa.array([s.decode()]) for s in slices(column[0].as_py().encode())]
            if len(parts) > 1:
                ids, sizes = map(np.concatenate, zip(*map(self.texts, parts), strict=True))
                return ids, sizes if half else sizes.sum(keepdims=True)
        split = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        coded = split.flatten().dictionary_encode()
        n = len(coded.dictionary)
        pieces = pa.concat_arrays(cores_and_tails(coded.dictionary)).dictionary_encode()
        at = self.places(pieces.dictionary)
        # A word is its core and its tail.
        pool, stops = laid_out(self.ids, self.sizes, at[pieces.indices.to_numpy().reshape(2, n).T.ravel()])
        ids, stops = laid_out(pool, np.diff(stops[::2]), coded.indices.to_numpy())
        offsets = split.offsets.to_numpy()
        return ids, np.diff(stops[offsets - offsets[0]])


def library_tokenizer(path: str, plain_specials: bool = False):
    """The tokenizers library's encoder, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = plain_specials
    return tokenizer


@functools.lru_cache(maxsize=4)
def library_ids(path: str, plain_specials: bool = False) -> WordIds:
    """One per Python worker, so that later tasks find the words of earlier ones."""
    tokenizer = library_tokenizer(path, plain_specials)

    tokenize = tokenizer.model.tokenize

    def encode(pieces: list[str]) -> Iterator[list[int]]:
        for piece in pieces:
            if plain := plain_piece(piece):  # its one piece goes straight to the vocabulary's merges
                yield [t.id for t in tokenize(plain)]
            else:
                yield tokenizer.encode(piece, add_special_tokens=False).ids

    return WordIds(encode)


def byte_character(byte: int) -> str:
    """The printable character that stands for a byte in byte-level vocabularies: itself, or the next from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return chr(byte) if byte in own else chr(256 + sum(b not in own for b in range(byte)))


CHARACTERS = {b: byte_character(b) for b in range(256)}


def plain_piece(word: str) -> str | None:
    """Lower-case letters of Latin-1 are one piece as they stand: a character for each byte; None for other words."""
    if word.isalpha() and word.islower() and max(word) < "Ā":
        return word if word.isascii() else word.encode().decode("latin-1").translate(CHARACTERS)
    return None


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file on this machine; every machine of a cluster has its own."""
    import public_tokenizers

    return public_tokenizers.path(name)
