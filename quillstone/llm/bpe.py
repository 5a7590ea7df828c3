"""BPE encoding and decoding by a depth-first walk of the trie of distinct words.

The encoding of a word is decided prefix by prefix: a prefix's last token is the one token that ends there
and may follow the last token of the prefix before it, and so each node of a trie needs only its last
token and where that began. Distinct words in sorted order are the trie's leaves in depth-first order:
going from one word to the next, the states of their shared prefix stay on the stack and are computed once.

Edges: a null text is an empty one, with no ids; white space and the vocabulary's special strings behave
as in the tokenizers library; texts of any length are cut at white space only for the memory they take.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quillstone.llm import tokens
from quillstone.llm.storage import giving_back, read, small_batches


class Bpe:
    """The merges of a vocabulary file, and encoding of many pieces at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.rank = {tuple(pair): i for i, pair in enumerate(model["merges"])}
        self.parts = {a + b: (a, b) for a, b in self.rank}
        self.strings = {i: t for t, i in self.vocab.items()}
        self.size = max(self.strings) + 1
        self.follows: dict[int, bool] = {}
        self._suffixes()

    def _suffixes(self) -> None:
        """An automaton over the vocabulary: from a state and a character to the state of the longest suffix that a
        token begins with, and for each state the tokens (with their lengths) that end there, longest first."""
        self.edges: dict[int, int] = {}
        parent, code, own = [0], [0], [0]
        by_depth: list[list[int]] = []
        for token, i in self.vocab.items():
            node, symbols = 0, self.symbols(token)
            for depth, symbol in enumerate(symbols):
                key = node << 12 | self.code(symbol)
                child = self.edges.get(key)
                if child is None:
                    child = self.edges[key] = len(parent)
                    parent.append(node)
                    code.append(key & 0xFFF)
                    own.append(-1)
                    if depth == len(by_depth):
                        by_depth.append([])
                    by_depth[depth].append(child)
                node = child
            own[node] = (i, len(symbols))
        self.fail, self.ending = [0] * len(parent), [()] * len(parent)
        for depth, nodes in enumerate(by_depth):
            for node in nodes:
                if depth:
                    self.fail[node] = self.step(self.fail[parent[node]], code[node])
                shorter = self.ending[self.fail[node]]
                self.ending[node] = (own[node], *shorter) if own[node] != -1 else shorter
        self.steps: dict[int, int] = {}

    def code(self, symbol: str) -> int:
        """A byte-level character is under 2048; with the end mark it is another symbol."""
        return ord(symbol[0]) | (2048 if self.end and len(symbol) > 1 else 0)

    def step(self, node: int, code: int) -> int:
        while (found := self.edges.get(node << 12 | code)) is None:
            if not node:
                return 0
            node = self.fail[node]
        return found

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE: merge the pair of the lowest rank, leftmost first, until none is left. For short strings."""
        while len(symbols) > 1:
            best = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            i = best[1]
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
        return symbols

    def is_reached(self, token: str) -> bool:
        return self.merged(self.symbols(token)) == [token]

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def spine(self, token: str, right: bool) -> list[tuple[str, float]]:
        """The tokens that stand at one edge while the token is built, each with the rank of the merge that uses it up."""
        out, above = [], float("inf")
        while True:
            out.append((token, above))
            pair = self.parts.get(token)
            if pair is None:
                return out[::-1]
            above, token = self.rank[pair], pair[right]

    def may_follow(self, left: str, right: str) -> bool:
        """Whether BPE of the two tokens' joined text gives just these two: no merge across the border comes first.

        A token's parts are made by merges of lower rank, so that the two edges are built in order of rank;
        at equal rank the left side's merge comes before one across the border, and that before the right side's.
        """
        a, b = self.spine(left, True), self.spine(right, False)
        i = j = 0
        while True:
            (x, x_goes), (y, y_goes) = a[i], b[j]
            across = self.rank.get((x, y))
            if across is not None and across < x_goes and across <= y_goes:
                return False
            if x_goes == y_goes == float("inf"):
                return True
            if x_goes <= y_goes:
                i += 1
            else:
                j += 1

    def fits(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow ``before``, or begin a word where that is ``size``."""
        if len(self.follows) > 1_000_000:
            self.follows.clear()
        right = self.strings[token]
        known = self.is_reached(right) if before == self.size else self.may_follow(self.strings[before], right)
        self.follows[before * self.size + token] = known
        return known

    def encode_pieces(self, pieces: list[str]) -> dict[str, list[int]]:
        """Ids of each piece (byte-level characters, no white space): the trie's walk.

        The state of a prefix is its last token, the one that ends there and may follow the last token of
        the prefix before it, and where that token starts. Longer tokens are tried first.
        """
        size, follows, steps, ending = self.size, self.follows, self.steps, self.ending
        mark = 2048 if self.end else 0
        found: dict[str, list[int]] = {}
        # Of the prefixes of the last piece, without an end mark: automaton's state, last token and its start.
        nodes, last_tokens, starts = [0], [size], [0]
        last = ""
        for piece in sorted(set(pieces)):
            n = len(piece)
            shared, most = 0, min(len(last), n - 1, len(starts) - 1)
            while shared < most and last[shared] == piece[shared]:
                shared += 1
            del nodes[shared + 1 :], last_tokens[shared + 1 :], starts[shared + 1 :]
            node = nodes[shared]
            for at in range(shared + 1, n + 1):
                key = node << 12 | ord(piece[at - 1])
                if at == n:
                    key |= mark
                node = steps.get(key)
                if node is None:
                    if len(steps) > 1_000_000:
                        steps.clear()
                    node = steps[key] = self.step(key >> 12, key & 0xFFF)
                for token, length in ending[node]:
                    start = at - length
                    pair = last_tokens[start] * size + token
                    fits = follows.get(pair)
                    if fits is None:
                        fits = self.fits(last_tokens[start], token)
                    if fits:
                        break
                else:
                    raise ValueError(f"no token for the end of {piece[:at]!r}")
                if at < n:
                    nodes.append(node)
                    last_tokens.append(token)
                    starts.append(start)
            ids = [token]
            while start:
                ids.append(last_tokens[start])
                start = starts[start]
            ids.reverse()
            found[piece] = ids
            last = piece
        return found


@functools.lru_cache(maxsize=2)
def trie_ids(path: str) -> tokens.WordIds:
    """Word encoder of this worker: the library's normalizer and word pattern, our BPE."""
    library, bpe = tokens.library_tokenizer(path), Bpe(path)
    special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
    normalize, cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str

    def pieces_of(word: str) -> list[str]:
        return [p for p, _ in cut(normalize(word))] if word else []

    def encode(words: list[str]) -> Iterator[list[int]]:
        plain = {w: p for w in words if (p := tokens.plain_piece(w))}
        split = {w: [s if s in special else pieces_of(s) for s in _around_specials(w)] for w in words if w not in plain}
        known = bpe.encode_pieces([*plain.values(), *(p for own in split.values() for s in own if isinstance(s, list) for p in s)])
        for w in words:
            if p := plain.get(w):
                yield known[p]
            else:
                yield [i for s in split[w] for i in ([special[s]] if isinstance(s, str) else [x for p in s for x in known[p]])]

    return tokens.WordIds(encode)


def _around_specials(word: str) -> list[str]:
    if "<|" not in word:
        return [word]
    out, at = [], 0
    for m in tokens.SPECIAL.finditer(word):
        out += [word[at : m.start()], m[0]]
        at = m.end()
    return [*out, word[at:]]


@functools.lru_cache(maxsize=2)
def token_strings(path: str) -> pa.Array:
    library = tokens.library_tokenizer(path)
    return pa.array([library.id_to_token(i) for i in range(library.get_vocab_size())], pa.string())


def decode_all(ids: pa.ListArray, path: str) -> pa.Array:
    """As the library's decode(ids, skip_special_tokens=False): this vocabulary has no decoder, tokens are joined by a space."""
    said = token_strings(path).take(ids.values)
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, said), " ")


def encode_decode(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Adds ``ids`` (array of int) and ``decoded``, what decoding those ids gives. Rows stay where they are: no shuffle."""
    path = path or tokens.vocabulary_path()
    schema = df.drop("ids", "decoded").schema
    kept = schema.names
    small_batches(df.sparkSession, *tokens.BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = trie_ids(path)
        for batch in batches:
            # Few long texts at a time: their ids and decoded text are made at once.
            for part in _light_parts(batch, text):
                flat, sizes = encoder.texts(part.column(part.schema.get_field_index(text)))
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat.astype(np.int32)))
                texts = decode_all(ids, path)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), ids, texts], [*kept, "ids", "decoded"])

    out = StructType([*schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])
    return df.select(*kept).mapInArrow(giving_back(run), out)


def _light_parts(batch: pa.RecordBatch, text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: each document's ids; the text gives way to them."""
    return encode_decode(docs).select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))
