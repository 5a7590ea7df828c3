"""Suffix-array dedup: removal of every byte covered by a 200-byte string that also starts elsewhere.

1. Anchors. Every 200-byte window names the place of its smallest 32-byte hash, leftmost first. Equal
   windows name equal places, so that they can meet only under equal anchor hashes. The windows of one
   anchor make up a snippet of 200 to about 370 bytes.
2. Counting. Snippets that occur twice or more, or whose document does, are repeated as a whole. Anchors
   that stand in one snippet alone repeat nothing. Both are settled by counting hashes, without texts.
3. Sorting. Only what is left, distinct snippets under one anchor hash, is dealt to shards by that hash,
   and each shard's suffixes are sorted by external induced sorting (``induced_sort``), which finds the
   windows that stand twice. An anchor hash with more snippets than a shard should hold (a frequent line of 32
   to 199 bytes among ever different text) is not sorted in one task: hashes of its windows are counted.

Keys that many rows share are dealt to several tasks: rows of a hash or text with over an eighth of a task's
fair share get a number of salts, and what they are joined with is repeated for each.

Matches never cross documents. Texts are taken whole; a null text is an empty one.

Edges: texts under 200 bytes lose nothing; repeated rows repeat each other; a text with equal windows of
its own loses them; empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.induced_sort import repeated_places
from quillstone.llm.storage import cut, giving_back, read, small_batches, stage

LENGTH, KMER, PIECE = 200, 32, 1 << 19
SHARD_BYTES, LEAST_HOT = 32 << 20, 500
ANCHORS = "k1 bigint, k2 bigint, n_bytes bigint, hashes array<bigint>, snippets array<bigint>, starts array<int>, sizes array<int>"
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _MIX = np.array([0xD6E8FEB86659FD93], np.uint64), np.uint64(0x9E3779B97F4A7C15)


def text_keys(text: Column) -> list[Column]:
    """128 bits of hashes that stand for a text in joins."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("text"), text).alias("k2")]


def _kmer_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k bytes (k a power of two), by doubling."""
    h, factor, size = _BYTES[data], _A, 1
    while size < k:
        h = h[:-size] * factor + h[size:]
        factor, size = np.multiply(factor, factor), 2 * size
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` keys in a row."""
    out, size = keys, 1
    while 2 * size <= width:
        out, size = np.minimum(out[:-size], out[size:]), 2 * size
    return np.minimum(out[: len(keys) - width + 1], out[width - size : len(keys) - size + 1]) if width > size else out


def anchors_of(data: bytes, length: int = LENGTH, kmer: int = KMER) -> tuple[list[np.ndarray], list[int]]:
    """(anchor hashes, starts, sizes) and hashes of a text's snippets. Long texts go piece by piece."""
    hashes, starts, sizes, snippets = [], [], [], []
    view = memoryview(data)
    for base in range(0, len(data) - length + 1, PIECE):
        part = np.frombuffer(view[base : base + PIECE + length - 1], np.uint8)
        h = _kmer_hashes(part, kmer)
        # The place sits in the low bits, so that of equal hashes the leftmost wins.
        low = np.uint64(21)
        least = _least((h >> low << low) | np.arange(len(h), dtype=np.uint64), length - kmer + 1)
        anchor = (least & np.uint64((1 << 21) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        last = np.append(first[1:], len(anchor)) - 1
        hashes.append(h[anchor[first]].view(np.int64))
        starts.append(first + base)
        sizes.append(last - first + length)
        snippets += [xxhash.xxh3_64_intdigest(view[a : a + n]) for a, n in zip((first + base).tolist(), sizes[-1].tolist(), strict=True)]
    return [np.concatenate(x) if x else np.empty(0, np.int64) for x in (hashes, starts, sizes)], snippets


def anchor_table(docs: DataFrame, text: str, length: int = LENGTH) -> DataFrame:
    """A row per document; anchors are given where its task first meets the text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for i, t in enumerate(batch.column(2)):
                data = (t.as_py() or "").encode("utf-8")
                key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                new = key not in seen and len(data) >= length
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(key)
                (h, s, n), snippets = anchors_of(data, length) if new else ([np.empty(0, np.int64)] * 3, [])
                for out, x in zip(columns, (len(data), h, np.array(snippets, np.uint64).view(np.int64), s.astype(np.int32), n.astype(np.int32)), strict=True):
                    out.append(x)
            sizes, *arrays = columns
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *map(_lists, arrays)], ["k1", "k2", "n_bytes", "hashes", "snippets", "starts", "sizes"])

    return docs.select(*text_keys(F.col(text)), text).mapInArrow(giving_back(run), ANCHORS)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


def sort_shards(snippets: DataFrame, shards: int, length: int = LENGTH) -> DataFrame:
    """(k1, k2, start, stop) of the stretches of ``snippets`` (hash, snippet, k1, k2, start, bytes) that stand twice.

    Each shard of whole anchor hashes is one text of closed strings for the external suffix sort.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, places, rows = tempfile.TemporaryFile(), [0], []  # of this task alone, gone with it
        for batch in batches:
            rows.append(batch.select(["k1", "k2", "start"]))
            for piece in batch.column(batch.schema.get_field_index("bytes")):
                # No UTF-8 text holds the byte 255: all others become 1 and more, and 0 closes a string.
                file.write((np.frombuffer(piece.as_buffer(), np.uint8) + np.uint8(1)).tobytes() + b"\0")
                places.append(places[-1] + len(piece.as_buffer()) + 1)
        if not rows:
            return
        file.flush()
        text = np.memmap(file, np.uint8, "r", shape=(places[-1],))
        again = repeated_places(text, length)
        edge = np.diff(np.concatenate(([0], again.view(np.int8), [0])))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        owner = np.searchsorted(places, begin, side="right") - 1
        table = pa.Table.from_batches(rows).combine_chunks()
        base = np.array(places)[owner]
        start = table.column("start").to_numpy()[owner] + begin - base
        stop = table.column("start").to_numpy()[owner] + end - base + length - 1
        for k in range(0, len(owner), 100_000):
            own = slice(k, k + 100_000)
            keys = [pa.array(table.column(c).to_numpy()[owner[own]], pa.int64()) for c in ("k1", "k2")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(start[own], pa.int64()), pa.array(stop[own], pa.int64())], ["k1", "k2", "start", "stop"])

    # Copies of a text may each have given a place: one is kept. Rows of a hash are in one partition already.
    single = snippets.repartition(shards, "hash").dropDuplicates(["hash", "k1", "k2", "start"])
    return single.select("k1", "k2", "start", "bytes").mapInArrow(giving_back(run), "k1 bigint, k2 bigint, start bigint, stop bigint")


def window_hashes(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A hash of each ``length`` bytes: of the two runs, the greatest of a power of two, that cover them."""
    k = 1 << (length.bit_length() - 1)
    h = _kmer_hashes(data, k)
    both = h[: len(data) - length + 1] * _MIX + h[length - k :]
    return (both ^ (both >> np.uint64(31))) * _A


def counted_windows(snippets: DataFrame, length: int = LENGTH, salts: int = 16) -> DataFrame:
    """(k1, k2, start, stop) of the windows of ``snippets`` (k1, k2, start, bytes) that stand twice, by counting."""
    small_batches(snippets.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [window_hashes(np.frombuffer(x.as_buffer(), np.uint8), length).view(np.int64) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), _lists(hashes)], ["k1", "k2", "start", "windows"])

    single = snippets.select("k1", "k2", "start", "bytes").dropDuplicates(["k1", "k2", "start"])
    made = single.mapInArrow(giving_back(run), "k1 bigint, k2 bigint, start bigint, windows array<bigint>")
    rows = made.select("k1", "k2", "start", F.posexplode("windows").alias("i", "w")).select("k1", "k2", (F.col("start") + F.col("i")).alias("start"), "w")
    rows = stage(rows, "windows")
    twice = rows.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("k1", "k2", "start"), F.lit(salts)).cast("int"))
    return dealt.join(twice, ["w", "salt"], "left_semi").select("k1", "k2", "start", (F.col("start") + length).alias("stop"))


def hot_bound(counts: DataFrame, parts: int) -> int:
    """An eighth of a task's fair share of the rows that ``counts`` (column n) counts."""
    return max(LEAST_HOT, (counts.agg(F.sum("n")).first()[0] or 0) // (8 * parts))


def hot_keys(counts: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``keys`` and ``salts`` of the rows of ``counts`` (keys, n) with n over a hot_bound: 8 * parts of them at the most."""
    return counts.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("salts"))


def salted(rows: DataFrame, hot: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """``rows`` with ``salt``, from the columns ``by`` for hot keys and else 0. The hot keys are few: see hot_keys."""
    marked = rows.join(F.broadcast(hot), keys, "left")
    return marked.withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64(*by), F.col("salts"))).otherwise(0).cast("int")).drop("salts")


def repeated_for(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` once for each salt of their keys."""
    marked = rows.join(F.broadcast(hot), keys, "left")
    return marked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """k1, k2 (see text_keys) and ``spans``: overlapping stretches, unmerged, of each text that has any; and hot texts."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    anchors = stage(anchor_table(docs, text, length), "anchors")
    texts = stage(anchors.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.first("n_bytes").alias("stop")).where("n > 1"), "texts")
    whole = texts.where(F.col("stop") >= length).select("k1", "k2", F.lit(0).cast("long").alias("start"), "stop")

    place = F.explode(F.arrays_zip("hashes", "snippets", "starts", "sizes")).alias("a")
    rows = anchors.select("k1", "k2", place).select("k1", "k2", F.col("a.hashes").alias("hash"), F.col("a.snippets").alias("snippet"), F.col("a.starts").cast("long").alias("start"), F.col("a.sizes").alias("size"))
    # Most anchor hashes stand once: only rows of the others go on.
    again = stage(rows.select("hash").groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "again")
    most = hot_bound(again, parts)
    hot = hot_keys(again, ["hash"], most)
    met = salted(rows, hot, ["hash"], ["k1", "k2", "start"]).join(repeated_for(again, hot, ["hash"]), ["hash", "salt"])
    met = stage(met, "met")  # n: the rows of the hash
    # Per snippet of an anchor hash its number and one place; per anchor hash the number of its snippets.
    each = met.groupBy("hash", "snippet").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "start", "size")).alias("one"))
    kinds = met.groupBy("hash").agg((F.min("snippet") < F.max("snippet")).alias("mixed")).where("mixed").select("hash")

    often = each.where("n > 1").select("hash", "snippet")
    covered = met.join(repeated_for(often, hot, ["hash"]), ["hash", "snippet", "salt"], "left_semi")
    covered = covered.select("k1", "k2", "start", (F.col("start") + F.col("size")).alias("stop"))

    # Only hot hashes can have very many snippets. They are known by their rows' number, without a join.
    crowds = met.where(F.col("n") > most).select("hash", "snippet").distinct().groupBy("hash").agg(F.count("*").alias("n"))
    crowded = cut(hot_keys(crowds, ["hash"], most))
    mixed = salted(each.select("hash", "snippet", "one.*"), crowded, ["hash"], ["snippet"]).join(repeated_for(kinds, crowded, ["hash"]), ["hash", "salt"])
    mixed = mixed.join(F.broadcast(crowded), "hash", "left").select("hash", "k1", "k2", "start", "size", F.col("salts").isNotNull().alias("crowded"))
    mixed = stage(mixed, "mixed")
    total = mixed.where("not crowded").agg(F.sum("size")).first()[0] or 0
    shards = max(parts, -(-total // SHARD_BYTES))
    hot_texts = hot_keys(texts, ["k1", "k2"], hot_bound(texts, parts))
    key = ["k1", "k2", "salt"]
    keyed = docs.select(*text_keys(F.col(text)), F.col(text).cast("binary").alias("b"), F.monotonically_increasing_id().alias("row"))
    keyed = salted(keyed, hot_texts, ["k1", "k2"], ["row"])

    def with_bytes(places: DataFrame) -> DataFrame:
        # Of a text's copies one goes on from each task.
        places = repeated_for(places, hot_texts, ["k1", "k2"])
        own = keyed.join(places.select(*key).distinct(), key, "left_semi").select(*key, "b").dropDuplicates(key)
        return places.join(own, key).withColumn("bytes", F.substring(F.col("b"), F.col("start").cast("int") + 1, F.col("size"))).drop("b")

    found = sort_shards(with_bytes(mixed.where("not crowded")), shards, length)
    if not crowded.isEmpty():
        found = found.unionByName(counted_windows(with_bytes(mixed.where("crowded")), length))

    spans = whole.unionByName(covered).unionByName(found)
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), hot_texts


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, whole_characters: bool = False) -> DataFrame:
    """Adds ``spans`` (the maximal removed stretches of bytes) and ``kept`` (the other bytes, joined).

    With ``whole_characters``, a stretch is narrowed to the characters that lie in it entirely.
    """
    fields = docs.drop("spans", "kept").columns
    spans, hot = repeated_spans(docs, text, length)
    keyed = docs.select(F.struct(*fields).alias("doc"), *text_keys(F.col(text)), F.monotonically_increasing_id().alias("row"))
    found = salted(keyed, hot, ["k1", "k2"], ["row"]).join(repeated_for(spans, hot, ["k1", "k2"]), ["k1", "k2", "salt"], "left").select("doc", "spans")
    at = fields.index(text)
    small_batches(docs.sparkSession)

    def merged(spans: list[dict], data: bytes) -> list[tuple[int, int]]:
        out: list[list[int]] = []
        for s in sorted((x["start"], x["stop"]) for x in spans):
            if out and s[0] <= out[-1][1]:
                out[-1][1] = max(out[-1][1], s[1])
            else:
                out.append(list(s))
        if whole_characters:
            for s in out:
                while s[0] < s[1] and data[s[0]] & 0xC0 == 0x80:
                    s[0] += 1
                while s[0] < s[1] < len(data) and data[s[1]] & 0xC0 == 0x80:
                    s[1] -= 1
        return [(a, b) for a, b in out if a < b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_spans, kept = [], []
            doc = batch.column(0)
            for t, s in zip(doc.field(at), batch.column(1), strict=True):
                data = (t.as_py() or "").encode("utf-8")
                own = merged(s.as_py(), data) if s.is_valid else []
                all_spans.append([{"start": a, "stop": b} for a, b in own])
                ends = [0, *(b for _, b in own)]
                kept.append(b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in own), len(data)], strict=True)) if own else data)
            span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
            yield pa.RecordBatch.from_arrays([*(doc.field(i) for i in range(len(fields))), pa.array(all_spans, pa.list_(span)), pa.array(kept, pa.binary())], [*fields, "spans", "kept"])

    out = docs.select(*fields, F.lit(None).cast("array<struct<start:bigint,stop:bigint>>").alias("spans"), F.lit(None).cast("binary").alias("kept")).schema
    return found.mapInArrow(giving_back(run), out)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without repeated passages, cut at whole characters; n_chars follows the text. No row goes."""
    found = remove_repeats(docs, whole_characters=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept").cast("string"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)
