"""Token ids in a content-addressed store.

A rolling hash over the ids cuts each document's stream into chunks at places that depend on the ids
alone, so that equal passages give equal chunks. A store is a folder with three Parquet tables:

* ``chunks``: one row per distinct chunk, named by the SHA-256 of its bytes (ids as little-endian
  unsigned integers of two bytes while the vocabulary allows, else four);
* ``recipes``: one row per document in ascending doc_id order, with the names of its chunks, where
  each ends, and the root of the Merkle tree over them;
* ``manifest``: the Merkle trees above: a part's leaves are its recipes in order (id, number of ids and
  root), the store's leaves are its parts. Every node above the leaves has a row, with the numbers of
  documents and ids below it; the last one is the store's root.

Reading recomputes chunk names from the bytes, roots from the names and the nodes from the recipes, and
fails where they differ: a changed chunk, name, id, count or order, and a missing or added recipe or part.

Edges: a null text is an empty one, whose only id is the end id; repeated rows have a recipe each and
share chunks; an empty table gives an empty store that reads back as no rows; extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm import tokens
from quillstone.llm.storage import read, shared_dir, small_batches, stage

END_ID = 1
WINDOW, MASK, MOST = 8, 0x1FF, 4096
FACTOR = np.uint64(0x9E3779B97F4A7C15)
FAN, LEVELS = 256, 4  # children of a tree's node, and levels: enough for 2 ** 32 leaves
STORE = (1 << 31) - 1  # stands for the store among the parts, after all of them
CUT_SCHEMA = "doc_id bigint, n_tokens bigint, chunk_ids array<binary>, chunk_stops array<int>, sizes array<int>, payloads array<binary>"


def chunk_ends(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks end in the joined ids of documents that begin at ``starts``: after an id whose window's hash
    has nine zero bits, at each document's end, and after MOST ids at the latest."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * FACTOR
    rolled = mixed.copy()
    for back in range(1, min(WINDOW, len(ids))):
        rolled[back:] += mixed[:-back] * np.uint64(2 * back + 1)
    cut = ((rolled >> np.uint64(40)) & np.uint64(MASK)) == 0
    for back in range(WINDOW - 1):  # a window that begins before its document says nothing
        cut[starts[starts + back < len(ids)] + back] = False
    ends = np.union1d(np.flatnonzero(cut) + 1, np.append(starts[1:], len(ids)))
    before = np.concatenate(([0], ends[:-1]))
    extra = [np.arange(a + MOST, b, MOST) for a, b in zip(before, ends, strict=True) if b - a > MOST]
    return np.union1d(ends, np.concatenate(extra)) if extra else ends


def cut_documents(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """One row per document: its chunks' names, ends and sizes, and their bytes where its task first meets them."""
    small_batches(docs.sparkSession, *tokens.BATCH)
    width = 2 if max(end_id + 1, tokens.library_tokenizer(path).get_vocab_size()) <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = tokens.library_ids(path), set()
        for batch in batches:
            plain, sizes = encoder.texts(batch.column("text"))
            ids = np.insert(plain, np.cumsum(sizes), end_id)  # each document ends with the end id
            lengths = sizes + 1
            starts = np.cumsum(lengths) - lengths
            ends = chunk_ends(ids, starts)
            data = ids.astype(f"<u{width}").tobytes()
            begins = np.concatenate(([0], ends[:-1]))
            names, payloads = [], []
            for a, b in zip((width * begins).tolist(), (width * ends).tolist(), strict=True):
                piece = data[a:b]
                name = hashlib.sha256(piece).digest()
                names.append(name)
                payloads.append(None if name in seen else piece)
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(name)
            first = np.searchsorted(begins, np.append(starts, len(ids)))  # each document's first chunk
            columns = [pa.array(names, pa.binary()), (ends - np.repeat(starts, np.diff(first))).astype(np.int32), (ends - begins).astype(np.int32), pa.array(payloads, pa.binary())]
            lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x)) for x in columns]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n_tokens", "chunk_ids", "chunk_stops", "sizes", "payloads"])

    return docs.select("doc_id", "text").mapInArrow(run, CUT_SCHEMA)


def _over(children: Column) -> Column:
    """The hash of a node's children, an array of hex strings."""
    return F.sha2(F.array_join(children, ",").cast("binary"), 256)


def document_root(names: Column) -> Column:
    """The root of the Merkle tree over a document's chunk names."""

    def level(nodes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int")), lambda i: _over(F.slice(nodes, i * FAN + 1, F.lit(FAN))))

    nodes = F.transform(names, lambda x: F.lower(F.hex(x)))
    for _ in range(LEVELS):
        nodes = F.when(F.size(nodes) > 1, level(nodes)).otherwise(nodes)
    return nodes[0]


def write_store(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Encode doc_id and text and write the store's tables below ``folder``, which the cluster shares."""
    spark = docs.sparkSession
    # What is encoded once and read for chunks and for recipes; not a part of the store.
    cut = stage(cut_documents(docs, path or tokens.vocabulary_path()).withColumn("_doc", F.monotonically_increasing_id()), "cut", "zstd")
    rows = cut.select(F.explode(F.arrays_zip("chunk_ids", "sizes", "payloads")).alias("c")).where("c.payloads is not null")
    chunks = rows.select(F.col("c.chunk_ids").alias("chunk_id"), F.col("c.sizes").alias("n_ids"), F.col("c.payloads").alias("payload"))
    # A chunk comes at most once from each task; equal ones meet and one stays, by a sort that can spill.
    chunks.repartition("chunk_id").dropDuplicates(["chunk_id"]).write.option("compression", "zstd").parquet(f"{folder}/chunks")
    recipes = (
        cut.select("doc_id", "_doc", "n_tokens", "chunk_ids", "chunk_stops")
        .withColumn("root", document_root(F.col("chunk_ids")))
        .repartitionByRange("doc_id", "_doc")
        .sortWithinPartitions("doc_id", "_doc")
        .withColumn("part", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_doc")
    )
    recipes.write.option("compression", "zstd").parquet(f"{folder}/recipes")
    manifest_of(spark.read.parquet(f"{folder}/recipes")).write.parquet(f"{folder}/manifest")


def manifest_of(recipes: DataFrame) -> DataFrame:
    """The nodes above the recipes: (part, level, node), the numbers of documents and ids below, and the hash of the
    children in order. A node gathers no more than FAN children, so that no task holds a part's leaves."""
    leaf = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "n_tokens", "root").cast("binary"), 256)
    nodes, out = recipes.select("part", F.col("place").alias("node"), F.lit(1).cast("long").alias("n_docs"), "n_tokens", leaf.alias("hash")), None
    for level in range(1, 2 * LEVELS + 1):
        if level == LEVELS + 1:  # a part has one node left: parts are the store's leaves
            nodes = nodes.select(F.lit(STORE).alias("part"), F.col("part").cast("long").alias("node"), "n_docs", "n_tokens", _over(F.array(F.col("part").cast("string"), "hash")).alias("hash"))
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))
        nodes = nodes.groupBy("part", F.floor(F.col("node") / FAN).alias("above")).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), _over(children["hash"]).alias("hash"))
        nodes = nodes.withColumnRenamed("above", "node")
        own = nodes.select("part", F.lit(level).alias("level"), "node", "n_docs", "n_tokens", "hash")
        out = own if out is None else out.unionByName(own)
    return out


def _checked(found: Column, wanted: Column, what: str, value: Column) -> Column:
    return F.when(found.eqNullSafe(wanted), value).otherwise(F.raise_error(F.lit(what)))


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks, each held against its name."""
    chunks = spark.read.parquet(f"{folder}/chunks")
    named = F.sha2("payload", 256)
    return chunks.withColumn("payload", _checked(named, F.lower(F.hex("chunk_id")), "a chunk's bytes do not match its name", F.col("payload")))


def read_recipes(spark: SparkSession, folder: str) -> DataFrame:
    """The recipes with ``start``, the number of ids before each document; roots are held against the names.

    Starts come from the manifest's sums over parts and a running sum inside each part.
    """
    recipes = spark.read.parquet(f"{folder}/recipes")
    root = document_root(F.col("chunk_ids"))
    recipes = recipes.withColumn("root", _checked(root, F.col("root"), "a recipe does not match its root", F.col("root")))
    # A part's root and the store's stand for all nodes below them.
    tops = F.col("level") == F.when(F.col("part") == STORE, 2 * LEVELS).otherwise(LEVELS)
    said = spark.read.parquet(f"{folder}/manifest").where(tops)
    seen = manifest_of(recipes).where(tops).select("part", F.struct("n_docs", "n_tokens", "hash").alias("seen"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part, the store's last
    sums = (
        said.join(seen, "part", "full")
        .withColumn("n_tokens", _checked(F.struct("n_docs", "n_tokens", "hash"), F.col("seen"), "a part does not match the manifest", F.col("n_tokens")))
        .select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return recipes.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(sums, "part").withColumn("start", F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Reconstruction: doc_id, start, n_tokens and ``ids`` (all the document's ids, as stored)."""
    recipes = read_recipes(spark, folder)
    wanted = recipes.select("doc_id", "start", "n_tokens", F.posexplode("chunk_ids").alias("seq", "chunk_id"))
    return (
        wanted.join(read_chunks(spark, folder).select("chunk_id", "payload"), "chunk_id")
        .groupBy("doc_id", "start", "n_tokens")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("c"))
        .select("doc_id", "start", "n_tokens", F.array_join(F.transform("c.payload", lambda x: F.hex(x)), "").alias("ids"))
        .withColumn("ids", F.unhex("ids"))
    )


@functools.cache
def _ahead(power: int) -> np.ndarray:
    """Tables that move a CRC-32 ahead of 2 ** power zero bytes: for each of its four bytes, what each value adds.

    The move is linear: a value's image is the XOR of its bits' images, and those of a double step are two moves.
    """
    if power:
        one = _ahead(power - 1)
        bits = _moved(one, _moved(one, np.uint32(1) << np.arange(32, dtype=np.uint32)))
    else:
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(8):
            bits = (bits >> np.uint32(1)) ^ np.where(bits & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    values = np.arange(256)
    return np.array([np.bitwise_xor.reduce([np.where(values >> i & 1, bits[8 * k + i], np.uint32(0)) for i in range(8)]) for k in range(4)])


def _moved(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> np.uint32(8) & 255] ^ tables[2][crc >> np.uint32(16) & 255] ^ tables[3][crc >> np.uint32(24)]


def _times_x(crc: np.ndarray, following: np.ndarray) -> np.ndarray:
    """CRC-32 values moved ahead of ``following`` more bytes each."""
    out, power = crc.astype(np.uint32), 0
    while (following >> power).any():
        own = np.flatnonzero(following >> power & 1)
        out[own] = _moved(_ahead(power), out[own])
        power += 1
    return out


def document_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the document's ids as unsigned 32-bit integers, from the store's files.

    Each distinct chunk's bytes are read and summed once; CRC-32 is linear, so that a document's checksum
    is the XOR of its chunks' checksums, each moved ahead of the bytes that follow it. No bytes are shuffled.
    """

    @F.pandas_udf("long")
    def crc(payload: pd.Series, n_ids: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.frombuffer(x, f"<u{len(x) // n}").astype("<u4").tobytes()) for x, n in zip(payload, n_ids, strict=True)], dtype="int64")

    facts = read_chunks(spark, folder).select("chunk_id", crc("payload", "n_ids").alias("crc"))

    @F.pandas_udf("long")
    def moved(crc: pd.Series, following: pd.Series) -> pd.Series:
        return pd.Series(_times_x(crc.to_numpy(), following.to_numpy()).astype(np.int64))

    recipes = read_recipes(spark, folder)
    parts = recipes.select("doc_id", "start", "n_tokens", F.explode(F.arrays_zip("chunk_ids", "chunk_stops")).alias("c"))
    parts = parts.select("doc_id", "start", "n_tokens", F.col("c.chunk_ids").alias("chunk_id"), (4 * (F.col("n_tokens") - F.col("c.chunk_stops"))).alias("following"))
    return (
        parts.join(facts, "chunk_id", "left")
        .withColumn("crc", F.when(F.col("crc").isNull(), F.raise_error(F.lit("a recipe's chunk is missing"))).otherwise(F.col("crc")))
        .groupBy("doc_id", "start", "n_tokens")
        .agg(F.bit_xor(moved("crc", "following")).alias("ids_crc32"))
    )


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/token-store-{uuid.uuid4().hex}"
    write_store(read(spark, sf_dir, "documents"), folder)
    return document_checksums(spark, folder)
