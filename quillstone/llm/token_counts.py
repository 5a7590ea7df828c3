"""Token counts of documents by a scan for separators.

Token files are flat: a task's documents one after another, each closed by the end-of-document id, cut
into blocks of a fixed number of ids wherever that falls. Nothing says where a document begins. A scan
searches each block for the end id at once, and a running maximum over the blocks of a file stitches the
documents that cross block borders.

Edges: a null text is an empty document (its end id alone); the end id's string inside a text is plain
text, never a separator; an empty table gives no files and no rows; repeated rows count each; a file's
ids after its last end id belong to no document and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm import tokens
from quillstone.llm.storage import read, small_batches, stage

END_OF_DOCUMENT = 49407
BLOCK = 1 << 16
FILE_SCHEMA = "file int, block int, ids binary, closed array<bigint>"
SCAN_SCHEMA = "file int, block int, n_ids int, ends array<int>, closed array<bigint>"


def flat_files(docs: DataFrame, path: str | None = None, block: int = BLOCK, end: int = END_OF_DOCUMENT) -> DataFrame:
    """Blocks of ids (unsigned 16-bit, enough for the vocabulary) of one file per task, in order.

    ``closed`` names the documents whose end id lies in a block, so that counts can be given by name;
    it holds no length and no place.
    """
    path = path or tokens.vocabulary_path()
    small_batches(docs.sparkSession, *tokens.BATCH)
    if max(end + 1, tokens.library_tokenizer(path).get_vocab_size()) > 1 << 16:
        raise ValueError("token files hold ids of 16 bits: the vocabulary is too large")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number = TaskContext.get().partitionId(), 0
        encoder = tokens.library_ids(path, True)
        open_ids, names = np.empty(0, np.uint16), []

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal open_ids, number
            whole = len(open_ids) // block + (last and len(open_ids) % block > 0)
            if not whole:
                return
            rows = [open_ids[i * block : (i + 1) * block] for i in range(whole)]
            counts = [int((r == end).sum()) for r in rows]
            cuts = np.cumsum([0, *counts])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([file] * whole, pa.int32()),
                    pa.array(range(number, number + whole), pa.int32()),
                    pa.array([r.tobytes() for r in rows], pa.binary()),
                    pa.array([names[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.list_(pa.int64())),
                ],
                ["file", "block", "ids", "closed"],
            )
            number += whole
            open_ids = open_ids[whole * block :]
            del names[: cuts[-1]]

        for batch in batches:
            plain, sizes = encoder.texts(batch.column("text"))
            open_ids = np.concatenate([open_ids, np.insert(plain, np.cumsum(sizes), end).astype(np.uint16)])
            names += batch.column("doc_id").to_pylist()
            yield from blocks(False)
        yield from blocks(True)

    return docs.select("doc_id", "text").mapInArrow(run, FILE_SCHEMA)


def scan_ends(files: DataFrame, end: int = END_OF_DOCUMENT) -> DataFrame:
    """Per block: its number of ids and the places just after each end id in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, "<u2") for x in batch.column("ids").to_pylist()]
            ends = [np.flatnonzero(x == end).astype(np.int32) + 1 for x in ids]
            offsets = np.cumsum([0, *map(len, ends)]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.int32), *ends]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array([len(x) for x in ids], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), batch.column("closed")],
                ["file", "block", "n_ids", "ends", "closed"],
            )

    return files.mapInArrow(run, SCAN_SCHEMA)


def count_tokens(files: DataFrame, end: int = END_OF_DOCUMENT, block: int = BLOCK) -> DataFrame:
    """doc_id, file, start (ids before the document in its file) and n_tokens without the end id."""
    scanned = scan_ends(files, end)
    base = F.col("block").cast("long") * block
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last_end = F.when(F.size("ends") > 0, base + F.element_at("ends", -1))
    stitched = scanned.withColumn("open_from", F.coalesce(F.max(last_end).over(before), F.lit(0)))
    ends = F.transform("ends", lambda e: base + e)
    starts = F.concat(F.array("open_from"), ends)
    rows = stitched.select("file", F.explode(F.arrays_zip(F.col("closed").alias("doc_id"), ends.alias("stop"), F.slice(starts, F.lit(1), F.size("ends")).alias("start"))).alias("d"))
    return rows.select("d.doc_id", "file", "d.start", (F.col("d.stop") - F.col("d.start") - 1).alias("n_tokens"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stage(flat_files(read(spark, sf_dir, "documents")), "token-files")
    return count_tokens(files).select("doc_id", "n_tokens")
