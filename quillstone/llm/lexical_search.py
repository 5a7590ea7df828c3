"""Ranked lexical search over an index that is stratified by length.

Documents whose lengths give the same normaliser m are one stratum; a stratum is cut into blocks of about equal
numbers of terms, so that no task holds a crowded one. A block is a row of the index: its documents, its terms and,
for each term, its postings grouped by frequency, highest first. Within a block all documents have the same m, so
that a frequency's impact is computed once for all postings that have it.

A search reads the index in two waves. The highest impact of each term in a block bounds every score there. First
each query visits a few blocks with the highest bounds, which gives its k-th best score so far; then all blocks whose
bound is not below that, nor below what its task has found meanwhile. Scores are products of a matrix of weights (queries by terms) and one of impacts (terms by
documents), in doubles: all sums are integers below 2^53 and so exact. Queries come in blocks of bounded size, joined
to the index's rows; no query set is collected, no pair of a query and a document is laid out but for the best.

Edges: null and empty texts, and texts without terms, are no documents of the index and as queries find nothing; a
null document id ranks behind equal scores of others; repeated ids and rows rank each for itself; repeated query rows
are answered each; an empty table gives an empty result; other columns are not read. Terms are told apart by 64-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.shingles import hashed_words
from quillstone.llm.storage import bytes_of, read, small, small_batches, stage

TOP = 10
#: Terms (with repeats) of an index block; queries and terms of a query block; documents scored at once.
BLOCK_TERMS, QUERIES_AT_ONCE, QUERY_TERMS, DOCS_AT_ONCE = 1 << 17, 500, 10_000, 1024
#: Blocks that a query visits first.
SEEDS = 4
_BYTE = np.arange(256)
#: Of ASCII, terms hold digits and letters only; of all else, everything.
SEPARATORS = (_BYTE < 128) & ~(((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x41) & (_BYTE <= 0x5A)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)))
_LAST = np.iinfo(np.int64).max
_INDEX = "m long, block int, docs array<long>, terms array<long>, groups array<int>, tfs array<int>, sizes array<int>, postings array<int>"


@dataclass(frozen=True)
class Index:
    """``blocks`` is a written table; n and length are the N and L of the scores."""

    blocks: DataFrame
    n: int
    length: int


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, bounds = hashed_words(batch.column(0).to_pylist(), SEPARATORS)
        yield pa.RecordBatch.from_arrays([pa.array(np.diff(bounds), pa.int64())], ["n"])


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, kind))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, place, n, terms, tfs) with distinct terms in hash order."""
    task = TaskContext.get().partitionId() << 40
    for number, batch in enumerate(batches):
        h, bounds = hashed_words(batch.column(1).to_pylist(), SEPARATORS)
        found = [np.unique(h[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        sizes = np.array([len(t) for t, _ in found], np.int64)
        terms, tfs = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.uint64) for i in (0, 1))
        place = task | (number << 16) + np.arange(batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(place), pa.array(np.diff(bounds), pa.int64()), _lists(terms.view(np.int64), sizes, pa.int64()), _lists(tfs.astype(np.int32), sizes, pa.int32())],
            ["key", "place", "n", "terms", "tfs"],
        )


def _block(table: pa.Table) -> pa.Table:
    """The documents of one block to its row."""
    ids = np.array([_LAST if x is None else x for x in table.column("key").to_pylist()], np.int64)
    order = np.argsort(ids, kind="stable")
    terms, tfs = (table.column(n).combine_chunks() for n in ("terms", "tfs"))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    owner = np.repeat(place, terms.value_lengths().to_numpy())
    terms, tfs = terms.flatten().to_numpy().view(np.uint64), tfs.flatten().to_numpy()
    at = np.lexsort((owner, -tfs, terms))
    terms, tfs, owner = terms[at], tfs[at], owner[at]
    new = np.concatenate(([True], terms[1:] != terms[:-1]))
    group = np.flatnonzero(new | np.concatenate(([True], tfs[1:] != tfs[:-1])))
    term = np.flatnonzero(new)
    row = {
        "m": table.column("m")[0].as_py(), "block": table.column("block")[0].as_py(), "docs": ids[order], "terms": terms[term].view(np.int64),
        "groups": np.diff(np.searchsorted(group, [*term, len(terms)])), "tfs": tfs[group], "sizes": np.diff([*group, len(terms)]), "postings": owner,
    }
    long, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    kinds = {"m": pa.int64(), "block": pa.int32(), "docs": long, "terms": long} | {n: ints for n in ("groups", "tfs", "sizes", "postings")}
    return pa.table({n: pa.array([v], kinds[n]) for n, v in row.items()})


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """All of ``docs`` in an index that is written to the shared folder."""
    spark = docs.sparkSession
    small_batches(spark, 2000, 8 << 20)
    lengths = stage(docs.select(text).mapInArrow(_lengths, "n long").where("n > 0").groupBy("n").count(), "lengths")
    n, length = lengths.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("count")), F.lit(0))).first()
    normaliser = F.expr(f"100 - 90 + ((90 * n * {n}L) div {max(length, 1)}L)")
    strata = stage(lengths.withColumn("m", normaliser).groupBy("m").agg(F.ceil(F.sum(F.col("n") * F.col("count")) / BLOCK_TERMS).alias("blocks")), "strata")
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    found = source.mapInArrow(_terms, "key long, place long, n long, terms array<long>, tfs array<int>").where("n > 0")
    placed = found.withColumn("m", normaliser).join(small(strata, bytes_of(strata)), "m")
    placed = placed.select("key", "terms", "tfs", "m", F.pmod(F.xxhash64("place"), F.col("blocks")).cast("int").alias("block"))
    return Index(stage(placed.groupBy("m", "block").applyInArrow(_block, _INDEX), "index"), n, length)


def _query_blocks(queries: DataFrame, key: str, text: str, index: Index) -> tuple[DataFrame, int, int]:
    """(queries, keys, wanted, counts, vocabulary, weights): blocks of queries with the weights of their terms. Their number, and a bound of their bytes."""
    spark = queries.sparkSession
    small_batches(spark, 2000, 8 << 20)
    source = queries.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    found = stage(source.mapInArrow(_terms, f"key {kind}, place long, n long, terms array<long>, tfs array<int>").where("n > 0").select("key", "place", "terms"), "queries")
    rows, terms = found.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    number, size = max(1, -(-rows // QUERIES_AT_ONCE), -(-terms // QUERY_TERMS)), 8 * (3 * terms + 4 * rows)
    found = found.withColumn("queries", F.pmod(F.xxhash64("place"), F.lit(number)).cast("int"))
    each = found.select("queries", F.explode("terms").alias("term")).distinct()
    vocabulary = each.groupBy("queries").agg(F.array_sort(F.collect_list("term")).alias("vocabulary"))
    frequencies = joined(index.blocks.select("terms", "groups", "sizes"), vocabulary, number, size).mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    # A term is in several query blocks: each counted it whole.
    copies = each.groupBy("term").agg(F.count("*").alias("copies"))
    frequencies = frequencies.join(copies, "term").select("term", F.expr("df div copies").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((2.0 * F.lit(index.n) + 2.0) / (2.0 * F.col("df") + 1.0)))
    weighted = each.join(frequencies, "term").select("queries", F.struct("term", weight.alias("weight")).alias("w")).groupBy("queries").agg(F.array_sort(F.collect_list("w")).alias("w"))
    packed = found.groupBy("queries").agg(F.array_sort(F.collect_list(F.struct("place", "key", "terms"))).alias("of")).join(weighted, "queries")
    return stage(
        packed.select(
            "queries", F.transform("of", lambda q: q["key"]).alias("keys"), F.flatten(F.transform("of", lambda q: q["terms"])).alias("wanted"),
            F.transform("of", lambda q: F.size(q["terms"])).alias("counts"), F.transform("w", lambda w: w["term"]).alias("vocabulary"), F.transform("w", lambda w: w["weight"]).alias("weights"),
        ),
        "query-blocks",
    ), number, size


def joined(blocks: DataFrame, packed: DataFrame, number: int, size: int) -> DataFrame:
    """Every row of ``blocks`` beside every one of the ``number`` blocks of queries, which have up to ``size`` bytes."""
    many = blocks.withColumn("queries", F.explode(F.sequence(F.lit(0), F.lit(number - 1))))
    return many.join(small(packed, size), "queries")


def _array(batch: pa.RecordBatch, name: str, row: int, kind: type = np.int64) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False).astype(kind, copy=False)


def _found(batch: pa.RecordBatch, row: int, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the vocabulary of the terms that the block holds, and their places in the block. Both are in hash order."""
    terms = _array(batch, "terms", row).view(np.uint64)
    at = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
    held = np.flatnonzero(terms[at] == vocabulary)
    return held, at[held]


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each query term of a block, the documents that hold it; summed up over the task's blocks."""
    total: dict[int, int] = {}
    for batch in batches:
        for row in range(batch.num_rows):
            vocabulary = np.sort(_array(batch, "vocabulary", row).view(np.uint64))
            held, at = _found(batch, row, vocabulary)
            of_group, of_term = _starts(_array(batch, "sizes", row)), _starts(_array(batch, "groups", row))
            for t, n in zip(vocabulary[held].view(np.int64).tolist(), (of_group[of_term[at + 1]] - of_group[of_term[at]]).tolist(), strict=True):
                total[t] = total.get(t, 0) + n
            if len(total) > QUERY_TERMS:
                yield pa.RecordBatch.from_pydict({"term": list(total), "df": list(total.values())})
                total = {}
    if total:
        yield pa.RecordBatch.from_pydict({"term": list(total), "df": list(total.values())})


class _Queries:
    """A block of queries as a matrix: a row for each query, a column for each term of the vocabulary."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.number = batch.column("queries")[row].as_py()
        vocabulary = _array(batch, "vocabulary", row).view(np.uint64)
        order = np.argsort(vocabulary)
        self.vocabulary, weights = vocabulary[order], _array(batch, "weights", row)[order].astype(float)
        counts, wanted = _array(batch, "counts", row), _array(batch, "wanted", row).view(np.uint64)
        owner = np.repeat(np.arange(len(counts)), counts)
        self.weights = np.zeros((len(counts), len(vocabulary)))
        at = np.minimum(np.searchsorted(self.vocabulary, wanted), max(0, len(vocabulary) - 1))
        known = self.vocabulary[at] == wanted if len(vocabulary) else np.zeros(len(wanted), bool)  # the others are in no document
        self.weights[owner[known], at[known]] = weights[at[known]]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, _Queries]]:
    queries = None
    for batch in batches:
        for row in range(batch.num_rows):
            if queries is None or queries.number != batch.column("queries")[row].as_py():
                queries = _Queries(batch, row)
            yield batch, row, queries


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m)


def _bounds(batch: pa.RecordBatch, row: int, queries: _Queries) -> np.ndarray:
    """The highest score that each query can have in the block."""
    held, at = _found(batch, row, queries.vocabulary)
    highest = impact(_array(batch, "tfs", row)[_starts(_array(batch, "groups", row))[at]], batch.column("m")[row].as_py())
    return (queries.weights[:, held] @ highest.astype(float)).astype(np.int64)


def _highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each query the SEEDS blocks of the task with the highest bounds: (queries, query, bound, m, block)."""
    top: dict[int, np.ndarray] = {}
    for batch, row, queries in _each(batches):
        bound = _bounds(batch, row, queries)
        own = np.stack([bound, np.full(len(bound), batch.column("m")[row].as_py()), np.full(len(bound), batch.column("block")[row].as_py())], axis=1)[:, None]
        both = np.concatenate((top[queries.number], own), axis=1) if queries.number in top else own
        order = np.argsort(-both[:, :, 0], axis=1, kind="stable")[:, :SEEDS]
        top[queries.number] = np.take_along_axis(both, order[:, :, None], axis=1)
    for number, best in top.items():
        query, rank = np.nonzero(best[:, :, 0] > 0)
        bound, m, block = best[query, rank].T
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in ((np.full(len(m), number), pa.int32()), (query, pa.int32()), (bound, pa.int64()), (m, pa.int64()), (block, pa.int32()))], ["queries", "query", "bound", "m", "block"])


def _scores(batch: pa.RecordBatch, row: int, weights: np.ndarray, at: np.ndarray, docs: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first document, scores) of the block's documents, some at a time, for ``weights`` (queries by terms, the block's terms ``at``)."""
    groups, sizes, postings = (_array(batch, n, row) for n in ("groups", "sizes", "postings"))
    of_term, of_group = _starts(groups), _starts(sizes)
    once = impact(_array(batch, "tfs", row), batch.column("m")[row].as_py()).astype(float)  # one for each frequency of a term
    for start in range(0, docs, DOCS_AT_ONCE):
        impacts = np.zeros((len(at), min(DOCS_AT_ONCE, docs - start)))
        for i, t in enumerate(at):
            own, values = postings[of_group[of_term[t]] : of_group[of_term[t + 1]]], np.repeat(once[of_term[t] : of_term[t + 1]], sizes[of_term[t] : of_term[t + 1]])
            inside = (own >= start) & (own < start + impacts.shape[1])
            impacts[i, own[inside] - start] = values[inside]
        yield start, (weights @ impacts).astype(np.int64)


def _best(k: int):
    """The k best documents of each query, over the task's blocks: (queries, query, doc, score). A row tells which queries visit
    its block (``visit``), or the score that makes it worth while (``least``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch, row, queries in _each(batches):
            if "visit" in batch.schema.names:
                visit = _array(batch, "visit", row)
            else:
                least = _array(batch, "least", row).copy()
                for q in range(len(least)):  # what this task has found already may ask for more
                    if len(known := top.get((queries.number, q), ((),))[0]) == k:
                        least[q] = max(least[q], known[-1])
                bound = _bounds(batch, row, queries)
                visit = np.flatnonzero((bound > 0) & (bound >= least))
            if not len(visit):
                continue
            docs = _array(batch, "docs", row)
            held, at = _found(batch, row, queries.vocabulary)
            weights = queries.weights[np.ix_(visit, held)]
            used = np.flatnonzero(weights.any(axis=0))
            for start, scores in _scores(batch, row, weights[:, used], at[used], len(docs)):
                order = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # documents stand by rising id
                for i, q in enumerate(visit.tolist()):
                    s, d = scores[i, order[i]], docs[start + order[i]]
                    s, d = s[s > 0], d[s > 0]
                    if len(s) and (queries.number, q) in top:
                        was_s, was_d = top[queries.number, q]
                        s, d = np.concatenate((was_s, s)), np.concatenate((was_d, d))
                        keep = np.lexsort((d, -s))[:k]
                        s, d = s[keep], d[keep]
                    if len(s):
                        top[queries.number, q] = s, d
        for (number, q), (s, d) in top.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), number), pa.int32()), pa.array(np.full(len(s), q), pa.int32()), pa.array(d, mask=d == _LAST), pa.array(s)], ["queries", "query", "doc", "score"])

    return run


def search(index: Index, queries: DataFrame, key: str = "item_id", text: str = "text", k: int = TOP) -> DataFrame:
    """(key, rank, doc_id, score): the k documents with the highest scores above 0 for each query, equal scores by id."""
    packed, number, size = _query_blocks(queries, key, text, index)
    out = "queries int, query int, doc long, score long"
    # The first wave: for each query, the blocks with the highest bounds in several parts of the index.
    bounds = joined(index.blocks.select("m", "block", "terms", "groups", "tfs"), packed, number, size).mapInArrow(_highest, "queries int, query int, bound long, m long, block int")
    first = bounds.groupBy("queries", "query", F.pmod(F.xxhash64("m", "block"), F.lit(SEEDS))).agg(F.max(F.struct("bound", "m", "block")).alias("b"))
    seeds = stage(first.groupBy("queries", F.col("b.m").alias("m"), F.col("b.block").alias("block")).agg(F.array_sort(F.collect_set("query")).alias("visit")), "seeds")
    found = index.blocks.join(small(seeds, SEEDS * size), ["m", "block"]).join(small(packed, size), "queries").mapInArrow(_best(k), out)
    order = Window.partitionBy("queries", "query").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    least = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).groupBy("queries").agg(F.map_from_entries(F.collect_list(F.struct("query", "score"))).alias("known"))
    # The second wave: all blocks whose bound is not below the query's k-th score so far.
    hopes = F.transform("keys", lambda _, q: F.coalesce(F.element_at("known", q), F.lit(0).cast("long")))
    asked = stage(packed.join(least, "queries", "left").select(*packed.columns, hopes.alias("least")), "asked")
    best = joined(index.blocks, asked.drop("keys"), number, size).mapInArrow(_best(k), out)
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    keys = packed.select("queries", F.posexplode("keys").alias("query", "key"))
    return best.join(keys, ["queries", "query"]).select("key", "rank", F.col("doc").alias("doc_id"), "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(read(spark, sf_dir, "documents"))
    return search(index, read(spark, sf_dir, "benchmark")).select(F.col("key").alias("item_id"), "rank", "doc_id", "score")


SQL = r"""
WITH lowered AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
held AS (SELECT doc_id, terms, len(terms) AS n FROM lowered WHERE len(terms) > 0),
totals AS (SELECT count(*) AS big_n, sum(n) AS l FROM held),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM held) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * big_n) // l)))))::BIGINT AS score
  FROM items JOIN tf USING (term) JOIN weights USING (term), totals GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
