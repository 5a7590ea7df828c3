"""N-gram Jaccard join: rare-first prefix filtering over sets of word shingles, verified once per pair.

1. Frequencies. A batch of documents (a chunk) sends its distinct shingles, packed with the document's place, to
   ranges of the hash; there they are counted over all chunks. What at least two sets hold goes back to its chunk
   with the count. Most shingles occur once: they are counted, but never become rows.
2. Prefixes. A set of n shingles is ordered rare-first (count, hash). Two sets of similarity t share one of the
   first n - ceil(t n) + 1. Shingles that no other set has come first in that order and cannot be shared.
3. Join on prefix shingles. Pairs pass filters of length, position (what is left behind a match must suffice) and
   suffix (the sets' counts in 32 ranges of the hash bound their overlap), and are verified once on whole sets.
4. Crowds: prefix shingles of more than ``pairwise`` sets, as thousands of near copies of one text share.
   Members that no other can reach by the positional filter go. The most central of the others becomes the list's
   pivot and is compared with all. Two members linked to it are connected. For every other pair at least one is
   not linked (is open); and then, by arithmetic on symmetric differences, both differences from the pivot share
   an element of their own rare-first prefixes (see ``_differences``): a join of the same kind, over small sets, of
   lists that are crowded far less. What is still crowded gets pivots in turn. Every round takes its pivot out of
   a list, and after ``ROUNDS`` the rest is compared pair by pair. Nothing is left out: the components are those of
   all pairs.

The 64-bit hashes stand for the shingles. Only distinct sets are joined, by a 128-bit hash of the set.

Edges: a null, empty or blank text has no set, ``n_shingles`` 0, and is linked with nothing; with fewer words than a
shingle the whole sequence is its one shingle; repeated rows and equal sets are linked; a null key is passed over
when the smallest key of a component is sought, unless all are null; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from quillstone.llm.components import component_keys
from quillstone.llm.shingles import shingle_sets
from quillstone.llm.storage import give_back, giving_back, read, small_batches, stage

WORDS, THRESHOLD, PAIRWISE, ROUNDS = 5, (8, 10), 32, 20
#: Text bytes whose shingles one range of the hash gets, on average; ranges of the suffix filter; rows and bytes of a chunk.
RANGE_BYTES, SUFFIX, CHUNK = 4 << 20, 32, (1000, 4 << 20)
#: Copies of a pivot, so that one with very many members is not joined in one task.
SALTS = 16


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers, all their first bytes together, then all second ones: sorted hashes then compress."""
    return b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)


def _unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(data) // sum(widths), 0, []
    for kind, width in zip(kinds, widths, strict=True):
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * width
    return out


def _chunks(key: StructField, words: int, bits: int):
    """Batches of (key, text) to rows of a chunk: one for each document, and its shingles by range of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(batches):
            chunk, own, sets, names, places, sizes = task | number, {}, [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), words):
                name = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                if name is not None and name not in own:
                    own[name] = len(sets)
                    sets.append(s)
                names.append(name)
                places.append(own.get(name))
                sizes.append(len(s))
            n = batch.num_rows
            spread = (np.arange(n) + xxhash.xxh32_intdigest(str(chunk))) % (1 << bits)  # rows of documents go to any range
            made = [pa.array(spread, pa.int32()), pa.array(np.full(n, chunk), pa.int64()), pa.nulls(n, pa.binary()), batch.column(0), pa.array(names, pa.binary()), pa.array(places, pa.int32()), pa.array(sizes, pa.int32())]
            titles = ["range", "chunk", "data", "key", "name", "place", "size"]
            yield pa.RecordBatch.from_arrays(made, titles)
            if not sets:
                continue
            h, place = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
            order = np.argsort(h)
            h, place = h[order], place[order]
            ranges, starts = np.unique(h >> np.uint64(64 - bits), return_index=True)
            data = [_packed(h[a:b], place[a:b]) for a, b in zip(starts, [*starts[1:], len(h)], strict=True)]
            none = [pa.nulls(len(data), x.type) for x in made[3:]]
            yield pa.RecordBatch.from_arrays([pa.array(ranges.astype(np.int32)), pa.array(np.full(len(data), chunk), pa.int64()), pa.array(data, pa.binary()), *none], titles)

    kinds = [("range", IntegerType()), ("chunk", LongType()), ("data", BinaryType()), ("key", key.dataType), ("name", BinaryType()), ("place", IntegerType()), ("size", IntegerType())]
    return run, StructType([StructField(n, k) for n, k in kinds])


def _counted(table: pa.Table) -> pa.Table:
    """Of one range of the hash: what at least two sets hold, with how many do, for each chunk. Rows of documents pass."""
    sent = table.column("data").is_valid()
    pieces = [_unpacked(x, np.uint64, np.uint32) for x in table.column("data").filter(sent).to_pylist()]
    rows = table.filter(pa.compute.invert(sent)).drop_columns(["range"])
    if not pieces:
        return rows
    _, which, times = np.unique(np.concatenate([h for h, _ in pieces]), return_inverse=True, return_counts=True)
    times, at, data = times.astype(np.uint32)[which], 0, []
    for h, place in pieces:
        t = times[at : at + len(h)]
        at += len(h)
        shared = t > 1
        data.append(_packed(h[shared], place[shared], t[shared]) if shared.any() else None)
    del pieces, which, times
    give_back()
    back = pa.table({"chunk": table.column("chunk").filter(sent), "data": pa.array(data, pa.binary())}).filter(pa.compute.is_valid(pa.array(data, pa.binary())))
    none = {f.name: pa.nulls(len(back), f.type) for f in rows.schema if f.name not in ("chunk", "data")}
    return pa.concat_tables([rows, pa.table({**{n: back.column(n) for n in ("chunk", "data")}, **none}).select(rows.column_names).cast(rows.schema)])


def _prefixed(threshold: tuple[int, int]):
    """Of one chunk: for each document its shared shingles rare-first, of which ``n_prefix`` are in its prefix."""
    num, den = threshold

    def run(table: pa.Table) -> pa.Table:
        sent = table.column("data").is_valid()
        pieces = [_unpacked(x, np.uint64, np.uint32, np.uint32) for x in table.column("data").filter(sent).to_pylist()]
        rows = table.filter(pa.compute.invert(sent))
        place, size = (rows.column(n).to_pylist() for n in ("place", "size"))
        if pieces:
            h, owner, times = (np.concatenate(x) for x in zip(*pieces, strict=True))
            order = np.lexsort((h, times, owner))
            h, owner, times = h[order], owner[order], times[order]
        else:
            h, owner, times = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        last = max((p for p in place if p is not None), default=-1)
        bounds = np.searchsorted(owner, np.arange(last + 2)).tolist()
        out: dict[str, list] = {n: [] for n in ("first", "n_prefix", "weight", "shared", "parts")}
        for p, n in zip(place, size, strict=True):
            a, b = (bounds[p], bounds[p + 1]) if p is not None else (0, 0)
            first = n - (b - a)
            prefix = max(0, n - -(-num * n // den) + 1 - first) if b > a else 0
            out["first"].append(first)
            out["n_prefix"].append(min(prefix, b - a))
            out["weight"].append(float(np.log2(times[a:b]).sum()) / n if prefix else 0.0)
            out["shared"].append(h[a:b].view(np.int64) if prefix else None)
            out["parts"].append(np.bincount((h[a:b] >> np.uint64(64 - SUFFIX.bit_length() + 1)).astype(np.int64), minlength=SUFFIX) if prefix else None)
        kinds = {"first": pa.int32(), "n_prefix": pa.int32(), "weight": pa.float64(), "shared": pa.list_(pa.int64()), "parts": pa.list_(pa.int32())}
        return pa.table({**{n: rows.column(n) for n in ("key", "name", "size")}, **{n: pa.array(v, kinds[n]) for n, v in out.items()}})

    return run


def prefixes(docs: DataFrame, key: str, text: str = "text", words: int = WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """For each row of ``docs``: key, name of its set, size, first (rank of the first shared shingle), n_prefix, weight, shared, parts. Written out."""
    spark = docs.sparkSession
    small_batches(spark, *CHUNK)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = max(4, (total // RANGE_BYTES).bit_length())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (64 << 20))
    kind = docs.schema[key].dataType
    if isinstance(kind, StructType):  # rows of shingles have no key
        kind = StructType([StructField(f.name, f.dataType) for f in kind.fields])
    source = docs.select(F.col(key).cast(kind).alias("key"), F.col(text).alias("text"))
    run, schema = _chunks(source.schema["key"], words, bits)
    sent = source.mapInArrow(giving_back(run), schema).repartition(tasks, "range")
    counted = sent.groupBy("range").applyInArrow(_counted, StructType(schema.fields[1:]))
    made = [*schema.fields[3:5], schema.fields[6], StructField("first", IntegerType()), StructField("n_prefix", IntegerType()), StructField("weight", DoubleType()), StructField("shared", ArrayType(LongType())), StructField("parts", ArrayType(IntegerType()))]
    return stage(counted.repartition(tasks, "chunk").groupBy("chunk").applyInArrow(_prefixed(threshold), StructType(made)), "prefixes")


def _reach(a_size: str | Column, b_size: str | Column, overlap: Column, threshold: tuple[int, int]) -> Column:
    """Sets of these sizes that may have this overlap, at the most, may have the similarity."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a_size, b_size))
    num, den = threshold
    return (F.least(a, b) * den >= F.greatest(a, b) * num) & (overlap * (num + den) >= (a + b) * num)


def _left(a_size: Column, a_rank: Column, b_size: Column, b_rank: Column) -> Column:
    """Positional filter: a first common shingle at these ranks leaves this overlap at the most."""
    return F.least(a_size - a_rank, b_size - b_rank)


def _sized(lists: DataFrame, keys: list[str]) -> DataFrame:
    """``lists`` with n, the members of their list; lists of one member go."""
    return lists.join(lists.groupBy(keys).agg(F.count("*").alias("n")).where("n > 1"), keys)


def _overlap(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b))


def similar(a: str, b: str, threshold: tuple[int, int]) -> Column:
    """The sets <a>_set and <b>_set, of <a>_size and <b>_size, have the similarity."""
    return _reach(f"{a}_size", f"{b}_size", _overlap(f"{a}_set", f"{b}_set"), threshold)


def verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The ``pairs`` (a, b) whose sets have the similarity. Called once, on distinct pairs; whole sets are joined to those that pass the suffix filter."""
    a, b = (sets.select(F.col("name").alias(x), F.col("size").alias(f"{x}_size"), F.col("parts").alias(f"{x}_parts")) for x in "ab")
    suffix = F.aggregate(F.zip_with("a_parts", "b_parts", lambda u, v: F.least(u, v)), F.lit(0), lambda s, v: s + v)
    left = pairs.join(a, "a").join(b, "b").where(_reach("a_size", "b_size", suffix, threshold)).select("a", "b", "a_size", "b_size")
    a, b = (sets.select(F.col("name").alias(x), F.col("shared").alias(f"{x}_set")) for x in "ab")
    return left.join(a, "a").join(b, "b").where(similar("a", "b", threshold)).select("a", "b")


def _differences(crowds: DataFrame, sets: DataFrame, bit: int, threshold: tuple[int, int]) -> DataFrame:
    """Each crowded list's members compared with its pivot: (scope, pivot, name, opens, linked, size, n, e, delta, common), written out.

    For a pivot p and sets x, y let X = x ^ p and Y = y ^ p. Similarity num/den means
    |x ^ y| (den + num) <= (|x| + |y|) (den - num), and |x ^ y| = |X| + |Y| - 2 |X & Y|. With
    e(x) = (den + num) |X| - (den - num) |x| that is |X & Y| >= (e(x) + e(y)) / (2 (den + num)).
    x is open, i.e. not similar to p, just if e(x) > (den - num) |p|; and e(y) >= -(den - num) |p| always. So if one
    of the two is open, at least one element is common to X and Y.

    ``delta`` holds X's elements that another set may have too: x's own shared shingles, and those that x misses, as
    their complements. The shingles that p alone has are missing in every x: ``common`` counts them.
    """
    num, den = threshold
    pivots = crowds.groupBy("scope", "token").agg(F.max(F.struct(F.col("opens").bitwiseAND(F.lit(1 << bit)).alias("open"), "weight", "name")).alias("p"))
    of = crowds.join(pivots.select("scope", "token", F.col("p.name").alias("pivot")), ["scope", "token"]).where("name <> pivot")
    scope = F.xxhash64("scope", "pivot").alias("scope")
    members = of.select(scope, "pivot", "name", "opens", "weight", "size").dropDuplicates(["scope", "name"])
    p = sets.join(members.select(F.col("pivot").alias("name")).distinct(), "name", "left_semi")
    p = p.select(F.col("name").alias("pivot"), F.col("size").alias("p_size"), F.col("shared").alias("p_set"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    x = members.join(sets.select("name", F.col("shared").alias("x_set")), "name").withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int"))
    both = x.join(p, ["pivot", "salt"]).withColumn("overlap", _overlap("x_set", "p_set"))
    linked = F.col("overlap") * (num + den) >= (F.col("size") + F.col("p_size")) * num
    n = F.col("size") + F.col("p_size") - 2 * F.col("overlap")
    delta = F.concat(F.array_except("x_set", "p_set"), F.transform(F.array_except("p_set", "x_set"), lambda v: F.bitwise_not(v)))
    return stage(
        both.select(
            "scope", "pivot", "name", "weight", "size", linked.alias("linked"), n.alias("n"), (n * (den + num) - F.col("size") * (den - num)).alias("e"), delta.alias("delta"),
            (F.col("p_size") - F.size("p_set")).alias("common"), (F.col("opens") + F.when(linked, 0).otherwise(2 << bit)).alias("opens"),
        ),
        "differences",
    )


def _delta_lists(met: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Lists (scope, token) of the members of ``met`` by the prefixes of their differences."""
    per = 2 * sum(threshold)
    least = met.groupBy("scope").agg(F.min("e").alias("least"), F.min(F.when(~F.col("linked"), F.col("e"))).alias("least_open"))
    known = met.join(least.where("least_open is not null"), "scope")  # all are linked elsewhere
    required = F.greatest(F.lit(1), F.ceil((F.col("e") + F.when(F.col("linked"), F.col("least_open")).otherwise(F.col("least"))) / per)).cast("int")
    known = known.withColumn("keep", F.col("n") - required + 1)
    each = known.select("scope", "name", F.explode("delta").alias("token"))
    times = each.groupBy("scope", "token").agg(F.count("*").alias("times")).where("times > 1")
    ordered = each.join(times, ["scope", "token"]).groupBy("scope", "name").agg(F.array_sort(F.collect_list(F.struct("times", "token"))).alias("ordered"))
    ordered = known.join(ordered, ["scope", "name"], "left").withColumn("ordered", F.coalesce("ordered", F.array().cast(ordered.schema["ordered"].dataType)))
    alone = F.col("n") - F.col("common") - F.size("ordered")  # elements that no other member has come first
    take = F.greatest(F.lit(0), F.col("keep") - alone)
    own = F.transform(F.slice("ordered", F.lit(1), F.least(take, F.size("ordered"))), lambda t: t["token"])
    everybody = F.when((take > F.size("ordered")) & (F.col("common") > 0), F.array(F.lit(None).cast("long"))).otherwise(F.array().cast("array<long>"))
    of = ordered.select("scope", "name", "opens", "weight", "size", "e", (F.size("delta") + F.col("common")).alias("most"), F.explode(F.concat(own, everybody)).alias("token"))
    return of.withColumn("token", F.struct(F.coalesce("token", F.lit(0)).alias("value"), F.col("token").isNull().alias("everybody")))


def _open_pairs(lists: DataFrame, bit: int, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of the lists that are not known to be connected and may be similar. One of each is open in the last scope."""
    num, den = threshold
    both = 2 * (num + den)
    wanted = (2 << bit) - 2
    a, b = (lists.select("scope", "token", F.col("name").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("opens", "size", "e", "most"))) for x in "ab")
    a = a.where(F.col("a_opens").bitwiseAND(F.lit(1 << bit)) != 0)
    once = (F.col("b_opens").bitwiseAND(F.lit(1 << bit)) == 0) | (F.col("a") < F.col("b"))
    unknown = F.col("a_opens").bitwiseOR(F.col("b_opens")).bitwiseAND(F.lit(wanted)) == wanted
    fits = (F.least("a_size", "b_size") * den >= F.greatest("a_size", "b_size") * num) & (F.least("a_most", "b_most") * both >= F.col("a_e") + F.col("b_e"))
    met = a.join(b, (a.scope == b.scope) & (a.token == b.token) & (F.col("a") != F.col("b")) & once & unknown & fits)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def crowd_pairs(crowds: DataFrame, sets: DataFrame, threshold: tuple[int, int], pairwise: int) -> tuple[DataFrame, DataFrame]:
    """(links, candidate pairs) that connect all similar members of the lists of ``crowds`` (token, name, size, weight)."""
    crowds = crowds.select(F.lit(0).cast("long").alias("scope"), "token", "name", "size", "weight", F.lit(0).cast("long").alias("opens"))
    links, pairs = [], []
    for bit in range(ROUNDS):
        met = _differences(crowds, sets, bit, threshold)
        links.append(met.where("linked").select(F.col("pivot").alias("a"), F.col("name").alias("b")))
        lists = stage(_delta_lists(met, threshold), "deltas")
        opens = F.count_if(F.col("opens").bitwiseAND(F.lit(2 << bit)) != 0)
        sizes = lists.groupBy("scope", "token").agg(F.count("*").alias("n"), opens.alias("n_open")).where("n > 1 and n_open > 0")
        # A few open members against many others are as many pairs as members, or few times that.
        crowded = (F.col("n") > pairwise) & (F.col("n_open") > max(1, pairwise // 8)) & F.lit(bit < ROUNDS - 1)
        pairs.append(_open_pairs(lists.join(sizes.where(~crowded).select("scope", "token"), ["scope", "token"], "left_semi"), bit + 1, threshold))
        crowds = lists.join(sizes.where(crowded).select("scope", "token"), ["scope", "token"], "left_semi")
        if crowds.isEmpty():
            break
    return links, pairs


def similar_links(found: DataFrame, threshold: tuple[int, int] = THRESHOLD, pairwise: int = PAIRWISE, first: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Links (a, b) between names of ``prefixes``: all similar pairs of uncrowded lists, and as many of crowded ones as connect the same sets.

    ``first`` makes links (a < b), verified ones, from the distinct sets; they are not verified again here.
    """
    num, den = threshold
    sets = stage(found.where("n_prefix > 0").select("name", "size", "first", "n_prefix", "weight", "shared", "parts").dropDuplicates(["name"]), "sets")
    posts = sets.select("name", "size", "weight", "first", F.posexplode(F.slice("shared", F.lit(1), F.col("n_prefix"))).alias("at", "token"))
    posts = posts.select("token", "name", "size", "weight", (F.col("first") + F.col("at")).alias("rank"))
    met = stage(_sized(posts, ["token"]), "met")
    # Crowded lists lose the members that none of the list's sizes, at its least rank, can reach.
    crowded = met.where(F.col("n") > pairwise).drop("n")
    sizes = crowded.groupBy("token", F.col("size").alias("other")).agg(F.min("rank").alias("least"))
    kinds = crowded.select("token", "size", "rank").distinct().alias("k")
    reach = _reach("size", "other", _left(F.col("size"), F.col("rank"), F.col("other"), F.col("least")), threshold)
    alive = kinds.join(sizes.alias("s"), (F.col("k.token") == F.col("s.token")) & reach, "left_semi")
    alive = stage(_sized(crowded.join(alive, ["token", "size", "rank"], "left_semi"), ["token"]), "alive")
    few = met.where(F.col("n") <= pairwise).unionByName(alive.where(F.col("n") <= pairwise))
    a, b = (few.select("token", *(F.col(c).alias(x + c) for c in ("name", "size", "rank"))) for x in ("a_", "b_"))
    fits = _reach("a_size", "b_size", _left(F.col("a_size"), F.col("a_rank"), F.col("b_size"), F.col("b_rank")), threshold)
    pairs = [a.join(b, (a.token == b.token) & (F.col("a_name") < F.col("b_name")) & fits).select(F.col("a_name").alias("a"), F.col("b_name").alias("b"))]
    links, many = [], alive.where(F.col("n") > pairwise)
    if not many.isEmpty():
        many = many.withColumn("token", F.struct(F.col("token").alias("value"), F.lit(False).alias("everybody")))
        links, more = crowd_pairs(many, sets, threshold, pairwise)
        pairs += more
    candidates = pairs[0]
    for more in pairs[1:]:
        candidates = candidates.unionByName(more)
    candidates = candidates.distinct()
    if first is not None:
        known = first(sets)
        candidates = candidates.join(known, ["a", "b"], "left_anti")
        links = [*links, known]
    out = verified(stage(candidates, "candidates"), sets, threshold)
    for more in links:
        out = out.unionByName(more)
    return out


def ngram_components(docs: DataFrame, key: str, text: str = "text", words: int = WORDS, threshold: tuple[int, int] = THRESHOLD, pairwise: int = PAIRWISE) -> DataFrame:
    """key, name (of the set), size and component_id (the smallest key reachable) of every row."""
    found = prefixes(docs, key, text, words, threshold)
    rows = found.select("key", F.col("name").alias("fp"), "size")
    links = similar_links(found, threshold, pairwise)
    named = rows.join(component_keys(rows.where("fp is not null"), "key", links), "fp").select("key", F.col("fp").alias("name"), "size", "component_id")
    return named.unionByName(rows.where("fp is null").select("key", F.col("fp").alias("name"), "size", F.col("key").alias("component_id")))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_components(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return found.select(F.col("key").alias("doc_id"), F.col("size").cast("long").alias("n_shingles"), "component_id")


SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
each AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reached AS (SELECT doc_id, doc_id AS other FROM sizes UNION SELECT doc_id, b FROM reached JOIN links ON a = other)
SELECT doc_id, any_value(n) AS n_shingles, min(other) AS component_id FROM reached JOIN sizes USING (doc_id) GROUP BY doc_id
"""
