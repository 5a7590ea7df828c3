"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item of q distinct five-word shingles is contained in a document when at least ceil(t * q) of them
are in it. The item's sketch is its q - ceil(t * q) + 1 smallest shingle hashes: a document that contains
the item has at least one of them, so that the search misses nothing. Items are partitioned by size into
powers of two. A document is searched only for the sizes that fit it, and only with those of its shingles
whose hash is no larger than the largest sketch value of these sizes, the minimum-wise sample of the
document. What meets is a candidate; candidates are verified by counting the item's shingles exactly.

All of it is DataFrame functions. Words are case-folded runs outside space and U+0009-U+000D. Items of
fewer than five words have one shingle, all their words, held against the documents' shingles of that width.

Edges: null or empty texts and items have no shingles and match nothing; repeated rows match alike; rows
of one doc_id with different texts are judged by text, and so are items of one item_id, each of which has a
row of its own in the result; a null doc_id or item_id is an id like any other; an empty table on either
side gives no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.quality import _cut, words_of
from quillstone.llm.storage import bytes_of, cut, read, same, small

WIDTH, THRESHOLD = 5, 0.8
#: What tells documents and items apart.
DOC, ITEM = ["doc_id", "text_hash"], ["item_id", "item_hash"]


def shingles(words: Column, width: int) -> Column:
    """The windows of ``width`` words as an array of structs w0, w1, ..."""
    return F.arrays_zip(*(_cut(words, i, width - 1).alias(f"w{i}") for i in range(width)))


def _fields(name: str, width: int) -> list[Column]:
    return [F.col(f"{name}.w{i}") for i in range(width)]


def item_shingles(items: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """One row per distinct shingle of an item: width, h, its text s, the item's q and needed count, and its rank by h."""
    words = items.where(F.col(text).isNotNull()).select(F.col(key).alias("item_id"), F.xxhash64(text).alias("item_hash"), words_of(F.lower(text)).alias("w"))
    found = None
    for width in range(1, WIDTH + 1):
        own = words.where(F.size("w") == width if width < WIDTH else F.size("w") >= width)
        one = own.select(*ITEM, F.explode(shingles(F.col("w"), width)).alias("z"))
        one = one.select(*ITEM, F.lit(width).alias("width"), F.xxhash64(*_fields("z", width)).alias("h"), F.concat_ws(" ", *_fields("z", width)).alias("s")).distinct()
        found = one if found is None else found.unionByName(one)
    sized = found.groupBy(*ITEM).agg(F.count("*").alias("q"), F.array_sort(F.collect_list(F.struct("h", "s", "width"))).alias("all"))
    # A hair is taken off before rounding up: 0.8 * 35 is 28, whatever the doubles say.
    need = F.ceil(F.col("q") * F.lit(threshold) - F.lit(1e-9)).cast("int")
    return sized.select(*ITEM, "q", need.alias("need"), F.posexplode("all").alias("rank", "x")).select(*ITEM, "q", "need", "rank", "x.h", "x.s", "x.width")


def find_contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, item_id, n_shingles, n_found, containment) of every item contained in a document."""
    listed = cut(item_shingles(items, item_key, item_text, threshold))
    sketch = listed.where("rank <= q - need")
    # One row per width and power of two of the size: a few dozen at the most.
    classes = sketch.groupBy("width", F.floor(F.log2("q")).alias("power")).agg(F.max("h").alias("top"), F.min("need").alias("least")).collect()
    n_bytes = bytes_of(listed)
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    schema = "doc_id bigint, text_hash bigint, item_id bigint"

    candidates = None
    for width in sorted({c["width"] for c in classes}):
        own = [c for c in classes if c["width"] == width]
        size = F.size("w") - width + 1
        # The largest hash worth looking up in a document of this size; null if no item fits it.
        top = F.greatest(*(F.when(size >= c["least"], c["top"]) for c in own), F.lit(None).cast("long"))
        words = texts.select("doc_id", "text_hash", words_of(F.lower("text")).alias("w"))
        sized = words.select("doc_id", "text_hash", "w", size.alias("size"), top.alias("top")).where("top is not null")
        hashed = sized.select("doc_id", "text_hash", "size", "top", F.explode(shingles(F.col("w"), width)).alias("z"))
        hashed = hashed.select("doc_id", "text_hash", "size", F.xxhash64(*_fields("z", width)).alias("h"), "top").where("h <= top")
        wanted = sketch.where(F.col("width") == width).select(F.col("h").alias("ih"), *ITEM, "need")
        met = hashed.join(small(wanted, n_bytes), (F.col("h") == F.col("ih")) & (F.col("size") >= F.col("need")))
        met = met.select(*DOC, *ITEM, F.lit(width).alias("width")).distinct()
        candidates = met if candidates is None else candidates.unionByName(met)
    if candidates is None:
        return docs.sparkSession.createDataFrame([], f"{schema}, n_shingles bigint, n_found bigint, containment double")
    candidates = cut(candidates)
    n_candidates = bytes_of(candidates)

    verified = None
    for width in sorted({c["width"] for c in classes}):
        at = candidates.where(F.col("width") == width).select("doc_id", "text_hash").distinct()
        # Few documents are candidates: their keys go to the texts, and only these texts move.
        again = texts.alias("t").join(small(at, n_candidates).alias("c"), same("t", "c", DOC), "left_semi").dropDuplicates(DOC)
        rows = again.select("doc_id", "text_hash", F.explode(shingles(words_of(F.lower("text")), width)).alias("z"))
        rows = rows.select("doc_id", "text_hash", F.concat_ws(" ", *_fields("z", width)).alias("ds"))
        wanted = listed.where(F.col("width") == width).select(*ITEM, "q", "need", "s", "rank")
        hits = rows.join(small(wanted, n_bytes), F.col("ds") == F.col("s"))
        counted = hits.groupBy(*DOC, *ITEM, "q", "need").agg(F.count_distinct("rank").alias("n_found"))
        full = counted.where("n_found >= need").alias("f").join(candidates.alias("c"), same("f", "c", [*DOC, *ITEM]), "left_semi")
        verified = full if verified is None else verified.unionByName(full)
    return verified.select("doc_id", "text_hash", "item_id", F.col("q").alias("n_shingles"), "n_found", (F.col("n_found") / F.col("q")).alias("containment"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_found")


SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split(translate(lower(text), chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
items AS (
  SELECT item_id, list_filter(string_split(translate(lower(text), chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item_id, w, least(len(w), 5) AS width FROM items WHERE len(w) > 0),
d AS (SELECT DISTINCT doc_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i+width-1], ' '))) AS s FROM words, (SELECT DISTINCT width FROM sized)),
b AS (SELECT DISTINCT item_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i+width-1], ' '))) AS s FROM sized),
q AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY 1)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found
FROM d JOIN b USING (width, s) JOIN q USING (item_id) GROUP BY 1, 2, 3 HAVING count(*) >= ceil(n_shingles * 0.8 - 1e-9)
"""


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that contain no benchmark item."""
    found = cut(find_contained(docs, read(spark, sf_dir, "benchmark")).select("doc_id", "text_hash").distinct())
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    return keyed.alias("k").join(small(found, bytes_of(found)).alias("f"), same("k", "f", DOC), "left_anti").select("doc.*")
