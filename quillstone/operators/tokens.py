"""Token arrays: truncation, padding, vocabulary, coverage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quillstone.sources.scratch import materialised


def _slice(a: Column, start: Column | int, n: Column) -> Column:
    return F.slice(a, start if isinstance(start, Column) else F.lit(start), F.greatest(n.cast("int"), F.lit(0)))


def head_tail(title: Column, body: Column, max_length: int = 512, head_share: float = 0.35, marker: str = "...", cls: str = "<s>", sep: str = "</s>") -> Column:
    """CLS title SEP SEP body SEP, the body cut to its head, a marker and its tail where it is too long."""
    room = max_length - 4
    title = _slice(title, 1, F.lit(max(8, room // 2)))
    budget = F.lit(room) - F.size(title)
    usable = budget - 1
    head = F.greatest(F.lit(1), F.floor(usable * head_share)).cast("int")
    tail = F.greatest(F.lit(1), usable - head).cast("int")
    both = F.concat(_slice(body, 1, head), F.array(F.lit(marker)), F.slice(body, F.size(body) - tail + 1, tail))
    cut = F.when(F.size(body) <= budget, body).when(budget <= 1 + 4, _slice(body, 1, budget)).otherwise(both)
    one, two = F.array(F.lit(sep)), F.array(F.lit(sep), F.lit(sep))
    return F.slice(F.concat(F.array(F.lit(cls)), title, two, cut, one), 1, max_length)


def cut_by_ratio(tokens: Column, max_len: int = 477, ratio: float = 0.5, zero_label_ratio: float | None = None, label: Column | None = None) -> Column:
    """Head and tail by ratio. A ratio that depends on the label leaks it and is off unless given."""
    def cut(r: float) -> Column:
        head = int(max_len * r)
        return F.concat(F.slice(tokens, 1, head), F.slice(tokens, F.size(tokens) - (max_len - head) + 1, max_len - head))

    out = cut(ratio) if zero_label_ratio is None or label is None else F.when(label == 0, cut(zero_label_ratio)).otherwise(cut(ratio))
    return F.when(F.size(tokens) <= max_len, tokens).otherwise(out)


def fixed_length(ids: Column, n_title: Column, length: int = 512, pad: int = 1) -> dict[str, Column]:
    """input_ids, attention_mask and segment_ids of one length."""
    kept = F.slice(ids, 1, length)
    n = F.size(kept)
    gap = F.lit(length) - n
    segments = F.concat(F.array_repeat(F.lit(0), F.least(n_title, n)), F.array_repeat(F.lit(1), F.greatest(n - n_title, F.lit(0))), F.array_repeat(F.lit(0), gap))
    return {"input_ids": F.concat(kept, F.array_repeat(F.lit(pad), gap)), "attention_mask": F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), gap)), "segment_ids": segments}


def vocabulary(df: DataFrame, words: str, top: int = 32000, min_frequency: int = 2, special: tuple[str, ...] = ("[PAD]", "[UNK]", "[CLS]", "[SEP]")) -> DataFrame:
    """term, n, term_id: special tokens first, then by frequency. At most ``top`` rows."""
    from pyspark.sql import Window

    counts = df.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= min_frequency)
    best = counts.orderBy(F.desc("n"), "term").limit(top - len(special))
    numbered = best.withColumn("term_id", F.row_number().over(Window.orderBy(F.desc("n"), "term")) + len(special) - 1)
    names = df.sparkSession.range(1).select(F.posexplode(F.array(*(F.lit(s) for s in special))).alias("term_id", "term"))
    return numbered.unionByName(names.select("term", F.lit(0).cast("long").alias("n"), "term_id"))


#: Bytes of a vocabulary that is handed to every worker.
MOST_BROADCAST = 64 << 20


def to_ids(df: DataFrame, key: str, words: str, vocab: DataFrame, unknown: int = 1, most: int = MOST_BROADCAST) -> DataFrame:
    """key and ids of each row."""
    return with_ids(df.select(key, words), words, vocab, unknown, "ids", most).select(key, "ids")


def with_ids(df: DataFrame, words: str, vocab: DataFrame, unknown: int = 1, out: str = "ids", most: int = MOST_BROADCAST) -> DataFrame:
    """``df`` with the ids of its array ``words``, in order; unknown and null words get ``unknown``, a null array stays null.

    Each row is looked up by itself, so that repeated and null keys stay apart. A vocabulary of up to ``most`` bytes goes to the
    workers, which look up a batch's words at once; a larger one is joined to the rows' distinct words.
    """
    terms = vocab.select("term", F.col("term_id").cast("int").alias("term_id"))
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()[0]
    return _looked_up(df, words, terms, unknown, out) if size <= most else _joined_ids(df, words, terms, unknown, out)


def _looked_up(df: DataFrame, words: str, terms: DataFrame, unknown: int, out: str) -> DataFrame:
    known = terms.toArrow()
    of = df.sparkSession.sparkContext.broadcast((known.column("term").combine_chunks(), known.column("term_id").combine_chunks()))
    schema = StructType([*(f for f in df.schema.fields if f.name != out), StructField(out, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids = of.value
        for batch in batches:
            lists = batch.column(words)
            flat = lists.flatten()
            found = pc.fill_null(pc.take(ids, pc.index_in(flat, value_set=names.cast(flat.type), skip_nulls=True)), unknown)
            stops = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))
            made = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), found, mask=pc.is_null(lists))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema.fields[:-1]), made], schema.names)

    return df.mapInArrow(run, schema)


def _joined_ids(df: DataFrame, words: str, terms: DataFrame, unknown: int, out: str) -> DataFrame:
    """Rows are numbered in a written table, and the ids of a row's distinct words come back to it as a map."""
    rows = materialised(df.drop(out).withColumn("_row", F.monotonically_increasing_id()), "rows")
    each = rows.select("_row", F.explode(F.array_distinct(words)).alias("term")).join(terms, "term")
    known = each.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("term", "term_id"))).alias("_of"))
    ids = F.transform(words, lambda w: F.coalesce(F.when(w.isNotNull(), F.element_at(F.coalesce("_of", F.create_map().cast("map<string,int>")), w)), F.lit(unknown)))
    return rows.join(known, "_row", "left").withColumn(out, ids).drop("_row", "_of")


def encoded_pairs(df: DataFrame, vocab: DataFrame, title: str, body: str, length: int = 512, pad: int = 0, separator: int = 3) -> DataFrame:
    """``df`` with, in place of title and body, input_ids, attention_mask and segment_ids of title words, a separator (both segment 0) and body words (segment 1)."""
    # The vocabulary is counted once and looked up for title and body; no word beyond ``length`` has a place in the result.
    vocab = materialised(vocab.select("term", "term_id"), "vocabulary")
    kept = [c for c in df.columns if c not in (title, body)]
    words = df.select(*kept, F.slice(title, 1, length).alias(title), F.slice(body, 1, length).alias(body))
    found = with_ids(with_ids(words, title, vocab, out="_title"), body, vocab, out="_body")
    ids = F.concat(F.coalesce("_title", F.array().cast("array<int>")), F.array(F.lit(separator)), F.coalesce("_body", F.array().cast("array<int>")))
    return found.withColumns(fixed_length(ids, F.coalesce(F.size(F.coalesce("_title", F.array().cast("array<int>"))), F.lit(0)) + 1, length, pad)).drop("_title", "_body", title, body)


def coverage(df: DataFrame, length: str, limits: tuple[int, ...] = (128, 256, 384, 512)) -> DataFrame:
    return df.agg(*(F.avg((F.col(length) <= t).cast("int") * 100).alias(f"coverage_{t}") for t in limits))
