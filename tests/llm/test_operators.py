"""Operators against brute force on small tables, with nulls, repeats, ties, empty tables and extra columns."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillstone.llm import bpe, decontamination, html_text, quality, queries, sharding, simhash, suffix_dedup, token_counts, token_store, tokens, url_filters
from tests.conftest import SMALL

ODD = [
    None, "", " \t\n", "word", "two words", "a b c", "a b c", "the quick brown fox jumps over the lazy dog " * 30, "Ünïcode ÉTÉ ß 中文 🙂 <|endoftext|> don't I'LL",
    "x" * 700, "x" * 700 + "y", "the quick brown fox jumps over the lazy dog " * 30, "ab " * 400, "one\ntwo\none\n\ntwo #*$%&|<>", "!" * 300,
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, spans string, row string, k1 string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", len(t or ""), 7, "clash", "r", "k") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[7], (None, "a null key", None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


@pytest.fixture(scope="module")
def library():
    return tokens.library_tokenizer(tokens.vocabulary_path())


def test_bpe_equals_library(spark, odd, empty, library):
    for r in bpe.encode_decode(odd).collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want
        assert r.decoded == library.decode(want, skip_special_tokens=False)
        assert r.shard in (7, None)
    assert bpe.encode_decode(empty).count() == 0


def split_ids(coder, texts):
    ids, sizes = coder.texts(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_bpe_words(docs, library):
    coder = bpe.trie_ids(tokens.vocabulary_path())
    texts = list(docs.values())
    for own, want in zip(split_ids(coder, texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own == want.ids


def test_bpe_query(spark, docs, library):
    for r in queries.QUERIES["op5_bpe"](spark, SMALL).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_words_kept_are_bounded(library):
    coder = tokens.WordIds(lambda words: (library.encode(w, add_special_tokens=False).ids for w in words), kept=5)
    texts = ["alpha beta gamma", "delta epsilon zeta eta theta iota", "alpha", None, "x." * 50]
    got = split_ids(coder, texts) + split_ids(coder, texts[:2])
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts + texts[:2]]


def test_long_texts_are_sliced():
    text = ("word " * 5000 + "x" * 3000 + "\n").encode() * 3
    parts = list(tokens.slices(text, 1000))
    assert b" ".join(parts).split() == text.split() and len(parts) > 10


def test_token_store(spark, docs, library, tmp_path):
    folder = f"file://{tmp_path}/store"
    token_store.write_store(spark.read.parquet(f"{SMALL}/documents.parquet"), folder)
    sums = {r.doc_id: r for r in token_store.document_checksums(spark, folder).collect()}
    back = {r.doc_id: np.frombuffer(bytes(r.ids), "<u2").tolist() for r in token_store.read_documents(spark, folder).collect()}
    at = 0
    for i in sorted(docs):
        ids = [*library.encode(docs[i], add_special_tokens=False).ids, 1]
        assert back[i] == ids
        assert (sums[i].start, sums[i].n_tokens, sums[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    chunks = spark.read.parquet(f"{folder}/chunks")
    assert chunks.count() == chunks.select("chunk_id").distinct().count()


def test_token_store_edges(spark, odd, empty, tmp_path):
    token_store.write_store(odd, f"file://{tmp_path}/odd")
    rows = token_store.document_checksums(spark, f"file://{tmp_path}/odd").orderBy("start").collect()
    assert len(rows) == odd.count() and rows[0].start == 0
    token_store.write_store(empty, f"file://{tmp_path}/empty")
    assert token_store.document_checksums(spark, f"file://{tmp_path}/empty").count() == 0


def test_token_store_detects_damage(spark, odd, tmp_path):
    folder = f"file://{tmp_path}/store"
    token_store.write_store(odd, folder)
    chunks = spark.read.parquet(f"{folder}/chunks").withColumn("payload", F.when(F.col("n_ids") == 1, F.unhex(F.lit("0002"))).otherwise(F.col("payload")))
    chunks.write.parquet(f"{folder}/changed")
    spark.read.parquet(f"{folder}/changed").write.mode("overwrite").parquet(f"{folder}/chunks")
    with pytest.raises(Exception, match="do not match its name"):
        token_store.read_documents(spark, folder).collect()


@pytest.mark.parametrize(
    ("table", "change"),
    [
        ("recipes", lambda df: df.withColumn("root", F.when(F.col("doc_id") == 3, F.sha2(F.lit("x"), 256)).otherwise(F.col("root")))),
        ("recipes", lambda df: df.withColumn("chunk_ids", F.reverse("chunk_ids"))),
        ("recipes", lambda df: df.where("doc_id is null or doc_id <> 3")),
        ("recipes", lambda df: df.withColumn("doc_id", F.col("doc_id") + 1)),
        ("recipes", lambda df: df.withColumn("place", F.when(F.col("place") < 2, 1 - F.col("place")).otherwise(F.col("place")))),
        ("manifest", lambda df: df.withColumn("n_tokens", F.when(F.col("part") == token_store.STORE, 5).otherwise(F.col("n_tokens")))),
        ("manifest", lambda df: df.withColumn("hash", F.when(F.col("part") == token_store.STORE, "0").otherwise(F.col("hash")))),
        ("manifest", lambda df: df.where(F.col("part") == token_store.STORE)),
    ],
)
def test_token_store_detects_changes(spark, tmp_path, table, change):
    folder = f"file://{tmp_path}/store"
    token_store.write_store(spark.read.parquet(f"{SMALL}/documents.parquet"), folder)
    changed = change(spark.read.parquet(f"{folder}/{table}"))
    changed.write.parquet(f"{folder}/changed")
    spark.read.parquet(f"{folder}/changed").write.mode("overwrite").parquet(f"{folder}/{table}")
    with pytest.raises(Exception, match="does not match"):
        token_store.document_checksums(spark, folder).collect()


def test_token_store_query(spark, docs, library):
    at = 0
    for r in queries.QUERIES["op3_token_store"](spark, SMALL).orderBy("doc_id").collect():
        ids = [*library.encode(docs[r.doc_id], add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_token_counts(spark, odd, empty, block):
    plain = tokens.library_tokenizer(tokens.vocabulary_path(), True)
    files = token_counts.flat_files(odd, block=block).cache()
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(files, block=block).collect())
    assert got == Counter((r.doc_id, len(plain.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert token_counts.count_tokens(token_counts.flat_files(empty, block=block), block=block).count() == 0


def brute_fingerprint(text, n=3):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(prints):
    parent = {i: i for i, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, f in prints:
        for j, g in prints:
            if (f ^ g).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


def test_simhash_query(spark, docs):
    got = {r.doc_id: r for r in queries.QUERIES["op4_simhash"](spark, SMALL).collect()}
    prints = [(i, brute_fingerprint(t)) for i, t in docs.items()]
    want = brute_components(prints)
    for i, f in prints:
        assert got[i].fingerprint == f"{f:016x}" and got[i].component_id == want[i]


def test_simhash_long_text_by_slices(monkeypatch):
    text = "a b c d e f g h i j k l m n o p " * 40 + "end"
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "slices", lambda t: tokens.slices(t, 20))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("a b") & (1 << 64) - 1 == brute_fingerprint("a b")


@pytest.mark.parametrize("pairwise", [1, 48])
def test_simhash_links(spark, pairwise):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 62, 30)]
    prints = sorted({b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (25, 2))} | set(base) | {0, -1})
    df = spark.createDataFrame([(x,) for x in prints], "fp bigint")
    found = simhash.connected_components(simhash.near_links(df, pairwise)).collect()
    mask = (1 << 64) - 1
    want = brute_components([(x, x & mask) for x in prints])
    linked = {x for x in prints if any(x != y and ((x ^ y) & mask).bit_count() <= 2 for y in prints)}
    assert {r.node: r.component for r in found} == {x: want[x] for x in linked}


def test_near_dedup_stage(spark, odd, empty):
    kept = simhash.near_dedup_stage(spark, odd, SMALL)
    assert kept.columns == odd.columns
    rows = kept.collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    assert all((a ^ b).bit_count() > 2 for i, a in enumerate(prints) for b in prints[:i])
    assert simhash.near_dedup_stage(spark, empty, SMALL).count() == 0


def brute_removal(texts, length=200):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                covered[i : i + length] = True
        out.append(covered)
    return out


def check_removal(rows):
    texts = [(r.text or "").encode() for r in rows]
    for r, t, covered in zip(rows, texts, brute_removal(texts), strict=True):
        got = np.zeros(len(t), bool)
        for s in r.spans:
            got[s.start : s.stop] = True
        assert (got == covered).all()
        assert bytes(r.kept) == np.frombuffer(t, np.uint8)[~covered].tobytes()
        assert len(r.spans) == int((np.diff(np.concatenate(([0], covered.astype(int)))) == 1).sum())


def test_suffix_dedup(spark, odd, empty):
    check_removal(suffix_dedup.remove_repeats(spark.read.parquet(f"{SMALL}/documents.parquet")).collect())
    check_removal(suffix_dedup.remove_repeats(odd).collect())
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert suffix_dedup.suffix_dedup_stage(spark, odd, SMALL).columns == odd.columns


def test_suffix_dedup_of_hot_keys(spark, monkeypatch):
    """A frequent line among ever different text, a frequent passage, and many copies, all of them over the bound."""
    monkeypatch.setattr(suffix_dedup, "LEAST_HOT", 3)
    rng = np.random.default_rng(4)
    word = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    line, passage = word(150), word(260)
    texts = [word(120 + i) + line + word(130) for i in range(40)] + [word(90) + passage + word(i) for i in range(30)]
    texts += [word(300)] * 25 + [texts[0][:290] + word(40), passage[:210], None]
    check_removal(suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect())


def test_suffix_dedup_query(spark, docs):
    raw = {i: t.encode() for i, t in docs.items()}
    cover = dict(zip(raw, brute_removal(list(raw.values())), strict=True))
    for r in queries.QUERIES["op6_suffix_dedup"](spark, SMALL).collect():
        own = cover[r.doc_id]
        assert (r.n_bytes, r.n_removed) == (len(own), own.sum()) and r.n_spans == int((np.diff(np.concatenate(([0], own.astype(int)))) == 1).sum())
        assert r.kept_sha256 == hashlib.sha256(np.frombuffer(raw[r.doc_id], np.uint8)[~own].tobytes()).hexdigest()


def test_suffix_dedup_over_pieces(monkeypatch):
    data = bytes(np.random.default_rng(1).integers(97, 110, 3000, dtype=np.uint8))
    want = suffix_dedup.anchors_of(data)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    (h, s, n), x = suffix_dedup.anchors_of(data)
    windows = {(int(a), int(b) + i) for a, b, c in zip(h, s, n, strict=True) for i in range(c - 199)}
    assert windows == {(int(a), int(b) + i) for a, b, c in zip(*want[0], strict=True) for i in range(c - 199)} and len(x) == len(h)


@pytest.mark.parametrize("memory_rows", [8, 50, 1_000_000])
def test_induced_sort(memory_rows):
    from quillstone.llm.induced_sort import repeated_places

    rng = np.random.default_rng(memory_rows)
    for _ in range(60):
        length, letters = int(rng.choice([1, 2, 3, 5, 8, 20])), int(rng.choice([1, 2, 3, 5]))
        strings = [bytes(rng.integers(1, letters + 1, int(rng.integers(0, 40)), dtype=np.uint8)) for _ in range(rng.integers(1, 6))]
        strings.append(strings[0][:10] + strings[-1])
        text = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8)
        seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        want = [seen[w] > 1 if 0 not in (w := bytes(text[i : i + length])) and len(w) == length else False for i in range(len(text))]
        assert repeated_places(text, length, memory_rows).tolist() == want


def brute_contained(docs, items, t=0.8):
    def sh(text, n):
        w = (text or "").lower().split()
        return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}

    out = set()
    for i, text in items:
        n = min(5, len((text or "").split()))
        own = sh(text, n) if n else set()
        for d, x in docs:
            found = len(own & sh(x, n)) if own else 0
            if own and found >= t * len(own) - 1e-9:
                out.add((d, i, len(own), found))
    return out


def test_decontamination(spark, odd, empty):
    items = [(1, "the quick brown fox jumps over the lazy dog"), (2, "two words"), (3, None), (4, ""), (5, "no such words in any of them at all"), (6, "a b c")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in decontamination.find_contained(odd, bench).collect()}
    assert got == brute_contained([(r.doc_id, r.text) for r in odd.where("doc_id is not null").collect()], items)
    assert decontamination.find_contained(empty, bench).count() == 0
    assert decontamination.find_contained(odd, bench.limit(0)).count() == 0


def test_decontamination_query(spark, docs):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = {tuple(r) for r in queries.QUERIES["op8_decontamination"](spark, SMALL).select("doc_id", "item_id", "n_shingles", "n_found").collect()}
    assert got == brute_contained(list(docs.items()), bench)
    docs_df = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r.doc_id for r in decontamination.decontaminate_stage(spark, docs_df, SMALL).collect()}
    assert kept == set(docs) - {d for d, *_ in got}


URLS = [None, "", "no scheme", "http://EXAMPLE.com/en/x", "https://www.example.com/en/y?q=/es/", "http://a.b.net/es/1#f", "http://net/fr/", "http://com", "http://com/", "ftp://notexample.com/en/", "x://y.net?z/es/", "http://spam-farm.example.org/q", "http://://x"]


def brute_url(url, rules=url_filters.RULES, sites=url_filters.SITES, keys=()):
    import re

    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(url_filters.UPPER, url_filters.LOWER)), m[2]) if m else ("", "")
    on = lambda h: host == h or host.endswith("." + h)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if on(h) and path.startswith(p)]
    bad = any(map(on, sites)) or bool(host) and host + path in keys
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "block" if bad else "allow")


def test_url_filters(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*URLS, URLS[3]])], "page_id bigint, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(pages).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate([*URLS, URLS[3]])}
    assert url_filters.filter_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("max_bits", [64, url_filters.MAX_BITS])
def test_url_list_of_any_size(spark, max_bits):
    """A listed table is exact as a cascade, and as a join where a level would be too large."""
    urls = [*URLS, *(f"https://h{i % 7}.example.org/p/{i % 400}?q={i}" for i in range(900))]
    keys = {f"h{i % 7}.example.org/p/{i}" for i in range(0, 400, 3)} | {"a.b.net/es/1"}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    listed = spark.createDataFrame([(k,) for k in [*sorted(keys), "nowhere.example/x", None, min(keys)]], "key string")
    universe = pages.select(url_filters.page_key(*url_filters.host_and_path(F.col("url"))).alias("key"))
    assert (url_filters.build_cascade(listed, universe, max_bits) is None) == (max_bits == 64)
    got = url_filters.filter_urls(pages, rules=url_filters.RULES[3:], sites=(), listed=listed, max_bits=max_bits) if max_bits > 64 else url_filters.filter_urls(pages, rules=(), sites=(), listed=listed, max_bits=64)
    rules = url_filters.RULES[3:] if max_bits > 64 else ()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {i: brute_url(u, rules, (), keys) for i, u in enumerate(urls)}


def test_url_query(spark):
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    keys = {h + p for r in rows if len(r.html or "") < url_filters.THIN for h, p, *_ in [brute_url(r.url)] if h}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.QUERIES["op1_url_filters"](spark, SMALL).collect()}
    assert got == {r.page_id: brute_url(r.url, keys=keys) for r in rows}


def test_cascade_is_exact(spark):
    keys = spark.range(20000).select(F.md5(F.col("id").cast("string")).alias("key"))
    listed = keys.where(F.conv(F.left("key", F.lit(2)), 16, 10).cast("int") < 10)
    cascade = url_filters.build_cascade(listed, keys)
    wrong = keys.where(cascade.contains(F.col("key")) != (F.conv(F.left("key", F.lit(2)), 16, 10).cast("int") < 10))
    assert len(cascade.levels) > 2 and wrong.count() == 0


def test_sharding(spark, odd, empty):
    tree = sharding.shard_tree(40)
    rows = spark.range(20000).select(F.col("id").alias("doc_id"))
    got = sharding.assign_shards(rows, "doc_id", tree).withColumn("grown", sharding.shard_of(F.col("doc_id"), sharding.add_shard(tree))).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown in (r.shard, 40)
    assert set(by) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert 350 < sum(r.grown == 40 for r in got) < 650
    heavy = [x._replace(weight=3.0) if x.shard == 39 else x for x in tree]
    moved = rows.select(sharding.shard_of(F.col("doc_id"), tree).alias("a"), sharding.shard_of(F.col("doc_id"), heavy).alias("b")).where("a <> b").collect()
    assert moved and all(r.b >= 20 for r in moved)  # only into the region whose weight grew
    assert all(r.b == 39 for r in moved if r.a >= 35)
    assert sharding.assign_shards(odd, "doc_id", tree).count() == odd.count()
    assert sharding.assign_shards(empty, "doc_id", tree).count() == 0


def brute_shard(key, tree):
    """Region, rack and shard in turn: the least -ln(u) / weight of each child's hash of key and name."""

    def mix(value, seed):
        return xxhash.xxh64_intdigest(value, seed)

    def draw(child, weight):
        first = 42 if key is None else mix(key.to_bytes(8, "little", signed=True), 42)
        u = ((mix(child.encode(), first) >> 12) + 0.5) / (1 << 52)
        return -np.log(u) / weight, child

    at = ""
    for depth in range(3):
        children = {}
        for leaf in tree:
            path = ["", leaf.region, f"{leaf.region}/{leaf.rack}", f"{leaf.region}/{leaf.rack}/{leaf.shard}"]
            if path[depth] == at:
                children[path[depth + 1]] = children.get(path[depth + 1], 0.0) + leaf.weight
        at = min(draw(c, w) for c, w in children.items())[1]
    return int(at.rsplit("/", 1)[1])


def test_sharding_query(spark, tmp_path):
    """The whole query by brute force, with null and repeated ids, null and equal texts."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows += [(None, "no id"), (None, None), (3, "again"), (3, "again"), (-5, "é" * 9), (10**12, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tree = sharding.shard_tree(40)
    want = Counter()
    for i, t in rows:
        raw = (t or "").encode()
        want[i, len(raw) + 16, zlib.crc32(raw), "key", brute_shard(i, tree), brute_shard(i, sharding.add_shard(tree))] += 1
    got = queries.QUERIES["op2_sharding"](spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    assert all(r.grown_shard in (r.shard, 40) for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_token_counts_query(spark, docs):
    plain = tokens.library_tokenizer(tokens.vocabulary_path(), True)
    got = {r.doc_id: r.n_tokens for r in queries.QUERIES["op7_token_counts"](spark, SMALL).collect()}
    assert got == {i: len(plain.encode(t, add_special_tokens=False).ids) for i, t in docs.items()}


def brute_quality(text):
    text = text or ""
    w = [x for x in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if x]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\v\f\r"):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality(spark, docs, odd, empty):
    for r in queries.QUERIES["op10_quality_rules"](spark, SMALL).collect():
        want = brute_quality(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.kept and r.base_failed)
    for r in quality.base_signals(odd, ["text"]).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(r.text)
    assert quality.quality_stage(spark, odd, SMALL).columns == odd.columns
    assert quality.quality_stage(spark, empty, SMALL).count() == 0


def test_quality_follows_labels(spark):
    sf = SMALL.replace("0.001", "0.01")
    got = queries.QUERIES["op10_quality_rules"](spark, sf).select("doc_id", "kept", "base_failed")
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(3)
    right = {"a": (0.95, 0.9), "b": (0.9, 0.6), "c": (0.97, 0.4), "d": (0.9, 0.8)}
    counts = Counter()
    for _ in range(20000):
        y = rng.random() < 0.8
        counts[tuple(None if rng.random() < 0.2 else int(y if rng.random() < (g if y else b) else not y) for g, b in right.values())] += 1
    model = quality.fit_label_model([(dict(zip(right, k, strict=True)), n) for k, n in sorted(counts.items(), key=str)], list(right))
    assert abs(model.prior - 0.8) < 0.05
    assert all(abs(model.right_good[k] - g) < 0.04 and abs(model.right_bad[k] - b) < 0.08 for k, (g, b) in right.items())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a> menu</nav><header>Site</header>
<div class="ad">Buy now the best of all things</div><div id="cookie-notice">We use cookies</div><aside>Side</aside>
<article><h1>Head &amp; line</h1><p>First   par&eacute;graph<br>goes on.<p>Second <b>bold</b>ed &lt;tag&gt;.</p><script>var x="</p><p>no";</script><div class="share-buttons">Share</div>
<ul><li>Item</ul><form>Mail <input></form><!-- <p>hidden</p> --></article><section class="comments"><p>Reader says</p></section><footer>&copy; end</footer></body></html>"""


def test_html(spark):
    assert html_text.main_text(PAGE) == "Head & line\nFirst parégraph goes on.\nSecond bolded <tag>.\nItem"
    assert html_text.main_text(None) == html_text.main_text("") == ""
    long = "the cat is on the mat and the dog is in the house with a bone " * 5
    bare = f"<div><a href=x>Home</a> <a href=y>News</a></div><p>{long}</p><p>Short one.</p><p>{long}</p><div>Copyright</div>"
    assert html_text.main_text(bare).split("\n")[:3] == [long.strip(), "Short one.", long.strip()]
    assert "Home" not in html_text.main_text(bare)
    df = spark.createDataFrame([(1, PAGE, "clash"), (2, None, "x"), (3, "", "y"), (1, PAGE, "clash")], "page_id int, html string, text string")
    assert Counter((r.page_id, len(r.text)) for r in html_text.extract(df).collect()) == Counter([(1, 62), (2, 0), (3, 0), (1, 62)])
    assert html_text.extract(df.limit(0)).count() == 0


def article_text(page):
    import html
    import re

    inside = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", inside))).split())


def test_html_without_article_tags(spark):
    """The two passes alone find the articles' text and none of what stands around it."""
    kept = total = 0
    for r in spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/pages.parquet").collect():
        article = set(html_text.main_text(r.html).split("\n"))
        found = [b for b in html_text.main_text(r.html.replace("<article>", "<div>").replace("</article>", "</div>")).split("\n") if b]
        assert set(found) <= article
        kept, total = kept + sum(map(len, found)), total + sum(map(len, article))
    assert kept >= 0.95 * total


def test_html_rules_decide_inside_an_article():
    text = "the cat is on the mat and the dog is in the house with a bone"
    links = "".join(f"<a href=x>Another page about number {i}</a> " for i in range(6))
    page = f"<article><p>{text} {text}</p><p>Short.</p><div>{links}</div><p>{text} {text}</p></article><div>{text} {text}</div>"
    assert html_text.main_text(page) == f"{text} {text}\nShort.\n{text} {text}"


@pytest.mark.parametrize("page", ["<div>x" * 50_000, "<b>x" * 50_000, '<a "' * 50_000, '<a "' * 50_000 + ">", "<i>" * 30_000 + "<b>" * 30_000 + "</i>" * 30_000, "<![CDATA[>" * 50_000, "<!-- " * 50_000, "< " * 50_000, "<head>" * 50_000, "</div>x" * 50_000])
def test_html_takes_linear_time(page):
    import time

    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 3


def test_html_query_keeps_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in queries.QUERIES["op9_html_text"](spark, SMALL).collect():
        want = article_text(pages[r.page_id])
        assert r.text.replace("\n", " ") == want and r.n_chars == len(r.text)


def test_suffix_crowds_without_join(spark, monkeypatch):
    """Snippets of hot hashes are counted from their rows' number: no join passes the rows of a large group again."""
    plans = []
    monkeypatch.setattr(suffix_dedup, "LEAST_HOT", 5)
    monkeypatch.setattr(suffix_dedup, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df.checkpoint())
    line = "the same long line of text that stands in every one of these documents "
    texts = [f"{i} " * 90 + line + f"{i * 7} " * 90 for i in range(40)] + ["one text of many copies " * 12] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    check_removal(suffix_dedup.remove_repeats(df).collect())
    assert plans and not any("LeftSemi" in p for p in plans)
