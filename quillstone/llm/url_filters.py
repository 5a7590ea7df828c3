"""URL filters by a Bloom filter cascade.

Level 0 encodes the listed keys. Level 1 encodes the keys of the corpus's universe that level 0 lets
through by mistake, level 2 the listed keys that level 1 lets through, and so on until a level has no
false positives. A key of the universe is then classified without error by the first level that rejects
it, so that applying the filter takes hash arithmetic on literals and no join.

Lists are rules and sites that the caller holds, or a table of pages' keys of any size. A level is a literal of
at most ``MAX_BITS``; a table whose first level would be larger is held against the keys by a shuffled join
instead, with the same result.

Edges: a null url, or one without ``://``, has empty host and path and fits no key; repeated rows are
judged alike; an empty list makes a cascade that rejects all; of rules as long as each other that fit one url
(they differ in where the host ends) the one later in text order wins; a rule listed both ways allows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.storage import cut, read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict). A rule fits its host and all subdomains, where the path starts with the rule's.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Sites that are refused where no rule fits.
SITES = ("spam-farm.example.org", "cheap-pills.example.com", "spam-farm.example.net", "cheap-pills.example.net", "cheap-pills.example.org")
#: Pages of fewer characters of html are put on the query's list of refused pages.
THIN = 2000
MAX_BITS = 1 << 26


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` up to ``/?#``; path from there up to ``?#``."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def candidate_keys(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> list[Column]:
    """For each (labels of the host, characters of the path) that listed keys have: the url's key of that shape, or null."""
    labels = F.length(host) - F.length(F.translate(host, ".", "")) + 1
    return [
        F.when((host != "") & (labels >= n) & (F.length(path) >= k), F.concat(F.substring_index(host, ".", -n), F.left(path, F.lit(k)) if k else F.lit("")))
        for n, k in shapes
    ]


def shapes_of(keys: Sequence[tuple[str, str]]) -> list[tuple[int, int]]:
    return sorted({(host.count(".") + 1, len(path)) for host, path in keys})


@dataclass(frozen=True)
class BloomLevel:
    """The set bits of a Bloom filter, 64 to a word."""

    bits: int
    hashes: int
    salt: int
    words: tuple[int, ...]

    def positions(self, key: Column) -> list[Column]:
        return _positions(key, self.bits, self.hashes, self.salt)

    def contains(self, key: Column) -> Column:
        # Folded by the optimizer to one array literal.
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        hit = F.lit(True)
        for at in self.positions(key):
            word = F.get(words, F.shiftright(at, 6).cast("int"))
            hit = hit & (F.getbit(word, (at % 64).cast("int")) == 1)
        return hit


def _positions(key: Column, bits: int, hashes: int, salt: int) -> list[Column]:
    """Double hashing: position i is (h1 + i * h2) mod bits."""
    first, step = F.pmod(F.xxhash64(F.lit(salt), key), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(bits))
    return [F.pmod(first + step * i, F.lit(bits)) for i in range(hashes)]


def bits_for(count: int, false_rate: float) -> int:
    return max(64, math.ceil(count * math.log2(1 / false_rate) * math.log2(math.e)))


def bloom_level(keys: DataFrame, count: int, false_rate: float, salt: int) -> BloomLevel:
    """The level that encodes ``keys`` (column ``key``). Only its bit words come to the driver."""
    bits = bits_for(count, false_rate)
    hashes = max(1, round(math.log2(1 / false_rate)))
    at = F.explode(F.array(*_positions(F.col("key"), bits, hashes, salt)))
    found = (
        keys.select(at.alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set"))
        .collect()
    )
    words = [0] * ((bits + 63) // 64)
    for row in found:
        words[row["word"]] = row["set"]
    return BloomLevel(bits, hashes, salt, tuple(words))


@dataclass(frozen=True)
class Cascade:
    """Levels 0, 2, 4... encode listed keys; 1, 3, 5... keys of the universe that are not listed."""

    levels: tuple[BloomLevel, ...]

    def contains(self, key: Column) -> Column:
        """Exact for the keys of the universe the cascade was built over; false for null."""
        if not self.levels:
            return F.lit(False)
        verdict = F.lit((len(self.levels) - 1) % 2 == 0)
        for i, level in reversed(list(enumerate(self.levels))):
            verdict = F.when(~level.contains(key), F.lit(i % 2 == 1)).otherwise(verdict)
        return key.isNotNull() & verdict


def build_cascade(listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS, max_levels: int = 64) -> Cascade | None:
    """A cascade for ``listed`` that is exact over ``universe`` (each has a string column ``key``; repeats don't matter).

    The first level's rate of false positives is chosen from the sizes of both sets, so that the
    universe's false positives are about as many as the listed keys: the filter grows with the list.
    None if that level, or one after it, would pass ``max_bits``.
    """
    include = cut(listed.select("key").where("key is not null").distinct())
    n_include = include.count()
    if not n_include:
        return Cascade(())
    n_universe = universe.agg(F.approx_count_distinct("key", 0.01)).first()[0]
    rate = min(0.5, max(1e-9, n_include * math.sqrt(0.5) / max(1, n_universe)))
    if bits_for(n_include, rate) > max_bits:
        return None
    levels = [bloom_level(include, n_include, rate, 0)]
    # Only what passes level 0 is kept of the universe, before the distinct and the anti join.
    wrong = cut(universe.select("key").where(levels[0].contains(F.col("key"))).distinct().join(include, "key", "left_anti"))
    n_wrong = wrong.count()
    inside, outside, n_inside = wrong, include, n_wrong
    while n_inside:
        if len(levels) == max_levels:
            raise RuntimeError("the cascade does not end: raise max_levels")
        if bits_for(n_inside, 0.5) > max_bits:
            return None
        levels.append(bloom_level(inside, n_inside, 0.5, len(levels)))
        missed = cut(outside.where(levels[-1].contains(F.col("key"))))
        inside, outside, n_inside = missed, inside, missed.count()
    return Cascade(tuple(levels))


def page_key(host: Column, path: Column) -> Column:
    return F.when(host != "", F.concat(host, path))


def is_listed(pages: DataFrame, listed: DataFrame, key: str, out: str, max_bits: int = MAX_BITS) -> DataFrame:
    """Adds ``out``: whether the page's ``key`` is among those of ``listed`` (column ``key``)."""
    cascade = build_cascade(listed, pages.select(F.col(key).alias("key")), max_bits)
    if cascade is not None:
        return pages.withColumn(out, F.coalesce(cascade.contains(F.col(key)), F.lit(False)))
    found = listed.select(F.col("key").alias(key)).where(F.col(key).isNotNull()).distinct().withColumn(out, F.lit(True))
    return pages.join(found, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    sites: Sequence[str] = SITES,
    listed: DataFrame | None = None,
    url: str = "url",
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """Adds host, path, rule (the longest that fits, or null), listed and verdict.

    A rule's verdict goes first; without one, pages of a refused site (``sites``, subdomains included) or
    whose host and path are a key of ``listed`` (a table with a column ``key``) are blocked, others allowed.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    rule_keys = candidate_keys(F.col("host"), F.col("path"), shapes_of([r[:2] for r in rules]))
    site_keys = candidate_keys(F.col("host"), F.col("path"), shapes_of([(s, "") for s in sites]))
    names = {f"_rule{i}": k for i, k in enumerate(rule_keys)} | {f"_site{i}": k for i, k in enumerate(site_keys)}
    # The universe of the keys that rules and sites could be, from one scan of the urls.
    kinds = [F.struct(F.lit(kind).alias("kind"), k.alias("key")) for kind, keys in (("rule", rule_keys), ("site", site_keys)) for k in keys]
    universe = None
    if kinds:
        urls = pages.select(F.col(url).alias("url")).select(host.alias("host"), path.alias("path"))
        universe = cut(urls.select(F.inline(F.array(*kinds))).where("key is not null").distinct())

    def cascade(keys: list[str], kind: str) -> Cascade:
        if not keys:
            return Cascade(())
        held = spark.range(1).select(F.explode(F.split(F.lit("\n".join(keys)), "\n")).alias("key"))
        built = build_cascade(held, universe.where(F.col("kind") == kind), max_bits)
        if built is None:
            raise ValueError("more rules or sites than a literal holds: pass them as the table `listed`")
        return built

    allow = cascade([h + p for h, p, v in rules if v == "allow"], "rule")
    block = cascade([h + p for h, p, v in rules if v == "block"], "rule")
    refuse = cascade(list(sites), "site")

    # The keys are columns of their own, so that each is made once however often a level tests it.
    fits, on_list = [], F.lit(False)
    for name in names:
        k = F.col(name)
        if name.startswith("_rule"):
            hit = F.when(allow.contains(k), "allow").when(block.contains(k), "block")
            fits.append(F.when(hit.isNotNull(), F.struct(F.length(k).alias("n"), k.alias("rule"), hit.alias("verdict"))))
        else:
            on_list = on_list | refuse.contains(k)
    best = F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    made = pages.withColumns({"host": host, "path": path})
    if listed is None:
        made = made.withColumn("_listed", F.lit(False))
    else:
        made = is_listed(made.withColumn("_page", page_key(F.col("host"), F.col("path"))), listed, "_page", "_listed", max_bits)
    return (
        made.withColumns(names)
        .withColumns({"_best": best, "listed": on_list | F.col("_listed")})
        .withColumn("rule", F.col("_best.rule"))
        .withColumn("verdict", F.coalesce("_best.verdict", F.when(F.col("listed"), "block").otherwise("allow")))
        .drop("_best", "_listed", "_page", *names)
    )


def thin_pages(pages: DataFrame, least: int = THIN) -> DataFrame:
    """The keys of pages with fewer than ``least`` characters of html."""
    host, path = host_and_path(F.col("url"))
    short = pages.where(F.length(F.coalesce("html", F.lit(""))) < least).select(host.alias("host"), path.alias("path"))
    return short.select(page_key(F.col("host"), F.col("path")).alias("key"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, refused sites, and the list of all thin pages of the table."""
    pages = read(spark, sf_dir, "pages")
    found = filter_urls(pages.select("page_id", "url"), listed=thin_pages(pages))
    return found.select("page_id", "host", "path", "rule", "verdict", "listed")


SQL = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(rhost, rpath, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
listed(lhost) AS (VALUES ('spam-farm.example.org'), ('cheap-pills.example.com'), ('spam-farm.example.net'), ('cheap-pills.example.net'), ('cheap-pills.example.org')),
best AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(v, length(rhost || rpath)) AS v
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
thin AS (SELECT DISTINCT host || path AS k FROM parts JOIN pages USING (page_id) WHERE host <> '' AND length(coalesce(html, '')) < 2000),
hits AS (SELECT DISTINCT page_id FROM parts JOIN listed ON host = lhost OR ends_with(host, '.' || lhost)
  UNION SELECT page_id FROM parts WHERE host <> '' AND host || path IN (SELECT k FROM thin))
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.v, CASE WHEN h.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict, h.page_id IS NOT NULL AS listed
FROM parts p LEFT JOIN best b USING (page_id) LEFT JOIN hits h ON h.page_id = p.page_id
"""
