"""URL filtering with cascades of Bloom filters.

Rules are (host, path) pairs.  A url's candidate keys are its host and parent domains, each with the
path prefixes whose length some rule has; a rule fits a url exactly if the rule's key is among them.
A cascade answers "is this key listed?" exactly over all keys that occur in the corpus: level 1
encodes the listed keys, level 2 the corpus keys that level 1 lets through by mistake, level 3 the
listed keys that level 2 lets through, and so on until a level lets nothing wrong through.  The
filters are literals of a projection, so urls are judged in one narrow pass without a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table

#: (action, host, path) of the rules that the query applies.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: A cascade takes at most so many listed keys; its levels are literals, about 1.5 bits * log2(corpus keys) for each key, four
#: bits to a byte.  ``judge_urls`` joins longer lists.
MAX_LISTED = 1_000_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Keys ``domain + path prefix`` of a url, longest first; only prefixes of the given lengths."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in path_lengths]))
    keys = F.flatten(F.transform(domains, lambda d: F.transform(prefixes, lambda p: F.concat(d, p))))
    return F.array_sort(
        keys,
        lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0)),
    )


@dataclass
class BloomLevel:
    bits: int
    hashes: int
    salt: int
    data: bytes  # four bits in a byte: one literal, in which a byte is found by its place

    def has(self, key: Column) -> Column:
        def is_set(place: Column) -> Column:
            byte = F.ascii(F.substring(F.lit(self.data), (F.shiftright(place, 2) + 1).cast("int"), F.lit(1)).cast("string"))
            return F.getbit(byte, F.pmod(place, F.lit(4)).cast("int")) == 1

        return F.forall(F.array(*bloom_places(key, self.bits, self.hashes, self.salt)), is_set)  # the literal is in the plan once


#: Hexadecimal digits to the bytes 0 to 15.
_NIBBLES = bytes(int(chr(c), 16) if chr(c) in "0123456789abcdef" else 0 for c in range(256))


@dataclass
class BloomCascade:
    """Levels 1, 3, 5 ... encode listed keys, levels 2, 4 ... others; exact for every key of the universe it was built over."""

    levels: list[BloomLevel] = field(default_factory=list)

    def listed(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            # not in level k+1: others stop at odd levels, listed keys at even ones
            answer = F.when(~self.levels[k].has(key), F.lit(k % 2 == 1)).otherwise(answer)
        return answer


def bloom_places(key: Column, bits: int, hashes: int, salt: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(salt * 1000 + i), key), F.lit(bits)) for i in range(hashes)]


def _level(keys: DataFrame, n: int, rate: float, salt: int) -> BloomLevel:
    """A filter of ``n`` keys whose words come from a grouped OR; only its words, sized by ``n``, reach the driver."""
    bits = max(64, 64 * math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))
    hashes = max(1, round(bits / max(n, 1) * math.log(2))) if bits > 64 else max(1, min(6, round(64 / max(n, 1) * math.log(2))))
    place = keys.select(F.explode(F.array(*bloom_places(F.col("key"), bits, hashes, salt))).alias("place"))
    set_bits = place.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(place, 64) as int))")).alias("value"))
    words = [0] * (bits // 64)
    for row in set_bits.collect():
        words[row["word"]] = row["value"] % 2**64
    return BloomLevel(bits, hashes, salt, "".join(f"{w:016x}"[::-1] for w in words).encode().translate(_NIBBLES))


def build_cascade(listed: DataFrame, universe: DataFrame, max_levels: int = 60) -> BloomCascade:
    """A cascade for the keys of ``listed``, exact over ``universe`` and ``listed`` (each a column ``key``).

    Level 1 has the false-positive rate at which about as many other keys pass it as there are
    listed keys, later levels one half: all levels together stay within a few bits for each listed key times
    the logarithm of the universe's size.
    """
    listed = listed.select("key").where("key is not null").distinct()
    n_listed = listed.count()
    if n_listed > MAX_LISTED:
        raise ValueError(f"{n_listed} listed keys; a cascade of literals takes {MAX_LISTED}. Split the list or use judge_by_join")
    others = universe.select("key").where("key is not null").distinct().join(listed, "key", "left_anti")
    cascade = BloomCascade()
    if not n_listed:
        return cascade
    inside, n_inside, outside, n_outside = listed, n_listed, others, others.count()
    while n_inside and len(cascade.levels) < max_levels:
        rate = min(0.5, max(1e-9, n_inside / max(n_outside, 1))) if not cascade.levels else 0.5
        level = _level(inside, n_inside, rate, len(cascade.levels) + 1)
        cascade.levels.append(level)
        passed = outside.where(level.has(F.col("key")))
        if not cascade.levels[1:]:
            passed = materialise(passed, "bloom-level")  # the universe is scanned once; what passes is about as large as the list
        inside, n_inside, outside, n_outside = passed, passed.count(), inside, n_inside
    if n_inside:
        raise RuntimeError("the cascade did not end")
    return cascade


def judge_urls(
    pages: DataFrame,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    page_id: str = "page_id",
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row; the longest fitting rule decides, ``default`` where none fits.

    A null or malformed url has an empty host and path and so no rule.  Repeated rows are judged each.
    Rules of equal length are told apart by their text; one text given with both actions blocks.  More than ``MAX_LISTED``
    rules are joined, with the same result.
    """
    spark = pages.sparkSession
    if len(rules) > MAX_LISTED:
        return judge_by_join(pages, spark.createDataFrame(list(rules), "action string, host string, path string"), page_id, url, default)
    lengths = sorted({len(p) for _, _, p in rules})
    host, path = url_parts(F.col(url))
    parts = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    if not rules:
        return parts.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = candidate_keys(F.col("host"), F.col("path"), lengths)
    universe = materialise(parts.select(F.explode(keys).alias("key")).distinct(), "url-keys")
    table = spark.createDataFrame([(h + p, a) for a, h, p in rules], "key string, action string")
    any_rule = build_cascade(table, universe)
    # A url's rule is a listed key, so those are the universe of the question which of them block.
    blocking = build_cascade(table.where("action = 'block'"), table)
    judged = parts.withColumn("rule", F.try_element_at(F.filter(keys, any_rule.listed), F.lit(1)))
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(blocking.listed(F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def judge_by_join(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """The way of ``judge_urls`` beyond ``MAX_LISTED``: rules as a table (action, host, path), candidate keys joined with it by a shuffle."""
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]  # at most as many as a path has characters
    host, path = url_parts(F.col(url))
    parts = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("_row", F.monotonically_increasing_id())
    parts = materialise(parts, "url-parts")
    table = rules.groupBy(F.concat("host", "path").alias("key")).agg(F.max(F.col("action") == "block").alias("blocks"))
    fits = parts.select("_row", F.explode(candidate_keys(F.col("host"), F.col("path"), lengths)).alias("key")).join(table, "key")
    best = fits.groupBy("_row").agg(F.max(F.struct(F.length("key").alias("n"), "key", "blocks")).alias("best"))
    verdict = F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best.blocks"), F.lit("block")).otherwise(F.lit("allow"))
    return parts.join(best, "_row", "left").select("page_id", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"))


OP7_SQL = r"""
WITH r(action, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
p AS (SELECT page_id,
  CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
j AS (SELECT p.page_id, p.host, p.path,
  (SELECT arg_max({'rule': r.host || r.path, 'action': r.action}, length(r.host || r.path)) FROM r
   WHERE (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)) AS m FROM p)
SELECT page_id, host, path, m.rule AS rule, coalesce(m.action, 'allow') AS verdict FROM j
"""
