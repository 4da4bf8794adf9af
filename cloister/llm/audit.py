"""Filter interaction audit: what each filter removes in any order of filters, and its Shapley value.

One pass gives every document the mask of the filters that it fails; counts of masks for each part of the corpus then hold
all that any order does.  A part's removal polynomial is the multilinear extension of v(S), the documents that the filters of S
remove together:

    f(x) = sum over masks of n(mask) * (1 - product over i in mask of (1 - x_i))

At a corner of the unit cube f is v of the filters that are 1 there, so survivors of any prefix of an order are the total less a
corner's value.  The Shapley value of filter i is the integral of the derivative of f by x_i along the diagonal,
found with exact rationals; times the number of orders it is what the filter removes, summed over all orders.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table

FILTERS = "ABCDE"

#: Rows of documents that were lost: all, those of good quality, toxic ones.
KINDS = ("n", "good", "toxic")

_REPORT = (
    "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
)


class Polynomial:
    """A multilinear polynomial: the coefficient of each set of variables, given as a mask."""

    def __init__(self, coefficients: dict[int, int]):
        self.coefficients = {s: c for s, c in coefficients.items() if c}

    @staticmethod
    def removal(counts: dict[int, int]) -> Polynomial:
        """f from the number of documents of each mask: a product of (1 - x_i) has a term of sign (-1)^|S| for each subset S."""
        out: dict[int, int] = {}
        for mask, n in counts.items():
            subset = mask
            while subset:  # all subsets but the empty one, whose term the 1 cancels
                out[subset] = out.get(subset, 0) - (-1) ** subset.bit_count() * n
                subset = (subset - 1) & mask
        return Polynomial(out)

    def corner(self, ones: int) -> int:
        """The value where the variables of the mask are 1 and the others 0."""
        return sum(c for s, c in self.coefficients.items() if s & ones == s)

    def diagonal_integral(self, variable: int) -> Fraction:
        """The integral over t from 0 to 1 of the derivative by the variable at (t, ..., t): a term of k variables gives t^(k-1)."""
        return sum((Fraction(c, s.bit_count()) for s, c in self.coefficients.items() if s >> variable & 1), Fraction(0))


def audit_part(counts: dict[str, dict[int, int]], filters: str = FILTERS) -> list[tuple]:
    """Rows ``filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` of a part from its counts by kind and mask."""
    f = {kind: Polynomial.removal(counts[kind]) for kind in KINDS}
    corners = {kind: [p.corner(s) for s in range(1 << len(filters))] for kind, p in f.items()}
    total, orders = sum(counts["n"].values()), math.factorial(len(filters))
    fails = [sum(n for mask, n in counts["n"].items() if mask >> i & 1) for i in range(len(filters))]
    shapley = [int(f["n"].diagonal_integral(i) * orders) for i in range(len(filters))]  # an integer: each order removes whole documents
    rows = []
    for order in itertools.permutations(range(len(filters))):
        name, before = "".join(filters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed, good, toxic = (corners[kind][after] - corners[kind][before] for kind in KINDS)
            rows.append((name, step, filters[i], total - corners["n"][after], removed, fails[i] - removed, counts["n"].get(1 << i, 0), good, toxic, shapley[i]))
            before = after
    return rows


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The report of ``part, mask, n, good, toxic``, sums of documents, of which a part may have several rows for a mask.

    A row for each part, order of all filters and step.  Parts are told apart as they are, null being one; without rows there is no part.
    """
    sums = masks.groupBy("part").agg(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(k))), F.lit(0)).cast("long").alias(f"{k}{m}") for k in KINDS for m in range(1 << len(filters))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        for batch in batches:
            for row in batch.to_dict("records"):
                counts = {k: {m: int(row[f"{k}{m}"]) for m in range(1 << len(filters))} for k in KINDS}
                found = pd.DataFrame(audit_part(counts, filters), columns=names)
                found.insert(0, "part", row["part"])
                yield found

    return sums.mapInPandas(run, _REPORT)


def failures(text: Column) -> Sequence[Column]:
    """The failure conditions A to D of a text (not null)."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    return (
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        text.rlike("[#$%&*|]"),
    )


def document_masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the filters that they fail, summed up by text.

    Bits 0 to 3 are the conditions of ``failures``, bit 4 says that a row with a smaller id has the same text, told by its SHA-256.  A null text is empty and
    a null part is the empty string.  Rows that repeat an id and its text both count, and neither makes the other a copy.  A row without an
    id has no order, so it is no copy and makes none; it has no labels.  A document is good (toxic) if any of its label rows says so.
    Texts of any length are read whole in one narrow pass; what is shuffled has a fixed size a row, and equal rows are counted before.
    Other columns, whatever their names, are not looked at; without documents there are no rows.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    mask = F.lit(0)
    for bit, failed in enumerate(failures(F.col("_text"))):
        mask = mask + failed.cast("int") * (1 << bit)
    rows = plain.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("_text", 256)).alias("_same"))
    rows = materialise(rows.groupBy("doc_id", "part", "mask", "_same").agg(F.count(F.lit(1)).alias("n")), "filter-masks")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    none = F.lit(None).cast("int")
    numbered = rows.where("doc_id is not null").join(known, "doc_id", "left").unionByName(rows.where("doc_id is null").withColumns({"good": none, "toxic": none}))
    flags = {k: F.coalesce(F.col(k), F.lit(0)) for k in ("good", "toxic")}
    # Of a text's rows that agree in all else, those of the smallest id are told apart, as they may be the text's first.
    by_text = numbered.withColumns(flags).groupBy("_same", "part", "mask", "good", "toxic").agg(
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("_first"), F.sum("n").alias("_all"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("_lone")
    )
    by_text = materialise(by_text, "filter-texts")
    first = by_text.groupBy("_same").agg(F.min("_first.doc_id").alias("_least"))
    at_first = F.when(F.col("_first.doc_id") == F.col("_least"), F.col("_first.n")).otherwise(0)
    found = by_text.join(first, "_same").withColumn("_passing", F.coalesce(at_first, F.lit(0)) + F.coalesce("_lone", F.lit(0)))
    sides = F.array(F.struct(F.lit(0).alias("copy"), F.col("_passing").alias("n")), F.struct(F.lit(1).alias("copy"), (F.col("_all") - F.col("_passing")).alias("n")))
    found = found.select("part", "mask", "good", "toxic", F.explode(sides).alias("_side")).where("_side.n > 0")
    n = F.col("_side.n")
    return found.groupBy("part", (F.col("mask") + F.col("_side.copy") * (1 << 4)).alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic")
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all ``documents`` by ``lang``, filters A to E; see ``document_masks`` and ``audit``."""
    found = audit(document_masks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))
    return found.drop("filter")


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS MATERIALIZED (SELECT d.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
    {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
     'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)} AS m FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
fails AS MATERIALIZED (SELECT part, good, toxic, (CASE WHEN m.A THEN 'A' ELSE '' END || CASE WHEN m.B THEN 'B' ELSE '' END || CASE WHEN m.C THEN 'C' ELSE '' END || CASE WHEN m.D THEN 'D' ELSE '' END || CASE WHEN m.E THEN 'E' ELSE '' END) AS bad FROM f),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
steps AS (SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS earlier FROM orders, range(1, 6) r(step)),
each AS (SELECT f.part, s.filter_order, s.step, s.own, contains(bad, s.own) AS fail, bad <> '' AND translate(bad, s.earlier, '') <> bad AS gone, bad = s.own AS sole, good, toxic FROM fails f, steps s),
counted AS (SELECT part, filter_order, step, own, count(*) FILTER (NOT gone AND NOT fail) AS kept, count(*) FILTER (fail AND NOT gone) AS removed, count(*) FILTER (fail AND gone) AS redundant,
    count(*) FILTER (sole) AS unique_fails, count(*) FILTER (fail AND NOT gone AND good) AS good_lost, count(*) FILTER (fail AND NOT gone AND toxic) AS toxic_lost FROM each GROUP BY ALL)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counted
"""
