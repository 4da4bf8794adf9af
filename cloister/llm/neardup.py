"""MinHash near-duplicate detection with min-max hashing.

Under each of 64 permutations both the minimum and the maximum of a document's shingle hashes are
kept, so 64 hash evaluations give 128 signature values with less variance than 128 independent minima.
32 bands of four values (two permutations) find candidates: a pair of similarity 0.8 is missed by all
bands with probability (1 - 0.8^4)^32, about 5e-8.  Every candidate is confirmed on the full sets.

Texts with equal word sequences are one node.  In each band bucket all members are compared with one hub, which settles most
groups with as many comparisons as members.  What is still in different components is compared with a few leaders, members that
are near most of a sample of their hub's group.  The rest is compared exactly with each other, in blocks: sketches first, then
the texts of members that have a likely partner, by a 0/1 matrix product that returns a
spanning forest.  No member, bucket or partner is capped, and pairs within a group are not written out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_ids, materialise, read_table, texts as text_rows
from .components import connected_components, extend_components
from .wordhash import Words, find_words, lower_table, mix, shingle_hashes, space_table, text_slices

PERMUTATIONS = 64
BANDS = 32
#: Pairs whose share of equal signature bytes is lower than similarity minus this are not looked at further (5.7 sigma).
ESTIMATE_SLACK = 0.2
#: A task compares the members of two blocks of about so many members and shingles, so many shared shingles at a time.
BLOCK_MEMBERS, BLOCK_SHINGLES, COLUMNS = 512, 1_000_000, 4096
#: Members of a hub's group from which its leaders are chosen, and leaders at most; the choice changes the work, not the result.
LEADER_SAMPLE, LEADERS = 64, 8
_FACTORS = np.random.default_rng(7).integers(1, 2**64, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = np.random.default_rng(8).integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)

_SKETCH = "doc_id long, n_shingles long, key binary, bands array<long>, sketch binary"


def min_max_signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, 128) values of texts with at least one hash: minimum and maximum under each permutation, side by side."""
    out = np.empty((len(first), 2 * PERMUTATIONS), np.uint64)
    permuted = np.empty_like(hashes)
    for k in range(PERMUTATIONS):
        np.multiply(hashes, _FACTORS[k], out=permuted)
        np.add(permuted, _SHIFTS[k], out=permuted)
        np.minimum.reduceat(permuted, first, out=out[:, 2 * k])
        np.maximum.reduceat(permuted, first, out=out[:, 2 * k + 1])
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    rows = signatures.shape[1] // BANDS
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(signatures), BANDS)).copy()
    for j in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signatures[:, j::rows])
    return key.view(np.int64)


def _sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[Words, np.ndarray, np.ndarray]:
    found = find_words(data, offsets, space_table(), lower_table())
    return found, *shingle_hashes(found, words)


def _sequence_key(hashes: np.ndarray) -> bytes:
    """128 bits of the word sequence; empty for none."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else b""


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for start, end, data, offsets in text_slices(batch.column(1)):
                found, hashes, first = _sets(data, offsets, words)
                full = np.flatnonzero(np.diff(first))
                sizes = np.zeros(end - start, np.int64)
                bands, sketches = np.empty((0, BANDS), np.int64), [b""] * (end - start)
                if len(full):
                    signatures = min_max_signatures(hashes, first[full])
                    bands = band_keys(signatures)
                    low = (mix(signatures) >> np.uint64(56)).astype(np.uint8)
                    for d, row in zip(full, low, strict=True):
                        sizes[d] = len(np.unique(hashes[first[d] : first[d + 1]]))
                        sketches[d] = row.tobytes()
                ends = np.zeros(end - start + 1, np.int32)
                ends[1:] = np.cumsum(np.where(sizes > 0, BANDS, 0))
                keys = [_sequence_key(found.hashes[found.first[d] : found.first[d + 1]]) for d in range(end - start)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, end - start), pa.array(sizes), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel())), pa.array(sketches, pa.binary())],
                    names=["doc_id", "n_shingles", "key", "bands", "sketch"],
                )

    return run


def _likely(percent: int):
    """Pairs whose sketches don't rule out the similarity."""
    least = percent / 100 - ESTIMATE_SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
                keep = (a == b).mean(axis=1) >= least
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return run


def _confirm(words: int, percent: int):
    """Pairs (a, b) whose full sets have ``100 * intersection >= percent * union``."""

    def shingles(text: str) -> np.ndarray:
        data = np.frombuffer((text or "").encode(), np.uint8)
        return np.unique(_sets(data, np.array([0, len(data)]), words)[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                b = batch.column(1)[i].as_py(), batch.column(3)[i].as_py()
                if last[0] != b:  # rows come sorted by b: a hub's set is built once
                    last = b, shingles(b[1])
                one, two = shingles(batch.column(2)[i].as_py()), last[1]
                both = np.concatenate((one, two))
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[i] = 100 * shared >= percent * (len(both) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return run


def _keyed(words: int):
    """``doc_id, key, text`` of batches of ids and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_slices(batch.column(1)):
                found = find_words(data, offsets, space_table(), lower_table())
                keys = [_sequence_key(found.hashes[found.first[d] : found.first[d + 1]]) for d in range(end - start)]
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), part.column(1)], names=["doc_id", "key", "text"])

    return run


def _linked(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that are links; every filter before the last is exact or errs towards keeping."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    near = near.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b", "s_a", "s_b")
    near = materialise(near.mapInArrow(_likely(percent), "a long, b long"), "pairs")
    text = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"t_{c}"))
    full = near.join(text("a"), "a").join(text("b"), "b").select("a", "b", "t_a", "t_b")
    return materialise(full.mapInArrow(_confirm(words, percent), "a long, b long"), "linked")


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``hub, node, component`` of the members of hubs whose members are in several components, hubs left out."""
    placed = materialise(members.join(roots, "node", "left").select("hub", "node", F.coalesce("component", "node").alias("component")), "placed")
    several = placed.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("hub")
    return materialise(by_ids(placed, several, "left_semi", "hub"), "open-members")


def _leaders(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """``hub, leader``: members that are likely links of most of a bounded sample of the hub's members."""
    order = Window.partitionBy("hub").orderBy(F.xxhash64("node"), "node")
    sample = members.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= LEADER_SAMPLE)
    return sample.join(nodes.select("node", "sketch"), "node").select("hub", "node", "sketch").groupBy("hub").applyInArrow(_choose, "hub long, leader long")


def _choose(table: pa.Table) -> pa.Table:
    table = table.sort_by("node")
    sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
    near = (sketches[:, None] == sketches).mean(axis=2) >= 0.8
    chosen, rest = [], np.ones(table.num_rows, bool)
    while len(chosen) < LEADERS and rest.any():
        best = int(near[:, rest].sum(axis=1).argmax())
        if near[best, rest].sum() < 2:
            break
        chosen.append(best)
        rest &= ~near[best]
    return table.select(["hub", "node"]).take(pa.array(chosen, pa.int64())).rename_columns(["hub", "leader"])


def _group_links(members: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components of each hub's members: all their pairs are compared, in blocks.

    Buckets of one hub overlap, so their members are taken together, each once.  A group beyond the block
    size is cut into blocks by a hash, and each pair of blocks is a task's work.  Blocks of sketches tell which members have a
    likely partner in another component; only their texts are compared, and a task returns a spanning forest of the links, not the pairs.
    """
    rows = materialise(members.join(nodes.select("node", "n_shingles", "sketch"), "node"), "group-members")
    blocks = rows.groupBy("hub").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_MEMBERS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rows = rows.join(materialise(blocks, "blocks"), "hub").withColumn("_own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("hub", "node", "component", "n_shingles", "sketch", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))
    rows = rows.repartition("hub", "_i", "_j")  # else a join on the hub leaves all blocks of a hub in one task
    likely = rows.groupBy("hub", "_i", "_j").applyInArrow(_with_partner(percent), "hub long, _i int, _j int, node long, component long")
    likely = materialise(likely, "likely-members").join(texts, "node").repartition("hub", "_i", "_j")
    return materialise(likely.groupBy("hub", "_i", "_j").applyInArrow(_forest(words, percent), "a long, b long"), "linked")


def _with_partner(percent: int):
    """The members of two blocks whose sketch does not rule out a link with a member of another component."""
    least = percent / 100 - ESTIMATE_SLACK

    def run(table: pa.Table) -> pa.Table:
        component, size = table["component"].to_numpy(), table["n_shingles"].to_numpy()
        sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(size), -1)
        keep = np.zeros(len(size), bool)
        for start in range(0, len(size), 32):
            own = slice(start, start + 32)
            likely = (sketches[own, None] == sketches).mean(axis=2) >= least
            likely &= component[own, None] != component
            likely &= 100 * np.minimum(size[own, None], size) >= percent * np.maximum(size[own, None], size)
            keep[own] = likely.any(axis=1)
        return table.select(["hub", "_i", "_j", "node", "component"]).filter(pa.array(keep))

    return run


def _forest(words: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        component, nodes = table["component"].to_numpy(), table["node"].to_numpy()
        if len(np.unique(component)) < 2:
            return schema.empty_table()
        sets = []
        for text in table["text"]:
            data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
            sets.append(np.unique(_sets(data, np.array([0, len(data)]), words)[1]))
        sizes = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[column] > 1  # others are in no intersection
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        width = int(column.max(initial=-1)) + 1
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        label, most = np.unique(component, return_counts=True)
        rest = np.flatnonzero(component != label[most.argmax()])  # at least one end of each pair that matters
        common = np.zeros((len(rest), len(sets)), np.float32)
        for start in range(0, width, COLUMNS):
            lo, hi = np.searchsorted(column, (start, start + COLUMNS))
            part = np.zeros((len(sets), min(COLUMNS, width - start)), np.float32)
            part[owner[lo:hi], column[lo:hi] - start] = 1
            common += part[rest] @ part.T
        parent = {c: c for c in label.tolist()}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        pairs = []
        for i, row in zip(rest.tolist(), common.astype(np.int64), strict=True):
            linked = np.flatnonzero(100 * row >= percent * (sizes[i] + sizes - row))
            for j in linked[component[linked] != component[i]].tolist():
                one, two = root(int(component[i])), root(int(component[j]))
                if one != two:
                    parent[one] = two
                    pairs.append((nodes[i], nodes[j]))
        return pa.table([pa.array([int(a) for a, _ in pairs], pa.int64()), pa.array([int(b) for _, b in pairs], pa.int64())], schema=schema)

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row for each row of ``docs``.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a set holds the distinct
    runs of ``words`` words, of a shorter text its whole sequence.  Documents with
    ``100 * intersection >= percent * union`` are linked; ``component_id`` is the smallest doc_id that
    links reach and ``kept`` marks the document that has it.  A null or wordless text has an empty set
    and is linked with nothing.  Rows that repeat a doc_id count as one document: those with words are linked with each
    other.  A null doc_id is its own row with null ``component_id`` and ``kept`` true.
    """
    plain = text_rows(docs, doc_id, text)
    # A row's number is fixed by writing it; nodes are classes of equal word sequences, named by their least row.
    numbered = plain.mapInArrow(_sketches(words), _SKETCH).withColumn("node", F.monotonically_increasing_id())
    sketches = materialise(numbered, "sketches")
    has_set = "n_shingles > 0 and doc_id is not null"
    filled = sketches.where(has_set)
    classes = filled.groupBy("key").agg(F.min("node").alias("node"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = materialise(classes, "classes")
    nodes = materialise(filled.select("node", "key", "n_shingles", "bands", "sketch").join(classes.select("node", "least"), "node"), "nodes")
    bridges, repeated = _repeated_ids(filled, classes)

    members = nodes.select(F.explode("bands").alias("band"), "node")
    hubs = members.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub <> other").select("band", "hub")
    members = materialise(members.join(hubs, "band").select("hub", "node").distinct(), "members")  # of buckets with several members
    chosen = materialise(nodes.select("node", "key", "least").join(members.select("node").distinct(), "node", "left_semi"), "chosen")
    texts = by_ids(plain, chosen.select(F.col("least").alias("doc_id")), "left_semi").mapInArrow(_keyed(words), "doc_id long, key binary, text string")
    texts = texts.join(chosen, "key").where("doc_id = least").select("node", "text")
    texts = materialise(texts.dropDuplicates(["node"]) if repeated else texts, "texts")

    pairs = members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    links = _linked(pairs, nodes, texts, words, percent).union(bridges)
    roots = connected_components(links)
    open_ = _open(members, roots)
    if not open_.isEmpty():
        pairs = open_.join(_leaders(open_, nodes), "hub").where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
        roots = extend_components(roots, _linked(pairs, nodes, texts, words, percent))
        open_ = _open(members, roots)
    if not open_.isEmpty():
        roots = extend_components(roots, _group_links(open_.where("node <> hub"), nodes, texts, words, percent))

    placed = classes.join(roots, "node", "left").where("n > 1 or component is not null").select("key", "least", F.coalesce("component", "node").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    whole = placed.join(smallest, "component").select("key", "component_id")  # classes of one row without links are their own component
    out = sketches.where(has_set).join(whole, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    alone = sketches.where(f"not coalesce({has_set}, false)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionAll(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _repeated_ids(filled: DataFrame, classes: DataFrame) -> tuple[DataFrame, bool]:
    """(links (a, b) between the nodes of each doc_id that has several texts, whether any doc_id is repeated)."""
    ids = filled.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    ids = materialise(ids, "repeated-ids")
    own = filled.select("doc_id", "key").join(ids, "doc_id", "left_semi").join(classes.select("key", "node"), "key").select("doc_id", "node").distinct()
    least = own.groupBy("doc_id").agg(F.min("node").alias("b"))
    return materialise(own.join(least, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b"), "bridges"), not ids.isEmpty()


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=4, percent=80)


OP3_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT k, doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS ss FROM w),
e AS (SELECT k, len(ss) AS n, unnest(ss) AS g FROM s WHERE doc_id IS NOT NULL),
p AS (SELECT a.k AS a, b.k AS b, any_value(a.n) + any_value(b.n) - count(*) AS u, count(*) AS i
      FROM e a JOIN e b ON a.g = b.g AND a.k <> b.k GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * i >= 80 * u
      UNION SELECT a.k, b.k FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.k <> b.k WHERE len(a.ss) > 0 AND len(b.ss) > 0),
r AS (SELECT k, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.k)
SELECT s.doc_id, len(s.ss) AS n_shingles, c AS component_id, coalesce(s.doc_id = c, true) AS kept
FROM s JOIN (SELECT k, min(c) AS c FROM r GROUP BY k) USING (k)
"""
