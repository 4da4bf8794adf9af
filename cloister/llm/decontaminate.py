"""Benchmark decontamination with an Aho-Corasick automaton.

The windows of all benchmark items (runs of consecutive normalised words) form one automaton.  Each
document is normalised byte for byte, so a byte offset in the normalised text is the offset in the
original UTF-8 text, and scanned once; the matches give hit words and their spans in the original.
Documents are not shuffled: the automaton goes to them.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, texts

#: Bytes of window text in one automaton, which takes about 36 times that.  A larger benchmark becomes several
#: automata, of which a task holds one at a time; of the others a worker holds their compressed windows only.
AUTOMATON_BYTES = 12 << 20
#: With several automata, each scans so many bytes of documents before the next is built.
SCAN_BYTES = 48 << 20

_RESULT = "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>"


def normal_bytes() -> bytes:
    """Byte table: A-Z to a-z, other ASCII bytes that aren't letters or digits to a space, the rest as they are."""
    keep = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
    return bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in keep else 0x20 for c in range(256))


_NORMAL = normal_bytes()


def item_windows(text: str | None, width: int) -> list[str]:
    """Windows of an item as `` word word ... `` (byte per character); an item of fewer words, but not none, is one window."""
    words = (text or "").encode().translate(_NORMAL).split()
    runs = [words[i : i + width] for i in range(max(1, len(words) - width + 1))] if words else []
    return [f" {b' '.join(run).decode('latin-1')} " for run in runs]


def window_shards(items: Iterator[tuple[str | None, str | None]], width: int, most: int = AUTOMATON_BYTES) -> Iterator[dict[str, list[str | None]]]:
    """Maps window -> ids of its items, each of bounded size."""
    shard: dict[str, list[str | None]] = {}
    size = 0
    for item, text in items:
        for window in item_windows(text, width):
            owners = shard.setdefault(window, [])
            if item not in owners[-1:]:
                owners.append(item)
                size += len(window) + len(item or "")
        if size >= most:
            yield shard
            shard, size = {}, 0
    if shard:
        yield shard


def build_automaton(shard: dict[str, list[str | None]]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for window, owners in shard.items():
        automaton.add_word(window, (len(window), owners))
    automaton.make_automaton()
    return automaton


def _squeeze(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Normalised words with one space around each, and each word's byte span in the text."""
    data = np.frombuffer(text, np.uint8)
    inside = np.concatenate(([False], data != 0x20, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return b" " + b" ".join(text.split()) + b" ", edges[::2], edges[1::2]


def scan(text: str, automata: list[ahocorasick.Automaton]) -> tuple[int, int, set[str], list[tuple[int, int]]]:
    """(words, hit words, items, byte spans of runs of hit words in the original text)."""
    plain = text.encode().translate(_NORMAL)
    squeezed = b" " + b" ".join(plain.split()) + b" "
    subject, n_words = squeezed.decode("latin-1"), squeezed.count(b" ") - 1 if len(squeezed) > 2 else 0
    matches = [(end, value) for automaton in automata for end, value in automaton.iter(subject)] if n_words else []
    if not matches:
        return n_words, 0, set(), []
    _, starts, ends = _squeeze(plain)
    spaces = np.flatnonzero(np.frombuffer(squeezed, np.uint8) == 0x20)  # word w lies between spaces w and w + 1
    change = np.zeros(n_words + 1, np.int64)
    last = np.searchsorted(spaces, [end for end, _ in matches])
    first = np.searchsorted(spaces, [end - length + 1 for end, (length, _) in matches])
    np.add.at(change, first, 1)
    np.add.at(change, last, -1)
    hit = np.cumsum(change[:-1]) > 0
    items = {item for _, (_, owners) in matches for item in owners}
    bounds = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    spans = [(int(starts[a]), int(ends[b - 1])) for a, b in zip(bounds[::2], bounds[1::2], strict=True)]
    return n_words, int(hit.sum()), items, spans


_built: dict[str, ahocorasick.Automaton] = {}


def _scanner(shards: list[Broadcast]):
    name = uuid.uuid4().hex

    def automata() -> Iterator[ahocorasick.Automaton]:
        for k, shard in enumerate(shards):
            key = f"{name}-{k}"
            if key not in _built:  # a reused worker keeps the last automaton
                _built.clear()
                _built[key] = build_automaton(pickle.loads(zlib.decompress(shard.value)))
            yield _built[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, SCAN_BYTES if len(shards) > 1 else 0):
            merged: list[list] = [[None] * batch.num_rows for batch in group]
            for automaton in automata() if shards else iter([ahocorasick.Automaton()]):
                for batch, results in zip(group, merged, strict=True):
                    for i, value in enumerate(batch.column(1)):
                        text = value.as_py() or ""
                        found = scan(text, [automaton] if len(automaton) else [])
                        results[i] = found if results[i] is None else _merge(results[i], found, text)
            for batch, results in zip(group, merged, strict=True):
                yield _table(batch.column(0), results)

    return run


def _groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of batches of at least ``least`` bytes; single batches if that is 0."""
    group, held = [], 0
    for batch in batches:
        group.append(batch)
        held += batch.nbytes
        if held >= least:
            yield group
            group, held = [], 0
    if group:
        yield group


def _table(doc_ids: pa.Array, results: list[tuple]) -> pa.RecordBatch:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return pa.RecordBatch.from_arrays(
        [
            doc_ids,
            pa.array([r[0] for r in results], pa.int64()),
            pa.array([r[1] for r in results], pa.int64()),
            pa.array([sorted(r[2], key=lambda item: (item is None, item)) for r in results], pa.list_(pa.string())),
            pa.array([[{"start": a, "end": b} for a, b in r[3]] for r in results], pa.list_(span)),
        ],
        names=["doc_id", "n_words", "n_hit", "item_ids", "spans"],
    )


def _merge(one: tuple, two: tuple, text: str) -> tuple:
    """Results of two automata over the same text; words in both results count once."""
    if not two[3] or not one[3]:
        return one if not two[3] else two
    _, starts, ends = _squeeze(text.encode().translate(_NORMAL))
    hit = np.zeros(one[0], bool)
    for a, b in (*one[3], *two[3]):
        hit[np.searchsorted(starts, a) : np.searchsorted(ends, b) + 1] = True
    bounds = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    spans = [(int(starts[a]), int(ends[b - 1])) for a, b in zip(bounds[::2], bounds[1::2], strict=True)]
    return one[0], int(hit.sum()), one[2] | two[2], spans


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", automaton_bytes: int = AUTOMATON_BYTES
) -> DataFrame:
    """``doc_id, n_words, n_hit, item_ids, spans`` of every row of ``docs``.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased.  ``n_hit``
    counts the words inside any occurrence of a benchmark window, ``item_ids`` (sorted as strings) are
    the items with such windows and ``spans`` the byte ranges of hit runs in the original UTF-8 text.
    Null and wordless texts have no words; null and wordless items no windows; repeated items count
    once and repeated rows each.  Items without an id hit like others and are one null, last in ``item_ids``.
    With an empty benchmark nothing is hit.  Texts of any length are scanned whole; other columns are not looked at.
    """
    scanner = contamination_scanner(docs.sparkSession, benchmark, width, item_id, item_text, automaton_bytes)
    return texts(docs, doc_id, text).mapInArrow(scanner, _RESULT)


def contamination_scanner(
    spark: SparkSession, benchmark: DataFrame, width: int = 10, item_id: str = "item_id", item_text: str = "text", automaton_bytes: int = AUTOMATON_BYTES
):
    """The columns of ``find_contamination`` for batches of ids and texts, their rows in order."""
    items = benchmark.select(F.col(item_id).cast("string"), F.col(item_text)).toLocalIterator()
    shards = window_shards(((r[0], r[1]) for r in items), width, automaton_bytes)
    return _scanner([spark.sparkContext.broadcast(zlib.compress(pickle.dumps(shard))) for shard in shards])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 9], ' ') AS g, least(len(ws), 10) AS n
        FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, i, sizes.n, array_to_string(ws[i:i + sizes.n - 1], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) p, sizes WHERE i + sizes.n - 1 <= len(ws)),
hits AS (SELECT pos.doc_id, pos.i, pos.n, win.item_id FROM pos JOIN win ON pos.g = win.g AND pos.n = win.n),
words AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
