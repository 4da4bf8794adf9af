"""Vector code compression: product codes of integer vectors, exact in 64-bit arithmetic.

Components become integers, vectors are cut into equal parts, and each part position has a codebook of a few entries.
The codebooks are broadcast; each round, Arrow batches find every part's nearest entry from |x|^2 - 2 x.c + |c|^2
by exact int64 matrix products, add up the parts of each entry within the task, and a grouped shuffle merges those
sums.  Only sums of the size of the codebooks reach the driver, which divides them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows whose distances are held at once.
ROWS = 2048
#: A label with more than one row in so many is joined by broadcast; there are fewer than this number of them.
HOT_SHARE = 1000


def integer_vectors(column: pa.Array, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of lists of one length; other lengths and components beyond what 64-bit distances hold are an error."""
    if len(pc.unique(pc.list_value_length(column))) > 1:
        raise ValueError("vectors need one length")
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    out = np.floor(x * scale)
    if out.size and np.abs(out).max() > (most := largest_component(out.shape[1])):
        raise OverflowError(f"components times {scale} must not be beyond {most:g}")
    return out.astype(np.int64)


def largest_component(width: int) -> float:
    """Bound of integer components whose squared distances fit in 63 bits, summed over a whole vector."""
    return float(int((2**62 / (4 * max(width, 1))) ** 0.5))


def nearest_entries(x: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), both (rows, parts), of integer vectors ``x``; ties go to the first entry.

    ``codebooks`` is (parts, entries, width).
    """
    parts, _, width = codebooks.shape
    x = x.reshape(len(x), parts, width)
    codes, error = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
    for m in range(parts):
        own = x[:, m]
        distance = (own * own).sum(axis=1)[:, None] - 2 * (own @ codebooks[m].T) + (codebooks[m] * codebooks[m]).sum(axis=1)
        codes[:, m] = distance.argmin(axis=1)  # the first of equals
        error[:, m] = np.take_along_axis(distance, codes[:, m, None], axis=1)[:, 0]
    return codes, error


def _sums(codebooks, scale: int):
    """Rows ``part, entry, position, total, n`` of a task: what the parts of each used entry add up to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = codebooks.value
        parts, entries, width = books.shape
        total, n = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                x = integer_vectors(batch.column(0).slice(start, ROWS), scale)
                slot = (np.arange(parts) * entries + nearest_entries(x, books)[0]).ravel()
                np.add.at(total, slot, x.reshape(-1, width))
                n += np.bincount(slot, minlength=parts * entries)
        used = np.flatnonzero(n)
        slot, position = np.repeat(used, width), np.tile(np.arange(width), len(used))
        columns = [slot // entries, slot % entries, position, total[slot, position], n[slot]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "position", "total", "n"])

    return run


def _coded(codebooks, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = codebooks.value
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                codes, error = nearest_entries(integer_vectors(part.column(part.schema.get_field_index("_x")), scale), books)
                packed = pa.array([row.tobytes() for row in codes.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed, pa.array(error.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return run


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """``vec_id, label, _x`` of the rows whose vector is not null and holds only finite numbers."""
    x = F.col(embedding)
    element = vectors.schema[embedding].dataType.elementType.simpleString()
    if element not in ("float", "double"):
        x = x.cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), x.alias("_x"))
    return rows.where(F.col("_x").isNotNull() & F.forall("_x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


def first_codebooks(rows: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray | None:
    """(parts, entries, width) from the vectors of the smallest ids; rows without an id come last, ties go by the vector."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "_x").limit(entries).select("_x").toArrow()["_x"].combine_chunks()
    if not len(first):
        return None
    sizes = {len(v) for v in first}
    if len(sizes) > 1 or next(iter(sizes)) % parts or sizes == {0}:
        raise ValueError(f"vectors need one length, divisible by {parts}")
    x = integer_vectors(first, scale)
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))


def train_codebooks(rows: DataFrame, codebooks: np.ndarray, rounds: int, scale: int) -> np.ndarray:
    """Codebooks after ``rounds`` rounds: entries become the floor of their parts' mean; unused ones stay."""
    context = rows.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(codebooks)
        sums = rows.select("_x").mapInArrow(_sums(shared, scale), "part long, entry long, position long, total long, n long")
        merged = sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()  # as many rows as the codebooks have components
        at = tuple(merged[c].to_numpy() for c in ("part", "entry", "position"))
        codebooks = codebooks.copy()
        codebooks[at] = merged["total"].to_numpy() // merged["n"].to_numpy()
        shared.unpersist()
    return codebooks


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> tuple[DataFrame, np.ndarray]:
    """(``vec_id, label, code, error``; codebooks (parts, entries, width)): ``code`` has a byte for each part, ``error`` is the squared distance.

    Rows whose vector is null or holds null or non-finite components are dropped.  Other rows each have a row of their own,
    rows that repeat an id or have none included.  With fewer kept rows than ``entries`` the codebooks are as short; with
    none they are empty.  Vectors must have one length, a multiple of ``parts``, and components within ``largest_component``,
    else ValueError or OverflowError is raised.  Other columns are not looked at.
    """
    if entries > 256:
        raise ValueError("a code has one byte for each part: 256 entries at most")
    rows = usable(vectors, vec_id, embedding, label)
    schema = rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")).schema
    books = first_codebooks(rows, parts, entries, scale)
    if books is None:
        return rows.sparkSession.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    books = train_codebooks(rows, books, rounds, scale)
    return rows.mapInArrow(_coded(rows.sparkSession.sparkContext.broadcast(books), scale), schema), books


def decompress(codes: DataFrame, codebooks: np.ndarray, scale: int = SCALE) -> DataFrame:
    """The table with ``vector`` (array<double>), what ``code`` stands for, after its other columns."""
    place = codes.columns.index("code")
    shared = codes.sparkSession.sparkContext.broadcast(codebooks)
    kept = codes.select("*", F.array().cast("array<double>").alias("vector")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column(place).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            x = books[np.arange(len(books)), code].reshape(batch.num_rows, -1) / scale
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(x), pa.list_(pa.float64()))], names=[*batch.schema.names, "vector"])

    return codes.mapInArrow(run, kept)


def with_group_sums(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over rows of an equal ``key``, nulls together; no key is gathered in one task.

    Sums are merged before they are shuffled.  Those of keys with more than one row in HOT_SHARE, fewer than HOT_SHARE keys, go to
    the rows by broadcast; the others, each of few rows, meet theirs by a shuffle.
    """
    sums = materialise(rows.groupBy(F.col(key).alias("_key")).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n")), "group-sums")
    total = sums.agg(F.sum("_n"), F.min("_n")).first()
    is_hot = F.col("_n") * HOT_SHARE > (total[0] or 0)
    own = F.col(key).eqNullSafe(F.col("_key"))
    hot = F.broadcast(sums.where(is_hot).drop("_n"))
    if (total[1] or 0) * HOT_SHARE > (total[0] or 0):
        return rows.join(hot, own, "left").withColumnRenamed("_sum", name).drop("_key")
    found = rows.join(hot, own, "left").withColumn("_is_hot", F.col("_sum").isNotNull()).withColumnRenamed("_sum", "_hot").drop("_key")
    rest = found.where(~F.col("_is_hot")).join(sums.where(~is_hot).drop("_n"), own, "left").drop("_key").withColumnRenamed("_sum", name)
    columns = [F.col(f"`{c}`") for c in rows.columns]
    return found.where("_is_hot").select(*columns, F.col("_hot").alias(name)).unionByName(rest.select(*columns, name))


def codebooks_digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components, in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of all ``embeddings`` that can be coded."""
    coded, books = compress(read_table(spark, sf_dir, "embeddings"))
    coded = with_group_sums(materialise(coded, "vector-codes"), "label", "error", "label_error")
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """Common table expressions of round ``k``: the nearest entry of each part, and the entries after it."""
    return f"""
near{k} AS MATERIALIZED (SELECT row, part, min(struct_pack(d := d, entry := entry)) AS best FROM (
    SELECT p.row, p.part, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts p JOIN books{k} b ON p.part = b.part) GROUP BY row, part),
sums{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
    SELECT n.part, n.best.entry AS entry, i, sum(p.v[i])::BIGINT AS s, count(*) AS n FROM near{k} n JOIN parts p ON p.row = n.row AND p.part = n.part, range(1, len(p.v) + 1) r(i) GROUP BY ALL) GROUP BY part, entry),
books{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(s.v, b.v) AS v FROM books{k} b LEFT JOIN sums{k} s ON b.part = s.part AND b.entry = s.entry)"""


OP12_SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS row, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
parts AS MATERIALIZED (SELECT row, p AS part, q[p * (len(q) // {PARTS}) + 1 : (p + 1) * (len(q) // {PARTS})] AS v FROM kept, range({PARTS}) r(p)),
books0 AS MATERIALIZED (SELECT part, row AS entry, v FROM parts WHERE row < {ENTRIES}),
{_round_sql(0)},
{_round_sql(1)},
{_round_sql(2)},
coded AS (SELECT row, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near2 GROUP BY row),
digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM books2))
SELECT k.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, d.codebooks_sha256 FROM coded c JOIN kept k ON k.row = c.row, digest d
"""
