"""Approximate maximum-inner-product search with score-aware (anisotropic) quantisation.

A vector is quantised in two-dimensional pieces to 16 centres each, four bits a piece.  Centres and
codes minimise a loss that weighs the part of the residual parallel to the vector more than the rest,
as that part is what changes large inner products.  Vectors are dealt to cells by their direction.  A query scans the codes of
the cells nearest to it by table look-up; candidates within a margin of the k-th best scanned score are scored again on one
byte a component, and those within the much smaller margin of that get their exact score by a join with the original vectors.

Centres and cells are fitted on a bounded sample, on which the number of cells that a query scans is also measured; all rows are
encoded.  Cells and the queries of a cell are cut into blocks; a task takes one of each.  Only ids and codes are copied to
blocks; the vectors themselves are not.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table

#: Vectors in the sample that the centres are fitted on.
FIT_ROWS = 6000
#: Vectors and queries of a block at most (on average), and vectors of a cell at least, on average.
VECTOR_BLOCK, QUERY_BLOCK, LEAST_CELL = 262_144, 16_384, 8_192
#: Cells at most, and the recall in the sample for which a query scans enough of them.
MAX_CELLS, CELL_RECALL = 512, 0.998
#: Inner products from this share of a vector's norm on matter; it sets the weight of the parallel error.
THRESHOLD = 0.2
#: Standard deviations of the scan's error below the k-th best that candidates reach, by the four-bit codes and by bytes.
MARGIN, FINE_MARGIN = 3.0, 6.0
_CENTRES, _WIDTH = 16, 2


@dataclass
class Quantiser:
    centres: np.ndarray  # (pieces, 16, 2)
    weight: float  # of the squared parallel error, less one
    error: float  # deviation of scanned from exact scores

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """(n, pieces) codes by coordinate descent on the anisotropic loss."""
        x = _padded(x, self.centres)
        unit = x / np.maximum(np.linalg.norm(x, axis=(1, 2)), 1e-30)[:, None, None]
        codes = np.stack([_nearest(x[:, m], self.centres[m]) for m in range(len(self.centres))], axis=1)
        parallel = np.stack([((x[:, m] - self.centres[m][codes[:, m]]) * unit[:, m]).sum(1) for m in range(len(self.centres))], axis=1)
        total = parallel.sum(axis=1)
        for _ in range(rounds):
            for m, centres in enumerate(self.centres):
                residual = x[:, m, None, :] - centres
                along = np.einsum("ncw,nw->nc", residual, unit[:, m])
                rest = total - parallel[:, m]
                codes[:, m] = ((residual**2).sum(2) + self.weight * (rest[:, None] + along) ** 2).argmin(1)
                parallel[:, m] = along[np.arange(len(x)), codes[:, m]]
                total = rest + parallel[:, m]
        return codes.astype(np.uint8)

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two codes to a byte."""
        if codes.shape[1] % 2:
            codes = np.concatenate((codes, np.zeros((len(codes), 1), np.uint8)), axis=1)
        return codes[:, ::2] | codes[:, 1::2] << 4

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(bytes, queries, 256) scores that each code byte adds."""
        each = np.einsum("qmw,mcw->mqc", _padded(queries, self.centres), self.centres).astype(np.float32)
        if len(each) % 2:
            each = np.concatenate((each, np.zeros_like(each[:1])))
        return (each[1::2, :, :, None] + each[::2, :, None, :]).reshape(len(each) // 2, len(queries), 256)


def _padded(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    width = len(centres) * _WIDTH
    if x.shape[1] < width:
        x = np.concatenate((x, np.zeros((len(x), width - x.shape[1]))), axis=1)
    return x.reshape(len(x), -1, _WIDTH)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None] - centres) ** 2).sum(2).argmin(1)


def fit_quantiser(x: np.ndarray, threshold: float = THRESHOLD, rounds: int = 4, seed: int = 1) -> Quantiser:
    """Centres by k-means for each piece, then alternate anisotropic codes with the least-squares centres for them."""
    rng = np.random.default_rng(seed)
    n, dim = x.shape
    pieces = -(-dim // _WIDTH)
    parts = _padded(x, np.zeros((pieces, 1, 1)))
    centres = np.empty((pieces, _CENTRES, _WIDTH))
    for m in range(pieces):
        c = parts[rng.integers(0, n, _CENTRES), m] + rng.normal(0, 1e-6, (_CENTRES, _WIDTH))
        for _ in range(12):
            code = _nearest(parts[:, m], c)
            for k in range(_CENTRES):
                own = parts[code == k, m]
                c[k] = own.mean(axis=0) if len(own) else parts[rng.integers(n), m]
        centres[m] = c
    weight = max(dim - 1, 1) * threshold**2 / (1 - threshold**2) - 1
    quantiser = Quantiser(centres, max(weight, 0.0), 0.0)
    unit = parts / np.maximum(np.linalg.norm(parts, axis=(1, 2)), 1e-30)[:, None, None]
    for _ in range(rounds):
        codes = quantiser.encode(x)
        slot = np.arange(pieces) * _CENTRES + codes  # (n, pieces)
        u = np.zeros((n, pieces * _CENTRES, _WIDTH))
        u[np.arange(n)[:, None], slot] = unit
        u = u.reshape(n, -1)
        side = np.zeros((pieces * _CENTRES, _WIDTH))
        np.add.at(side, slot, parts * (1 + quantiser.weight))
        count = np.bincount(slot.ravel(), minlength=pieces * _CENTRES).repeat(_WIDTH).astype(float)
        left = quantiser.weight * (u.T @ u) + np.diag(count + 1e-6)
        right = side.ravel() + 1e-6 * quantiser.centres.ravel()
        quantiser.centres = np.linalg.solve(left, right).reshape(pieces, _CENTRES, _WIDTH)
    codes = quantiser.encode(x)
    back = quantiser.centres[np.arange(pieces), codes].reshape(n, -1)[:, :dim]
    some = x[rng.integers(0, n, min(n, 200))]
    exact = some @ x.T
    high = exact >= np.quantile(exact, 0.98, axis=1, keepdims=True)
    quantiser.error = float((some @ back.T - exact)[high].std()) if n > 1 else 0.0
    return quantiser


def fit_cells(x: np.ndarray, cells: int, k: int, recall: float = CELL_RECALL, seed: int = 2) -> tuple[np.ndarray, int]:
    """(unit centres of cells, cells to scan): by k-means on directions, and by the recall of the sample's own nearest vectors,
    which are farther away, and so in other cells more often, than those of the whole table."""
    rng = np.random.default_rng(seed)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    centres = unit[rng.choice(len(unit), min(cells, len(unit)), replace=False)]
    for _ in range(10):
        own = (unit @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                total = unit[own == c].sum(axis=0)
                centres[c] = total / max(np.linalg.norm(total), 1e-30)
    own = (unit @ centres.T).argmax(axis=1)
    some = rng.choice(len(x), min(300, len(x)), replace=False)
    score = x[some] @ x.T
    score[np.arange(len(some)), some] = -np.inf
    near = np.argsort(-score, axis=1)[:, : min(k, max(len(x) - 1, 1))]
    order = np.argsort(-(x[some] @ centres.T), axis=1)
    place = np.empty_like(order)
    place[np.arange(len(some))[:, None], order] = np.arange(len(centres))
    needed = np.sort(place[np.arange(len(some))[:, None], own[near]].ravel())  # the number of cells before the one with each neighbour
    return centres, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _encoded(quantiser: Quantiser, cells: np.ndarray):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1)).astype(np.float64)
            packed = np.concatenate([quantiser.pack(quantiser.encode(x[i : i + 4096])) for i in range(0, len(x), 4096)])
            cell = (x @ cells.T).argmax(axis=1).astype(np.int32)
            step = np.abs(x).max(axis=1) / 127
            fine = np.rint(x / step[:, None]).astype(np.int8)
            columns = [pa.array([row.tobytes() for row in part], pa.binary()) for part in (packed, fine)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(step.astype(np.float32)), pa.array(cell)], names=["vec_id", "codes", "fine", "step", "cell"])

    return run


def _probes(cells: np.ndarray, scan: int):
    """Each query once for each of its ``scan`` nearest cells."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1)).astype(np.float64)
                nearest = np.argsort(-(x @ cells.T), axis=1, kind="stable")[:, :scan]
                rows = batch.take(pa.array(np.repeat(np.arange(len(x)), nearest.shape[1])))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(nearest.ravel().astype(np.int32))], names=["query_id", "q", "cell"])

    return run


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("scanned", pa.float32()), ("slack", pa.float32())])


def _scanned(quantiser: Quantiser, k: int):
    margin = MARGIN * quantiser.error

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        ids = vectors["vec_id"].to_numpy()
        codes = np.frombuffer(b"".join(vectors["codes"].to_pylist()), np.uint8).reshape(len(ids), -1).T.copy()
        fine = np.frombuffer(b"".join(vectors["fine"].to_pylist()), np.int8).reshape(len(ids), -1)
        step = vectors["step"].to_numpy()
        query_ids, q = queries["query_id"].to_numpy(), _matrix(queries["q"]).astype(np.float64)
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.float32)], [np.empty(0, np.float32)]]
        for start in range(0, len(q), 32):
            part = q[start : start + 32]
            scanned = np.zeros((len(part), len(ids)), np.float32)
            for table, code in zip(quantiser.tables(part), codes, strict=True):
                scanned += table[:, code]
            for row, own, query in zip(scanned, query_ids[start : start + 32], part, strict=True):
                near = np.flatnonzero(row >= _kth(row, k + 1) - margin)
                near = near[ids[near] != own]
                score = fine[near].astype(np.float32) @ query.astype(np.float32) * step[near]
                slack = FINE_MARGIN * float(step[near].max(initial=0)) / 12**0.5 * float(np.linalg.norm(query))
                best = score >= _kth(score, k) - slack
                for column, values in zip(out, (np.full(best.sum(), own), ids[near[best]], score[best], np.full(best.sum(), slack, np.float32)), strict=True):
                    column.append(values)
        return pa.table([np.concatenate(c) for c in out], schema=_FOUND)

    return run


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value; below all if there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def search(
    vectors: DataFrame, is_query: str, k: int = 20, fit_rows: int = FIT_ROWS, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where the SQL condition ``is_query`` (on ``vec_id``) holds,
    the ``k`` other rows with the largest inner product found, nearest first, ties to the smaller id.

    Scores are exact, in double precision.  Null and zero vectors, those with null or non-finite
    components and those of another length than most take no part, nor do rows without an id.  Rows that
    repeat an id count once (the smallest vector).  Of equal vectors only the k + 1 smallest ids
    can be among the k nearest, so the others are left out before the scan, with the same result.
    """
    spark = vectors.sparkSession
    element = vectors.schema[embedding].dataType.elementType.simpleString()
    x = F.col(embedding).cast("array<float>" if element == "float" else "array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where(good & F.col("vec_id").isNotNull())
    rows = materialise(rows.groupBy("vec_id").agg(F.min("x").alias("x")), "vectors")
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == sizes["size"])
    n = sizes["count"]
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"))
    share = min(1.0, fit_rows / n)
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1_000_000)) < share * 1_000_000).orderBy("vec_id").limit(2 * fit_rows)
    sample = _matrix(sample.select("x").toArrow()["x"]).astype(np.float64)
    quantiser = fit_quantiser(sample)
    cells, scan = fit_cells(sample, max(1, min(MAX_CELLS, n // LEAST_CELL, len(sample) // 8)), k)
    copies = Window.partitionBy(F.xxhash64("x"), F.xxhash64(F.lit(5), "x")).orderBy("vec_id")
    index = rows.withColumn("_copy", F.row_number().over(copies)).where(f"_copy <= {k + 1}").select("vec_id", "x")
    index = materialise(index.mapInArrow(_encoded(quantiser, cells), "vec_id long, codes binary, fine binary, step float, cell int"), "codes")
    probes = queries.mapInArrow(_probes(cells, scan), f"query_id long, q array<{element if element == 'float' else 'double'}>, cell int")
    probes = materialise(probes, "probes")
    held, asked = ({r["cell"]: r["n"] for r in t.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()} for t in (index, probes))  # a row for each cell
    blocks = lambda counts, size: F.element_at(F.array(*[F.lit(max(1, -(-counts.get(c, 0) // size))) for c in range(len(cells))]), F.col("cell") + 1)
    v_blocks, q_blocks = blocks(held, VECTOR_BLOCK), blocks(asked, QUERY_BLOCK)
    others = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    left = index.select("vec_id", "codes", "fine", "step", "cell", F.pmod(F.xxhash64("vec_id"), v_blocks).cast("int").alias("_v"), others(q_blocks).alias("_q"))
    right = probes.select("query_id", "q", "cell", F.pmod(F.xxhash64("query_id"), q_blocks).cast("int").alias("_q"), others(v_blocks).alias("_v"))
    by = ("cell", "_v", "_q")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_scanned(quantiser, k), "query_id long, vec_id long, scanned float, slack float")
    best = Window.partitionBy("query_id").orderBy(F.desc("scanned"))
    found = found.withColumn("_n", F.row_number().over(best))
    whole = Window.partitionBy("query_id")
    found = found.withColumn("_kth", F.max(F.when(F.col("_n") == k, F.col("scanned"))).over(whole)).withColumn("slack", F.max("slack").over(whole))
    found = found.where("_kth is null or scanned >= _kth - slack").select("query_id", "vec_id")
    exact = F.aggregate(F.zip_with("x", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda total, v: total + v)
    scored = found.join(rows, "vec_id").join(queries, "query_id").select("query_id", "vec_id", exact.alias("score"))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(nearest)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)
