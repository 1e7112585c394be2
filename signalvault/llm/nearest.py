"""Approximate nearest neighbours with randomly rotated one-bit codes.

The residual of a vector to its cell's centroid is rotated at random and stored as the signs of its components: one
bit each, and two scalars, its length and the cosine between the residual and its code. For a query the inner
product with all codes of a block gives unbiased estimates of the distances and, from the cosine, an error bound
for each; vectors whose lower bound does not exceed the k-th exact distance found so far are reranked with the
original vectors. Cells and rotation are fitted on a bounded sample (``FIT_ROWS``); every row is indexed.

A query visits the ``probes`` cells with the nearest centroids, all by default. Cells are dealt into blocks of about
BLOCK rows and queries into blocks too, so no task meets more than two blocks however large a cell is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalvault.session import cut_lineage

FIT_ROWS = 20_000
BLOCK = 8192
QUERY_BLOCK = 2048
CELL_ROWS = 4096
MAX_CELLS = 256
BOUND = 2.5
"""Standard errors of the bound; 2.5 keeps 99 of 100 true neighbours."""

_ROWS = "vec_id long, cell int, vector binary, code binary, norm double, cosine double"


@dataclass
class BitIndex:
    centroids: np.ndarray
    rotation: np.ndarray

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to all centroids."""
        return (x**2).sum(1)[:, None] + (self.centroids**2).sum(1)[None] - 2 * x @ self.centroids.T

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell, packed signs, length of the residual and its cosine with the code."""
        cell = self.cells(x).argmin(1)
        residual = (x - self.centroids[cell]) @ self.rotation
        norm = np.linalg.norm(residual, axis=1)
        signs = residual >= 0
        cosine = np.abs(residual).sum(1) / (np.maximum(norm, 1e-300) * np.sqrt(self.dim))
        return cell, np.packbits(signs, axis=1), norm, np.where(norm > 0, cosine, 1.0)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vector): rows with an id and a vector of finite numbers that is not null and not all zero."""
    v = F.col(embedding).cast("array<double>")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector")) \
        .where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & F.forall("vector", number) & F.exists("vector", lambda x: x != 0))


def fit_index(vectors: DataFrame, seed: int = 1) -> BitIndex | None:
    """Centroids and rotation for the vectors of the most common length; None when there are none."""
    sizes = vectors.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return None
    dim, rows = sizes[0].dim, sizes[0].n
    order = F.xxhash64(F.lit(seed), "vec_id")
    share = min(1.0, 0.95 * FIT_ROWS / rows)
    sample = vectors.where((F.size("vector") == dim) & (F.pmod(order, F.lit(1_000_000)) <= int(share * 1_000_000))) \
        .select("vec_id", "vector").limit(FIT_ROWS).toPandas().sort_values("vec_id")
    x = np.array(sample["vector"].tolist(), np.float64).reshape(-1, dim)
    random = np.random.default_rng(seed)
    cells = int(max(1, min(MAX_CELLS, rows // CELL_ROWS, len(x))))
    centroids = x[random.choice(len(x), cells, replace=False)]
    for _ in range(10):
        near = ((x**2).sum(1)[:, None] + (centroids**2).sum(1)[None] - 2 * x @ centroids.T).argmin(1)
        count = np.bincount(near, minlength=cells)
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
    rotation = np.linalg.qr(random.standard_normal((dim, dim)))[0]
    return BitIndex(centroids, rotation)


def build_index(vectors: DataFrame, index: BitIndex) -> DataFrame:
    """The code of every vector, written once."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, index.dim)
                cell, code, norm, cosine = index.encode(x)
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id"), pa.array(cell.astype(np.int32)), pa.array([v.tobytes() for v in x], pa.binary()),
                    pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(cosine)],
                    ["vec_id", "cell", "vector", "code", "norm", "cosine"])

    return cut_lineage(vectors.where(F.size("vector") == index.dim).mapInArrow(encode, _ROWS))


def search_block(index: BitIndex, cell: int, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norm: np.ndarray, cosine: np.ndarray,
                 query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k nearest of a block for each query, as far as the bounds let tell: (query_id, vec_id, distance)."""
    dim = index.dim
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    away = (queries - index.centroids[cell]) @ index.rotation
    length = np.linalg.norm(away, axis=1)
    unit = away / np.maximum(length, 1e-300)[:, None]
    product = (signs @ unit.T.astype(np.float32) / np.float32(np.sqrt(dim))).T / cosine[None, :]
    error = BOUND * np.sqrt(np.maximum(0.0, 1 - cosine**2)) / cosine / np.sqrt(max(1, dim - 1))
    out = []
    for q in range(len(queries)):
        base = norm**2 + length[q]**2
        reach = 2 * norm * length[q]
        low = base - reach * (product[q] + error)
        other = ids != query_ids[q]
        first = np.flatnonzero(other)
        if len(first) > 4 * k:
            guess = (base - reach * product[q])[first]
            first = first[np.argpartition(guess, 4 * k)[:4 * k]]
        squared = ((x[first] - queries[q])**2).sum(1)
        worst = np.partition(squared, k - 1)[k - 1] if len(squared) >= k else np.inf
        rest = np.flatnonzero(other & (low <= worst * (1 + 1e-9)))
        near = np.union1d(first, rest)
        distance = np.sqrt(((x[near] - queries[q])**2).sum(1))
        best = np.lexsort((ids[near], distance))[:k]
        out += [(int(query_ids[q]), int(ids[near[i]]), float(distance[i])) for i in best]
    return out


def nearest(vectors: DataFrame, is_query, k: int = 10, probes: int | None = None, seed: int = 1) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest other rows of every row whose vec_id ``is_query`` accepts.

    Score is the Euclidean distance of the original vectors in double precision; ties go to the smaller vec_id; with
    fewer than k candidates all are returned. Rows without an id and vectors that are null, zero or hold null or
    non-finite components take no part, nor do those of another length than most. ``vec_id`` is taken for unique;
    rows that share one are never each other's neighbours. An empty table gives no rows.
    """
    given = usable(vectors)
    index = fit_index(given, seed)
    spark = vectors.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    table = build_index(given, index)
    count = len(index.centroids)
    sizes = {r.cell: r.n for r in table.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a cell, MAX_CELLS at most
    members = np.array([sizes.get(c, 0) for c in range(count)])
    visits = count if probes is None else min(count, probes)
    blocks = np.maximum(1, -(-members // BLOCK))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cells, rows = batch.column("vec_id").to_pylist(), [], []
            x = np.array([np.frombuffer(v.as_buffer(), np.float64) for v in batch.column("vector")]).reshape(-1, index.dim)
            for i, order in enumerate(index.cells(x).argsort(1)):
                reached = int(np.searchsorted(np.cumsum(members[order]), 4 * k + 1)) + 1
                own = order[:max(visits, reached)]
                own = own[members[own] > 0]
                cells.append(own), rows.append(np.full(len(own), i))
            if ids:
                rows, cells = np.concatenate(rows), np.concatenate(cells)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids)[rows]), pa.array(cells.astype(np.int32)), batch.column("vector").take(pa.array(rows))],
                                                 ["query_id", "cell", "vector"])

    per_cell = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("cell") + 1)
    asked = table.where(is_query(F.col("vec_id"))).select("vec_id", "vector")
    many = max(1, -(-asked.count() // QUERY_BLOCK))
    queries = asked.mapInArrow(route, "query_id long, cell int, vector binary") \
        .withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(many)).cast("int")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), per_cell - 1)))
    rows = table.withColumn("block", F.pmod(F.xxhash64("vec_id"), per_cell.cast("long")).cast("int")) \
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            def matrix(column: pa.ChunkedArray, kind) -> np.ndarray:
                return np.stack([np.frombuffer(v.as_buffer(), kind) for v in column])

            found = search_block(index, left.column("cell")[0].as_py(), left.column("vec_id").to_numpy(), matrix(left.column("vector"), np.float64),
                                 matrix(left.column("code"), np.uint8), left.column("norm").to_numpy(), left.column("cosine").to_numpy(),
                                 right.column("query_id").to_numpy(), matrix(right.column("vector"), np.float64), k)
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*found) if found else ([], [], []), kinds)], ["query_id", "vec_id", "score"])

    keys = ["cell", "block", "part"]
    found = rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
