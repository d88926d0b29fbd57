"""Exact top-k inner-product search with vector-approximation files.

Vectors of integers are dealt to blocks. A block's approximation holds, for every
vector and dimension, the number of its cell on a grid of ``1 << bits`` equal cells
between the block's least and largest value there, in ``bits`` bits. Cells and exact
vectors are columns of their own in one Parquet file, so a scan of cells reads no
vector. As the cells of a dimension are equally wide, a query's bounds on all vectors
of a block are one product of cells and scaled query, plus and minus a reach that is
the same for the whole block: the sum over dimensions of the query's magnitude times
the largest distance of a value there from the middle of its cell.

The first scan reads cells alone and gives each query a threshold: the k-th largest
lower bound of all vectors. The second reads exact vectors of those whose upper
bound is not below it, in the order of falling upper bounds, until the k-th best
score found in the block is above the next one; so the result is certain. A block's
results are its k best per query; the k best of these over all blocks are ranked.
Equal vectors of a block are one entry with all their ids.

Queries are a stated set of rows, against all rows: they come in chunks of a set
size, each broadcast to the blocks, which are never moved again once written.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import UNMARKED, new_path, partitions_for, stored

QUERIES_AT_ONCE = 256


def pack_cells(cells: np.ndarray, bits: int) -> bytes:
    """Bit planes of all cells, one after another."""
    flat = cells.ravel()
    return b"".join(np.packbits(flat >> b & 1).tobytes() for b in range(bits))


def unpack_cells(raw: bytes, count: int, bits: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(bits, -1)
    out = np.zeros(count, np.uint8)
    for b in range(bits):
        out |= np.unpackbits(planes[b], count=count) << b
    return out


class ApproximationFile:
    """One block: distinct vectors as cells and as they are, and the ids of each."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, low: np.ndarray, width: np.ndarray, reach: np.ndarray, cells: np.ndarray, vectors: np.ndarray | None):
        self.ids, self.at, self.low, self.width, self.reach, self.vectors = ids, at, low, width, reach, vectors
        self.cells = cells.astype(np.float32)

    @staticmethod
    def row(block: int, ids: np.ndarray, vectors: np.ndarray, bits: int) -> tuple:
        """What is stored of a block of ``vectors``, integers, with ``ids``."""
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.r_[True, (vectors[1:] != vectors[:-1]).any(axis=1)]
        distinct = vectors[new]
        low, high = distinct.min(axis=0).astype(np.float64), distinct.max(axis=0).astype(np.float64)
        width = np.maximum((high - low) / (1 << bits), 1e-9)
        cells = np.minimum((distinct - low) / width, (1 << bits) - 1).astype(np.uint8)
        reach = np.abs(distinct - (low + (cells + 0.5) * width)).max(axis=0) * (1 + 1e-9)
        top = int(np.abs(distinct).max(initial=0))
        kind = np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64
        at = np.r_[np.flatnonzero(new), len(ids)].astype(np.int64)
        return block, vectors.shape[1], len(distinct), ids.tobytes(), at.tobytes(), low.tobytes(), width.tobytes(), reach.tobytes(), pack_cells(cells, bits), np.dtype(kind).itemsize, distinct.astype(kind).tobytes()

    @classmethod
    def read(cls, row: dict, bits: int) -> ApproximationFile:
        dim, n = row["dim"], row["n"]
        vectors = row.get("vectors")
        if vectors is not None:
            vectors = np.frombuffer(vectors, f"<i{row['size']}").reshape(n, dim)
        grid = (np.frombuffer(row[c], np.float64) for c in ("low", "width", "reach"))
        return cls(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["at"], np.int64), *grid, unpack_cells(row["cells"], n * dim, bits).reshape(n, dim), vectors)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Middles of the bounds of every vector for each query, and how far they reach on either side."""
        scaled = q * self.width
        middle = (scaled.astype(np.float32) @ self.cells.T).astype(np.float64) + (q @ (self.low + 0.5 * self.width))[:, None]
        size = np.abs(scaled).sum(axis=1) * float(self.cells.max(initial=1.0)) + np.abs(q) @ np.abs(self.low + 0.5 * self.width)
        reach = np.abs(q) @ self.reach + size * (q.shape[1] + 8) * 2.0**-23  # single precision
        return np.nan_to_num(middle, nan=np.inf, posinf=np.inf, neginf=np.inf), reach

    def lower_bounds(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
        """For each query the k largest lower bounds of rows other than its own, -inf where there are fewer."""
        out = np.full((len(queries), k), -np.inf)
        held = np.diff(self.at)
        for a in range(0, len(queries), QUERIES_AT_ONCE):
            middle, reach = self.bounds(queries[a : a + QUERIES_AT_ONCE].astype(np.float64))
            middle[~np.isfinite(middle)] = -np.inf
            some = min(middle.shape[1], k + 1)
            best = np.argpartition(-middle, some - 1, axis=1)[:, :some]
            for i in range(len(middle)):
                each = []
                for j in best[i][np.argsort(-middle[i, best[i]], kind="stable")]:
                    own = int((self.ids[self.at[j] : self.at[j + 1]] == query_ids[a + i]).sum())
                    each += [middle[i, j] - reach[i]] * min(int(held[j]) - own, k)
                    if len(each) >= k:
                        break
                out[a + i, : min(len(each), k)] = each[:k]
        return out

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, threshold: np.ndarray, step: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query ids, vector ids, scores) of the k best of each query, other than itself, that can reach its threshold; and how many exact vectors were read."""
        found, read = ([], [], []), 0
        largest = float(np.abs(self.vectors).max(initial=1)) * max(self.vectors.shape[1], 1)
        for a in range(0, len(queries), QUERIES_AT_ONCE):
            q = queries[a : a + QUERIES_AT_ONCE]
            middle, reach = self.bounds(q.astype(np.float64))
            middle += reach[:, None]
            hit = middle >= threshold[a : a + QUERIES_AT_ONCE, None]
            for i in np.flatnonzero(hit.any(axis=1)):
                own = np.flatnonzero(hit[i])
                own = own[np.argsort(-middle[i, own], kind="stable")]
                ids, scores, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
                whole = largest * float(np.abs(q[i]).max(initial=1)) < 2**52
                while at < len(own) and (len(scores) < k or middle[i, own[at]] >= scores[-1]):
                    now = own[at : at + step]
                    exact = (self.vectors[now].astype(np.float64) @ q[i].astype(np.float64)).astype(np.int64) if whole else self.vectors[now].astype(np.int64) @ q[i]
                    rows = [self.ids[self.at[j] : self.at[j + 1]] for j in now]
                    rows = [r[r != query_ids[a + i]][:k] for r in rows]  # sorted: of equal vectors the smallest ids
                    ids, scores = np.concatenate([ids, *rows]), np.concatenate([scores, np.repeat(exact, [len(r) for r in rows])])
                    best = np.lexsort((ids, -scores))[:k]
                    ids, scores, at = ids[best], scores[best], at + len(now)
                read += at
                for part, x in zip(found, (np.full(len(ids), query_ids[a + i]), ids, scores)):
                    part.append(x)
        return *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found), read


_CELLS = "block long, dim int, n int, ids binary, at binary, low binary, width binary, reach binary, cells binary"
_FILE = _CELLS + ", size int, vectors binary"


def _write_blocks(block_rows: int, bits: int):
    """Rows in the order of (block, dim) to one stored row for at most ``block_rows`` vectors of a block."""
    names = [c.split()[0] for c in _FILE.split(", ")]
    schema = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in _FILE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors = None, [], []

        def row() -> pa.RecordBatch:
            made = ApproximationFile.row(key[0], np.array(ids, np.int64), np.stack(vectors).astype(np.int64), bits)
            return pa.RecordBatch.from_pylist([dict(zip(names, made))], schema=schema)

        for batch in batches:
            for block, dim, i, v in zip(batch.column("block").to_pylist(), batch.column("dim").to_pylist(), batch.column("id").to_pylist(), batch.column("v")):
                if (block, dim) != key or len(ids) >= block_rows:
                    if ids:
                        yield row()
                    key, ids, vectors = (block, dim), [], []
                ids.append(i)
                vectors.append(v.values.to_numpy())
        if ids:
            yield row()

    return run


def _files(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[int, ApproximationFile]]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            yield row["dim"], ApproximationFile.read(row, bits)


def _first_scan(held, k: int, bits: int, pieces: int):
    """Each task's k largest lower bounds of each query, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim, total = held.value
        best = None
        for dim, file in _files(batches, bits):
            if dim in by_dim:
                where, ids, q = by_dim[dim]
                best = np.full((total, k), -np.inf) if best is None else best
                best[where] = -np.sort(-np.concatenate([best[where], file.lower_bounds(ids, q, k)], axis=1), axis=1)[:, :k]
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array([x.tobytes() for x in np.array_split(best, pieces)], pa.binary())], names=["piece", "best"])

    return run


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, x in zip(batch.column("piece").to_pylist(), batch.column("best").to_pylist()):
                x = np.frombuffer(x, np.float64).reshape(-1, k)
                held[p] = -np.sort(-np.concatenate([held[p], x], axis=1), axis=1)[:, :k] if p in held else x
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x[:, -1].tobytes() for x in held.values()], pa.binary())], names=["piece", "best"])

    return run


def _second_scan(held, threshold, k: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim, _ = held.value
        for dim, file in _files(batches, bits):
            if dim in by_dim:
                where, ids, q = by_dim[dim]
                found, candidates, scores, read = file.search(ids, q, k, threshold.value[where])
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(candidates), pa.array(scores), pa.array(np.r_[read, np.zeros(len(found) - 1, np.int64)])], names=["query_id", "vec_id", "score", "read"])

    return run


def to_integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v, dim) with v the floors of ``scale`` times the components, as doubles.

    Rows without a vector, without components or with one that is null or not
    finite are left out, as are those with a null id.
    """
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(~bad)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * F.lit(float(scale)))).alias("v"), F.size(x).alias("dim"))


def found_in_blocks(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, bits: int = 6, block: int = 4096, chunk: int = 16384) -> DataFrame:
    """(query_id, vec_id, score, read): each block's k best of each query that can be among its k best; ``read`` adds up the exact vectors read."""
    spark = vectors.sparkSession
    ints = to_integers(vectors, id_col, vector_col, scale)
    n, m = ints.agg(F.count("*"), F.count_if(is_query(F.col("id")))).first()
    n_blocks, parts, path = max(1, -(-n // block)), partitions_for(spark), new_path(spark, "approximations")
    dealt = ints.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
    dealt = dealt.repartition(min(parts, n_blocks), "block").sortWithinPartitions("block", "dim").select("block", "dim", "id", "v")
    dealt.mapInArrow(_write_blocks(2 * block, bits), _FILE).write.options(**UNMARKED).parquet(path)
    schema = T.StructType.fromDDL(_FILE)
    file = spark.read.schema(schema).parquet(path)
    n_chunks = -(-m // chunk)
    found = [spark.createDataFrame([], "query_id long, vec_id long, score long, read long")]
    for c in range(n_chunks):
        asked = ints.where(is_query(F.col("id")) & (F.pmod(F.xxhash64("id", F.lit(9)), F.lit(n_chunks)) == c)).select("id", "dim", "v").toArrow()  # about chunk rows
        ids, dims, values = asked.column("id").to_numpy(), asked.column("dim").to_numpy(), asked.column("v").combine_chunks()
        by_dim = {}
        for d in np.unique(dims):
            where = np.flatnonzero(dims == d)
            by_dim[int(d)] = (where, ids[where], values.take(pa.array(where)).flatten().to_numpy().astype(np.int64).reshape(len(where), int(d)))
        held = spark.sparkContext.broadcast((by_dim, len(ids)))
        pieces = min(64, max(1, len(ids)))
        low = file.select(*(x.split()[0] for x in _CELLS.split(", "))).mapInArrow(_first_scan(held, k, bits, pieces), "piece int, best binary").repartition(min(parts, pieces), "piece").mapInArrow(_merge(k), "piece int, best binary").toArrow()
        threshold = np.full(len(ids), -np.inf)
        where = np.array_split(np.arange(len(ids)), pieces)
        for p, x in zip(low.column("piece").to_pylist(), low.column("best").to_pylist()):
            threshold[where[p]] = np.frombuffer(x, np.float64)
        each = file.mapInArrow(_second_scan(held, spark.sparkContext.broadcast(threshold), k, bits), "query_id long, vec_id long, score long, read long")
        found.append(each if n_chunks == 1 else stored(each, "found"))
    return reduce(DataFrame.unionByName, found)


def exact_topk(vectors: DataFrame, is_query, k: int = 5, **how) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with the other rows.

    ``is_query`` is a condition on ``id_col``. Ties go to the smaller id. Vectors
    are as ``to_integers`` gives them; a pair of different dimensions has no
    score. Rows with a query's own id are its own. A query without candidates
    has no rows, and an empty table gives none. Inner products must fit a long.
    ``how``: see ``found_in_blocks``; at most about ``chunk`` queries are at the
    driver and in a broadcast at a time.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found_in_blocks(vectors, is_query, k, **how)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
