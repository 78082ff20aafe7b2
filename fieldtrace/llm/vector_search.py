"""Exact top-k search by inner product over vector-approximation files.

The vectors are written once as lots.  A lot holds its ids, the exact vectors and, beside them, the file of approximations: for
every component the number of a cell, a few bits wide, and where the cells of each dimension begin and how wide they are.  A scan of
the cells gives each vector a score that is off by at most a known error; of the exact vectors a search reads only those whose upper
bound can still matter, in the order of these bounds, until none is above the k-th exact score.  Query vectors go to the tasks
in blocks of bounded size, so what is sent does not grow with their number; each task keeps k results per query over all the
lots it reads.

Vectors with components so large that a score might leave 64 bits are kept apart: their bounds come from extended floating
point and their exact scores from whole numbers of any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import written

BITS = 5
#: Query vectors in one pass over the lots, and queries and vectors that are compared at a time.
QUERY_BLOCK, QUERY_TILE, VECTOR_TILE = 16_384, 256, 8_192
#: Bytes of a block of queries, and of a lot's exact vectors, whatever the width of the vectors is.
QUERY_BYTES, LOT_BYTES = 64 << 20, 4 << 20
_LONG = (1 << 63) - 1


def _matrix(column: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """Rows of numbers, shorter ones filled with 0, longer ones cut."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), kind)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, fits = np.repeat(np.arange(len(sizes)), sizes), place < width
    out[row[fits], place[fits]] = flat[fits]
    return out


class ApproximationFile:
    """Cells of a lot of vectors: per dimension, equal cells between its smallest and largest value.

    Cells that were written before are taken as they are.
    """

    def __init__(self, vectors: np.ndarray, bits: int = BITS, cells: np.ndarray | None = None, low: np.ndarray | None = None,
                 width: np.ndarray | None = None):
        self.vectors = vectors
        if cells is None:
            low, high = vectors.min(axis=0), vectors.max(axis=0)
            width = -(-(high - low + 1) // (1 << bits))  # whole numbers, so a cell of width 1 is exact
            cells = ((vectors - low) // width).astype(cell_kind(bits))
        self.cells, self.low, self.size = cells, low, width
        self._cells = cells.T.astype(np.float32)
        self._top = int(cells.max(initial=0))
        self.middle = (low + (width - 1) / 2).astype(np.float64)
        self.width = width.astype(np.float64)
        self.reach = (width - 1) / 2  # from the middle of a cell to its ends

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Approximate scores (queries x vectors) and the largest error of each query's."""
        scaled = (queries * self.width).astype(np.float32)
        scores = scaled @ self._cells + (queries @ self.middle)[:, None].astype(np.float32)
        size = np.abs(scaled).sum(axis=1) * self._top + np.abs(queries @ self.middle)
        return scores, np.abs(queries) @ self.reach + 1e-6 * size * queries.shape[1] + 1  # and what rounding can add

    def exact(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact scores of some of the vectors."""
        return self.vectors[rows].astype(np.int64) @ query


def cell_kind(bits: int) -> type:
    return np.uint16 if bits > 8 else np.uint8


def search_lot(file: ApproximationFile, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int,
               floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the k best (scores, ids) of the lot that reach ``floor``, ties to smaller ids."""
    out = []
    scores, error = file.bounds(queries)
    n = scores.shape[1]
    for q in range(len(queries)):
        mine = ids == own[q] if own[q] >= ids[0] and own[q] <= ids[-1] else None
        row = scores[q]
        if mine is not None and mine.any():
            row = np.where(mine, -np.inf, row)
        kth = np.partition(row, n - k)[n - k] if n > k else -np.inf
        # A vector whose upper bound is below the k-th lower bound, or below the floor, cannot be among the best.
        near = np.flatnonzero(row >= max(kth - 2 * error[q], floor[q] - error[q]))
        near = near[np.isfinite(row[near])]
        near = near[np.argsort(-row[near], kind="stable")]
        exact, seen = np.zeros(0, np.int64), 0
        step = 4 * k
        while seen < len(near):  # read exact vectors by falling bound until the k-th result is certain
            take = near[seen:seen + step]
            exact = np.append(exact, file.exact(take, queries[q]))
            seen += len(take)
            if seen < len(near) and len(exact) >= k and np.partition(exact, len(exact) - k)[len(exact) - k] > row[near[seen]] + error[q]:
                break
            step *= 2
        near = near[:seen]
        best = np.lexsort((ids[near], -exact))[:k]
        out.append((exact[best], ids[near][best]))
    return out


def search_large(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of vectors of whole numbers of any size, ties to smaller ids."""
    near = np.flatnonzero(ids != own)
    x, q = vectors[near].astype(np.longdouble), query.astype(np.longdouble)
    score, error = x @ q, np.finfo(np.longdouble).eps * (len(q) + 2) * (np.abs(x) @ np.abs(q)) + 1
    if len(near) > k:
        near = near[score + error >= np.sort(score - error)[-k]]
    whole = [int(c) for c in query]
    found = ((sum(int(c) * w for c, w in zip(vectors[i], whole)), int(ids[i])) for i in near)
    return sorted(found, key=lambda f: (-f[0], f[1]))[:k]


def _order(score: int) -> str:
    """Text that sorts as the score falls, however many digits it has."""
    digits = str(abs(score))
    if score <= 0:
        return f"1{len(digits):05d}{digits}"
    return f"0{99999 - len(digits):05d}" + "".join(str(9 - int(c)) for c in digits)


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", values: str = "embedding",
                       scale: int = 64, bits: int = BITS) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` highest inner products of floor(scale * x), ties to the smaller id.

    Vectors that are null, that hold a null or a number that is not finite (or that the scale makes so), or whose id is null
    take no part.  A vector with the id of the query is the query's own.  Repeated rows count each.  Shorter vectors end in
    zeros; an empty vector scores 0.  Of several queries with one id the smallest vector counts.  Fewer than ``k`` others
    give all of them; an empty table gives no rows; other columns are not read.  A score beyond 64 bits is ranked exactly and
    shown as the nearest number of 64 bits.
    """
    def whole(rows: DataFrame) -> DataFrame:
        fine = F.forall(F.col(values), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) != float("inf")))
        floor = F.transform(values, lambda x: F.when(F.abs(x.cast("double") * scale) < 2.0**53, F.floor(x.cast("double") * scale).cast("double")).otherwise(
            x.cast("double") * scale))  # beyond 2**53 all doubles are whole
        return rows.where(F.col(key).isNotNull() & F.col(values).isNotNull()).where(fine).select(F.col(key).cast("long").alias("id"), floor.alias("v"))

    exact = written(whole(vectors))
    asked = written(whole(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(1 << 30))))
    width = max(exact.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    n_queries = asked.count()
    limit = isqrt((1 << 62) // width)  # components up to here keep scores within 64 bits
    large = F.exists(F.slice("v", 1, width), lambda x: F.abs(x) > limit)
    lots = written(exact.where(~large).mapInArrow(_lots(width, bits), "ids binary, cells binary, low binary, size binary, vectors binary, bytes int"))
    apart = exact.where(large)
    some_apart = not apart.isEmpty() or not asked.where(large).isEmpty()
    found = None
    n_blocks = max(1, -(-n_queries // max(1, min(QUERY_BLOCK, QUERY_BYTES // (8 * width)))))
    schema = "query_id long, vec_id long, score long, less " + ("string" if some_apart else "long")
    for b in range(n_blocks):  # as many passes as there are blocks of queries
        share = (1 << 30) / n_blocks
        mine = asked.where((F.col("block") >= int(b * share)) & (F.col("block") < int((b + 1) * share)))
        for of_large in (False, True) if some_apart else (False,):
            block = mine.where(large == of_large).select("id", "v").toArrow().combine_chunks()
            if not block.num_rows:
                continue
            own = block["id"].combine_chunks().to_numpy()
            matrix = _matrix(block["v"].combine_chunks(), width)
            if of_large:
                lot = exact.mapInArrow(_large_searcher(own, matrix, k), schema)
            else:
                lot = lots.mapInArrow(_searcher(own, matrix.astype(np.int64), k, bits, some_apart), schema)
                if some_apart:
                    lot = lot.unionByName(apart.mapInArrow(_large_searcher(own, matrix, k), schema))
            found = lot if found is None else found.unionByName(lot)
    if found is None:
        return exact.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
    first = F.struct("less", "vec_id", "score")  # highest score, then smallest id
    parts = found.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("lot")).agg(
        F.slice(F.sort_array(F.collect_list(first)), 1, k).alias("best"))
    best = parts.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.score")


def _lots(width: int, bits: int):
    """Write lots: ids in order, cells with their beginnings and widths, exact vectors in as few bytes as they fit in."""
    rows = max(1, min(VECTOR_TILE, LOT_BYTES // (8 * width)))

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = part.column("id").to_numpy()
                order = np.argsort(ids, kind="stable")
                file = ApproximationFile(_matrix(part.column("v"), width)[order].astype(np.int64), bits)
                n_bytes = next(n for n in (1, 2, 4, 8) if np.abs(file.vectors).max(initial=0) < 1 << (8 * n - 1))
                packed = [ids[order], file.cells, file.low, file.size, file.vectors.astype(f"i{n_bytes}")]
                yield pa.RecordBatch.from_arrays([*[pa.array([x.tobytes()], pa.binary()) for x in packed], pa.array([n_bytes], pa.int32())],
                                                 names=["ids", "cells", "low", "size", "vectors", "bytes"])

    return lots


def _searcher(own: np.ndarray, queries: np.ndarray, k: int, bits: int, as_text: bool):
    width = queries.shape[1]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = [np.zeros(0, np.int64)] * len(own)
        ids = [np.zeros(0, np.int64)] * len(own)
        floor = np.full(len(own), -np.inf)
        for batch in batches:
            for row in range(batch.num_rows):
                read = lambda c, kind: np.frombuffer(batch.column(c)[row].as_buffer(), kind)  # noqa: B023, E731
                names = read("ids", np.int64)
                lot = ApproximationFile(read("vectors", f"i{batch.column('bytes')[row].as_py()}").reshape(-1, width), bits,
                                        read("cells", cell_kind(bits)).reshape(-1, width), read("low", np.int64), read("size", np.int64))
                for q in range(0, len(own), QUERY_TILE):
                    tile = slice(q, q + QUERY_TILE)
                    for i, (s, n) in enumerate(search_lot(lot, names, queries[tile], own[tile], k, floor[tile]), q):
                        if len(s):
                            s, n = np.append(scores[i], s), np.append(ids[i], n)
                            best = np.lexsort((n, -s))[:k]
                            scores[i], ids[i] = s[best], n[best]
                            if len(best) == k:
                                floor[i] = scores[i][-1]
        sizes = [len(s) for s in scores]
        for a in range(0, len(own), 4096):
            score = np.concatenate(scores[a:a + 4096])
            less = pa.array([_order(s) for s in score.tolist()], pa.string()) if as_text else pa.array(-score, pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(own[a:a + 4096], sizes[a:a + 4096]), pa.int64()),
                pa.array(np.concatenate(ids[a:a + 4096]), pa.int64()), pa.array(score, pa.int64()), less],
                names=["query_id", "vec_id", "score", "less"])

    return search


def _large_searcher(own: np.ndarray, queries: np.ndarray, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in own]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, x = part.column("id").to_numpy(), _matrix(part.column("v"), queries.shape[1])
                for i, query in enumerate(queries):
                    best[i] = sorted(best[i] + search_large(x, ids, query, own[i], k), key=lambda f: (-f[0], f[1]))[:k]
        for q, found in zip(own.tolist(), best):
            if found:
                yield pa.RecordBatch.from_arrays([
                    pa.array([q] * len(found), pa.int64()), pa.array([i for _, i in found], pa.int64()),
                    pa.array([max(-_LONG - 1, min(_LONG, s)) for s, _ in found], pa.int64()), pa.array([_order(s) for s, _ in found], pa.string())],
                    names=["query_id", "vec_id", "score", "less"])

    return search
