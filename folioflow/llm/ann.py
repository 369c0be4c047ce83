"""Approximate nearest neighbours by a permutation index.

1. The index is fitted on `PIVOTS` vectors, the first by a hash of their id. Every row is
   represented by its `PREFIX` nearest pivots in order, and this index is written once.
2. A task posts a shard of rows in the inverted files of their pivots, each with its place in the
   row's order. A query reads the files of its own nearest pivots only; with a place of PREFIX for
   pivots a row does not list, the footrule distance of two prefixes is a constant less twice the sum,
   over the pivots they share, of PREFIX - max(place, place), so one pass over the files gives it.
3. Candidates are the rows within the query's footrule cutoff. It is the distance that the query's
   nearest `CANDIDATES` * sqrt(rows) rows have, read off a bounded sample of the index (`SAMPLE` rows,
   the first by a hash of the id; there at least the nearest `LEAST`). One cutoff holds for all rows, so what is
   found does not depend on partitions or shards.
4. Candidates are reranked by exact cosine in double precision.

Queries are a stated set: they go to the tasks in blocks of at most 2 * `BLOCK` vectors, and each block
meets all rows of the index in one scan. A task holds one shard of `SHARD` rows at a time and
keeps the best k of each query over its shards. Recall against brute force is in the README.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._runtime import ship_package, written

PIVOTS, PREFIX, SHARD, BLOCK = 512, 64, 8192, 4096
#: Candidates for each square root of the number of rows; rows of the sample that gives the cutoffs, and its candidates at least.
CANDIDATES, SAMPLE, LEAST = 10.0, 8192, 32
RESULT = "query_id bigint, vec_id bigint, score double"


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not zero, every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, which changes no cosine and keeps squares in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each row's nearest pivots by cosine, nearest first, ties to the earlier pivot."""
    return np.argsort(-(unit(x) @ pivots.T).round(12), axis=1, kind="stable")[:, :prefix].astype(np.int16)


class Shard:
    """Index rows in inverted files: for each pivot the rows that list it and its place there."""

    def __init__(self, listed: np.ndarray, n_pivots: int) -> None:
        self.size, self.prefix = listed.shape
        flat = listed.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.rows, self.places = np.divmod(by_pivot, max(1, self.prefix))
        self.starts = np.searchsorted(flat[by_pivot], np.arange(n_pivots + 1))

    def shared(self, listed: np.ndarray) -> np.ndarray:
        """What the footrule of each row to a query's order falls short of the largest, halved."""
        out = np.zeros(self.size, np.int32)
        for place, pivot in enumerate(listed.tolist()):
            a, b = self.starts[pivot], self.starts[pivot + 1]
            out[self.rows[a:b]] += self.prefix - np.maximum(self.places[a:b], place)
        return out


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x to y, in double precision."""
    return np.clip((x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum())), -1.0, 1.0)


def cutoffs(sample: np.ndarray, queries: np.ndarray, n_pivots: int, n_rows: int, candidates: float) -> np.ndarray:
    """For each query order the least shared() of a candidate."""
    shard, n = Shard(sample, n_pivots), len(sample)
    rank = min(n, max(LEAST, int(np.ceil(candidates * np.sqrt(n_rows) * n / n_rows))))
    return np.array([np.partition(shard.shared(q), n - rank)[n - rank] for q in queries], np.int32)


def _rows(batch: pa.RecordBatch, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(1)
    fits = np.diff(lists.offsets.to_numpy()) == dimension
    if not fits.all():
        batch = batch.filter(pa.array(fits))
        lists = batch.column(1)
    return batch.column(0).to_numpy().astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _ordered(pivots: np.ndarray, prefix: int):
    """Rows with a vector of the index's length, and their pivots in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                ids, x = _rows(batch.slice(at, SHARD), pivots.shape[1])
                if len(ids):
                    listed = orders(scaled(x), pivots, prefix)
                    lists = [pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]) for v in (x, listed)]
                    kinds = (pa.list_(pa.float64()), pa.list_(pa.int16()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), *(v.cast(k) for v, k in zip(lists, kinds, strict=True))], ["vec_id", "embedding", "listed"])

    return run


def _search(query_ids: np.ndarray, queries: np.ndarray, listed: np.ndarray, least: np.ndarray, n_pivots: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(query_ids)
        held: list[pa.RecordBatch] = []

        def index() -> None:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            ids, x = _rows(table, queries.shape[1])
            x = scaled(x)
            shard = Shard(table.column(2).flatten().to_numpy().reshape(len(ids), -1), n_pivots)
            for q, (i, v) in enumerate(zip(query_ids.tolist(), queries, strict=True)):
                near = np.flatnonzero(shard.shared(listed[q]) >= least[q])
                near = near[ids[near] != i]
                if len(near):
                    found, score = np.concatenate([best[q][0], ids[near]]), np.concatenate([best[q][1], cosines(x[near], v)])
                    top = np.lexsort((found, -score))[:k]
                    best[q] = found[top], score[top]

        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                held.append(batch.slice(at, SHARD))
                if sum(b.num_rows for b in held) >= SHARD:
                    index()
        if sum(b.num_rows for b in held):
            index()
        sizes = [len(i) for i, _ in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, sizes)), pa.array(np.concatenate([i for i, _ in best])), pa.array(np.concatenate([s for _, s in best]))], ["query_id", "vec_id", "score"])

    return run


def _pivots(vectors: DataFrame, pivots: int) -> np.ndarray:
    """At most `pivots` distinct vectors of the commonest length, the first by a hash of the id."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * pivots).collect()
    if not sample:
        return np.zeros((0, 0))
    sizes = [len(r[1]) for r in sample]
    size = max(sorted(set(sizes)), key=sizes.count)
    distinct = list(dict.fromkeys(tuple(map(float, r[1])) for r in sample if len(r[1]) == size))
    return unit(scaled(np.array(distinct[:pivots])))


def build_index(vectors: DataFrame, table: np.ndarray, prefix: int = PREFIX) -> DataFrame:
    """The written index: vec_id, embedding and `listed`, the row's nearest pivots in order."""
    return written(vectors.mapInArrow(_ordered(table, prefix), "vec_id bigint, embedding array<double>, listed array<smallint>"), "permutations")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS, prefix: int = PREFIX, candidates: float = CANDIDATES, block: int = BLOCK) -> DataFrame:
    """The k nearest found rows of each query: query_id, rank from 1, vec_id, score (cosine).

    Both tables have vec_id and embedding. Rows without id, with a vector that is null or zero
    or holds null or non-finite components, or of another length than most, take no part. Rows with the query's
    id are its own and no candidates. A query id that repeats asks once, with its least vector;
    repeated index rows count each. Ties go to the smaller id; with fewer candidates than k all
    are returned; without index rows or queries the result is empty.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    read = lambda df: df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    table = _pivots(read(vectors), pivots)
    found = None
    if len(table):
        index = build_index(read(vectors), table, prefix)
        n_rows = index.count()
        sample = index.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").select("listed").limit(SAMPLE).collect()
        sample = np.array([r[0] for r in sample], np.int16)
        asked = read(queries).where(F.size("embedding") == table.shape[1]).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        parts = -(-asked.count() // block)
        todo = [(parts, p) for p in range(parts)]
        while todo:
            of, p = todo.pop()
            rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(of)) == p).limit(2 * block + 1).collect()
            if len(rows) > 2 * block:  # an uneven block is cut in two, so no more than its bound is ever sent
                todo += [(2 * of, p), (2 * of, p + of)]
            elif rows:
                rows.sort(key=lambda r: r[0])
                ids, data = np.array([r[0] for r in rows], np.int64), scaled(np.array([r[1] for r in rows], np.float64))
                listed = orders(data, table, prefix)
                part = index.mapInArrow(_search(ids, data, listed, cutoffs(sample, listed, len(table), n_rows, candidates), len(table), k), RESULT)
                found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], RESULT)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
