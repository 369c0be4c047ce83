"""Search by an inverted index of trigrams, so that a query reads posting lists instead of all texts.

    rows      (slot, row, folded, doc): every row, its columns in one, with its folded text, by slot
    postings  (bucket, gram, n, rows): the rows of a block of texts that hold a trigram, by bucket of the trigram and sorted by it within

A segment is one such pair of Parquet tables; adding rows adds a segment, and the manifest (sources.snapshots) lists those that count,
so readers see a segment whole or not at all. Rows are dealt out evenly first, however few splits their source has. Lists are made where the
texts are read, a block of texts at a time, and are not shuffled, so a trigram has one list for each block. A search folds its terms, takes
the rarest trigrams of the long ones, reads their posting lists alone (partitions by bucket, pages by trigram), keeps rows that are in all of
them and then tests those rows' folded texts for the terms themselves, so a trigram can only save work. Trigrams in more than `FEW` rows of a
segment save none, as the texts of most blocks are read with them or without: their lists are not read. Terms under three characters have no
trigram. If no trigram is left, the folded texts are scanned.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold
from ..sources.snapshots import Snapshots
from .shipping import shipped

#: Buckets of trigrams; a query reads those of its trigrams.
BUCKETS = 16
#: Posting lists read for a term at most: the rarest. More would leave out few rows that the test of the text does not.
PROBES = 3
#: Rows of a segment with a trigram beyond which its lists are not read; the candidates of a search, never more, are sent to all tasks.
FEW = 100_000
#: Characters of texts whose lists are made at a time in a task; longer texts are cut, with two characters in common.
BLOCK = 8_000_000
LISTS = "bucket int, gram string, n bigint, rows array<bigint>"


def bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def posting_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, folded as binary) to the posting lists of each block."""
    rows, texts, size = [], [], 0
    for batch in batches:
        for row, raw in zip(batch["row"].to_pylist(), batch["folded"].to_pylist(), strict=True):
            text = raw.decode("utf-8", "replace")
            for at in range(0, len(text) - 2, BLOCK):
                piece = text[at : at + BLOCK + 2]
                if size + len(piece) > BLOCK and rows:
                    yield from _block(rows, texts)
                    rows, texts, size = [], [], 0
                rows.append(row)
                texts.append(piece)
                size += len(piece)
    if rows:
        yield from _block(rows, texts)


def _block(rows: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    seen = np.zeros(0x110000, bool)
    seen[chars] = True
    used = np.flatnonzero(seen).astype(np.uint32)
    base, many = len(used), len(texts)
    if base**3 * many >= 2**63:  # a trigram and its text would not fit a number; those of one text always do
        half = many // 2
        yield from _block(rows[:half], texts[:half])
        yield from _block(rows[half:], texts[half:])
        return
    code = (np.cumsum(seen) - 1)[chars]
    of = np.repeat(np.arange(many), [len(t) for t in texts])
    pairs = (((code[:-2] * base + code[1:-1]) * base + code[2:]) * many + of[:-2])[of[:-2] == of[2:]]
    pairs.sort()
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]
    gram, text = np.divmod(pairs, many)
    first = np.flatnonzero(np.diff(gram, prepend=-1))
    found = gram[first]
    joined = used[np.stack([found // base**2, found // base % base, found % base], axis=1)].tobytes().decode("utf-32-le")
    names = [joined[k : k + 3] for k in range(0, len(joined), 3)]
    ends = np.append(first, len(pairs))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(rows, np.int64)[text]))
    columns = [pa.array([bucket(g) for g in names], pa.int32()), pa.array(names, pa.string()), pa.array(np.diff(ends), pa.int64()), lists]
    yield pa.RecordBatch.from_arrays(columns, ["bucket", "gram", "n", "rows"])


def buckets_of(some: list[str]) -> list[int]:
    """The buckets of a query's trigrams, without a job."""
    return sorted({bucket(g) for g in some})


def terms_of(spark: SparkSession, query: str) -> list[str]:
    """The folded terms of a query."""
    folded = spark.sql("select 1").select(fold(F.lit(query))).first()[0]
    return [t for t in folded.split(" ") if t]


class SearchIndex:
    """The index of a table over some text fields, under a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.segments = Snapshots(spark, f"{self.path}/segments")

    def add(self, docs: DataFrame, *fields: str) -> int:
        """Index more rows; null fields count as empty. The version that has them."""
        key = uuid.uuid4().hex
        dealt = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("dealt")).repartition("dealt")
        folded = reduce(lambda a, b: F.concat(a, F.lit("\n"), b), [F.coalesce(fold(F.col("doc")[f]), F.lit("")) for f in fields])
        own = dealt.select("doc", folded.alias("folded"), F.monotonically_increasing_id().alias("row"))
        rows = own.withColumn("slot", F.shiftright("row", 33).cast("int"))
        rows.write.mode("error").partitionBy("slot").parquet(f"{self.path}/rows/{key}")
        texts = shipped(self._rows(key, rows).select("row", F.col("folded").cast("binary").alias("folded")))
        lists = texts.mapInArrow(posting_lists, LISTS).sortWithinPartitions("bucket", "gram")
        lists.write.mode("error").partitionBy("bucket").parquet(f"{self.path}/postings/{key}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return self.segments.append(self.spark.createDataFrame([(key, schema)], "key string, schema string"))

    def _rows(self, key: str, like: DataFrame | None = None, schema: str | None = None) -> DataFrame:
        return self.spark.read.schema(schema if like is None else like.schema).parquet(f"{self.path}/rows/{key}")

    def _postings(self, key: str) -> DataFrame:
        """The lists of a segment, a few for a trigram; a text that was cut may be in two of them."""
        return self.spark.read.schema("gram string, n bigint, rows array<bigint>, bucket int").parquet(f"{self.path}/postings/{key}")

    def _listed(self, key: str, some: list[str]) -> DataFrame:
        return self._postings(key).where(F.col("bucket").isin(buckets_of(some)) & F.col("gram").isin(some))

    def _counts(self, key: str, wanted: list[str]) -> dict[str, int]:
        """How many rows of a segment hold each of a query's trigrams; those that none holds are absent."""
        return {r.gram: r.n for r in self._listed(key, wanted).groupBy("gram").agg(F.sum("n").alias("n")).collect()}

    def _probes(self, key: str, terms: list[str]) -> list[str] | None:
        """The rarest trigrams of every term that has any, without those in too many rows; None if a trigram of a term is in no row."""
        of = {t: sorted({t[i : i + 3] for i in range(len(t) - 2)}) for t in terms}
        counts = self._counts(key, sorted({g for some in of.values() for g in some}))
        if any(g not in counts for some in of.values() for g in some):
            return None
        return sorted({g for some in of.values() for g in sorted(some, key=lambda g: (counts[g], g))[:PROBES] if counts[g] <= FEW})

    def candidates(self, key: str, probes: list[str]) -> DataFrame:
        """(slot, row) of the rows that are in the posting lists of all probes."""
        lists = self._listed(key, probes).select("gram", F.explode("rows").alias("row"))
        met = lists.groupBy("row").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(probes))
        return met.select("row", F.shiftright("row", 33).cast("int").alias("slot"))

    def search(self, query: str, version: int | None = None) -> DataFrame:
        """The indexed rows, in their own columns, of which every folded term of the query is a substring; a blank query has them all."""
        listed = self.segments.read(version)
        if listed is None:
            raise ValueError(f"nothing is indexed at {self.path}")
        terms, parts = terms_of(self.spark, query), []
        long = [t for t in terms if len(t) >= 3]
        for segment in listed.orderBy("key").collect():
            rows = self._rows(segment.key, schema=segment.schema)
            probes = self._probes(segment.key, long) if long else []
            if probes is None:
                rows = rows.where(F.lit(False))
            elif probes:
                rows = rows.join(F.broadcast(self.candidates(segment.key, probes)), ["slot", "row"], "left_semi")
            for term in terms:
                rows = rows.where(F.contains("folded", F.lit(term)))
            parts.append(rows.select("doc.*"))
        return reduce(lambda a, b: a.unionByName(b), parts)
