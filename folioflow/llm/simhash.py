"""SimHash near-duplicate classes by pivot distance tables.

1. Every document gets a 64-bit fingerprint of its word shingles.
2. Exact equality first: one row per distinct fingerprint, so thousands of copies cost one row.
3. Every distinct fingerprint gets a row of a distance table: Hamming distances to the zero
   reference, to 32 references with two adjacent bits set, and to nine dense ones. Distances are
   1-Lipschitz, so a pair within the radius differs by at most the radius in every coordinate.
4. The distance to a two-bit reference, less the distance to zero, changes only when one of
   its two bits changes. The 32 differences fall into six bands; two changed bits touch at most
   two bands, so a pair within radius 2 has equal differences in some four. Those fifteen sets of
   four are the join keys: pairs that differ in every one of them are discarded unformed and
   no pair within the radius is lost. Independent fingerprints share a key of 21 differences about once
   in 10^9 pairs, so keys stay small as the corpus grows.
5. Pairs that meet under a key are discarded by the largest coordinate difference over the
   dense references, and the survivors are verified by Hamming distance.
6. Only families of like fingerprints make a key large. Under one of more than `crowd`, crowd^2 pairs
   would meet. Its members are joined exactly another way: two fingerprints lie within 2 bits iff some
   fingerprint is within 1 bit of both, so each member posts itself and its 64 neighbours and links to the
   smallest poster of each: 65 rows a member and no pairs.
7. Components over the links between fingerprints, then back to documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._runtime import ship_package, written
from .components import connected_components

RADIUS = 2
SHINGLE = 3
CROWD = 64
_GOLDEN = 0x9E3779B97F4A7C15


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Two adjacent bits each: reference g has bits 2g and 2g + 1.
PAIR_REFERENCES = [signed(3 << (2 * g)) for g in range(32)]
#: Dense references: fixed words drawn from one hash family. Their distances take seven bits each of one long.
DENSE_REFERENCES = [signed(xxhash.xxh64_intdigest(k.to_bytes(8, "little"), _GOLDEN)) for k in range(9)]
#: The bands of two-bit references, and how many of them a key takes.
BANDS = [PAIR_REFERENCES[32 * b // 6 : 32 * (b + 1) // 6] for b in range(6)]
KEPT = len(BANDS) - RADIUS


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of UTF-8 bytes: A-Z lower-cased, words between ASCII white space, shingles with
    repeats joined by one space, XXH64 with seed 42; a bit is set if more than half have it."""
    words = data.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest, m = xxhash.xxh64_intdigest, n - shingle + 1
    return majority(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:m].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, m))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; none of no hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprint as a signed long; null text counts as empty."""

    @arrow_udf("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([signed(fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle)) for x in batch], pa.int64())

    return run(text.cast("binary"))


def pivot_table(prints: DataFrame) -> DataFrame:
    """(fp, near, keys) of each fp: `near` holds its distances to the dense references, `keys` what its
    distances to the zero and the two-bit references give."""
    fp = F.col("fp")
    near = sum((F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(r))).cast("long"), 7 * k) for k, r in enumerate(DENSE_REFERENCES)), F.lit(0).cast("long"))
    wide = prints.select("fp", near.alias("near"), *[_band(fp, references).alias(f"band{b}") for b, references in enumerate(BANDS)])
    keys = []
    for number, kept in enumerate(combinations(range(len(BANDS)), KEPT)):
        key = F.lit(number).cast("long")
        for b in kept:
            key = key * 4 ** len(BANDS[b]) + F.col(f"band{b}")
        keys.append(key)
    return wide.select("fp", "near", F.array(*keys).alias("keys"))


def _band(fp: Column, references: list[int]) -> Column:
    """Differences of distances, d(x, 0) - d(x, reference), which are -2, 0 or 2, as digits to base 4."""
    zero, out = F.bit_count(fp), F.lit(0).cast("long")
    for r in references:
        out = out * 4 + ((zero - F.bit_count(fp.bitwiseXOR(F.lit(r))) + 2) / 2).cast("long")
    return out


def _far(x: Column, y: Column) -> Column:
    """Largest difference of two rows' distances to the dense references."""
    at = lambda c, k: F.shiftright(c, 7 * k).bitwiseAND(F.lit(127))
    return F.greatest(*[F.abs(at(x, k) - at(y, k)) for k in range(len(DENSE_REFERENCES))])


def met_pairs(posted: DataFrame) -> DataFrame:
    """Pairs of fingerprints that meet under a key (once for each), and whether each stage lets them pass:
    (a, b, near, same). posted: fp, near, key."""
    x, y = posted.alias("x"), posted.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")))
    near = _far(F.col("x.near"), F.col("y.near")) <= RADIUS
    same = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS
    return met.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"), near.alias("near"), same.alias("same"))


def shared(table: DataFrame) -> DataFrame:
    """The postings (fp, near, key, size) of a distance table under keys that several fingerprints share."""
    posted = table.select("fp", "near", F.explode("keys").alias("key"))
    sizes = posted.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return posted.join(sizes, "key").select("fp", "near", "key", "size")


def links(table: DataFrame, crowd: int) -> DataFrame:
    """Links (a, b) between fingerprints within RADIUS bits."""
    met = written(shared(table), "postings")
    pairs = met_pairs(met.where(F.col("size") <= crowd)).where("near and same").select("a", "b")
    crowded = met.where(F.col("size") > crowd).select("fp").distinct()
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    posts = crowded.select("fp", F.explode(F.concat(F.array("fp"), bits)).alias("mid"))
    least = posts.groupBy("mid").agg(F.min("fp").alias("b"))
    stars = posts.join(least, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionAll(stars)


def report(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """One row on how far pairs get: fingerprints, met (pairs under a key, once for each key), passed (not
    discarded by the dense references), verified, and crowded (fingerprints under a key of over `crowd`)."""
    ship_package(docs.sparkSession)
    table = written(pivot_table(docs.select(fingerprint_column(F.col(text_col), shingle).alias("fp")).distinct()), "pivots")
    met = shared(table)
    pairs = met_pairs(met.where(F.col("size") <= crowd)).agg(F.count("*").alias("met"), F.count_if("near").alias("passed"), F.count_if(F.col("near") & F.col("same")).alias("verified"))
    crowded = met.where(F.col("size") > crowd).agg(F.count_distinct("fp").alias("crowded"))
    return table.agg(F.count("*").alias("fingerprints")).join(F.broadcast(pairs)).join(F.broadcast(crowded))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """One row per input row: (id, fp, component_id), component_id the smallest id reachable
    over links of at most two differing bits.

    Null or blank texts have fingerprint zero and link like any other; fewer words than a
    shingle count as one; repeated rows and equal texts share a class; a row without id links like
    any other and gets its class's id, which comes from the members that have one (null if there are none). An empty
    table gives an empty table. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    prints = written(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), shingle).alias("fp")), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("rep"))
    table = written(pivot_table(distinct.select("fp")), "pivots")
    groups = connected_components(links(table, crowd), "links")
    # only linked fingerprints take another id than their own smallest
    linked = distinct.join(groups, F.col("fp") == F.col("node")).select("fp", "component", "rep")
    named = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    moved = linked.join(named, "component").select("fp", "component_id")
    classes = distinct.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return prints.join(classes, "fp", "left").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Filter: of each component of near copies (five words, similarity 0.8 or more: `copies`) one
    row stays. Fingerprints of five-word shingles within RADIUS bits are found by the pivot tables and
    compared by their whole sets; what lies further apart, or is not alike in spite of it, `copies` finds by shingles."""
    from . import copies

    return copies.keep_one(docs, id_col, text_col)
