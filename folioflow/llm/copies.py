"""Near copies by SimHash and exact Jaccard similarity of five-word shingles, without comparing all pairs.

1. Every text becomes its set of shingle hashes; texts of equal sets share a key and count once. A set has a SimHash fingerprint.
   Fingerprints within `simhash.RADIUS` bits are found by pivot distance tables, discarded and verified there (`simhash.links`), and
   their sets compared. What that links is one component. Copies of similarity `THRESHOLD` may lie further apart
   (some 10 bits are to be expected at 0.8), so an exact way for the rest follows, between texts of different components only:
2. Shingles have one global order: those that a sample shows to be common come last, the rest go
   by hash. Two sets of similarity `THRESHOLD` or more share a shingle among the first
   n - ceil(THRESHOLD n) + 1 of each, whatever the order, so only those are posted and no such
   pair is lost. The order decides the cost alone.
3. From the first shingle on that two near copies share, each has all that they share. Posted shingles that no other text (or none
   of another component) posts are not among them. Pairs whose sizes, counts of shared postings and what is left from there on cannot
   reach the threshold end there, and texts that cannot reach it with any other are not paired at all.
4. Groups are linked by few comparisons first: a text meets the `LEADERS` of the most crowded shingle it posts, then, under
   shingles whose texts are of several components, leaders that are of another component; every turn has other leaders, and turns go on
   while each halves the postings under shingles of over `crowd` texts, so all of them together cost no more than twice the first. What that links is one component already, so what remains
   are pairs from different components; members of a group are not compared with each other.
   These meet by shingle only where their parities allow it: a set has one bit for each of 512 ranges of the hash, whether an odd number of its
   shingles fall there. A shingle of one set alone turns one bit, so as many bits as differ, so many shingles at least are not shared.
5. Candidates are compared by sketches, how many of a set's shingles fall to each of `BUCKETS` ranges of the hash: two sets share
   at most the sum of the lesser counts. Those that this leaves are decided by their whole sets.
   Links go by key, so ids that are null or clash do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import simhash
from ._runtime import discard_since, release, ship_package, tables, written
from .components import connected_components
from .decontaminate import shingle_hashes, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
CROWD, LEADERS = 64, 3
#: One text of SAMPLE is read for common shingles; at most COMMON of them are sorted last.
SAMPLE, COMMON = 64, 100_000
#: Ids sent to every task at most; more are joined by a shuffle.
SMALL = 1_000_000
BUCKETS = 256
#: Longs of a parity; a power of two.
PARITY = 8
_NONE = np.zeros(0, np.uint64)


def shingle_set(data: bytes) -> np.ndarray:
    """Distinct shingle hashes of UTF-8 bytes, sorted: A-Z lower-cased, words between ASCII white
    space; fewer words than a shingle are one, no words are the empty set."""
    words = data.lower().split()
    return np.unique(shingle_hashes(word_hashes(words), min(SHINGLE, len(words)))) if words else _NONE


def key_of(codes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(codes.tobytes(), 42) - (1 << 63)


def posted(codes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, in the global order, of which any near copy shares one."""
    n = len(codes)
    if not n:
        return codes
    first = n - (4 * n + 4) // 5 + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, codes), len(common) - 1)
        codes = codes[np.lexsort((codes, np.where(common[at] == codes, counts[at], 0)))]
    return codes[:first]


def _bytes(x) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([_NONE, *parts]).view(np.int64)))


def sketch_of(codes: np.ndarray) -> np.ndarray:
    return np.bincount((codes >> np.uint64(56)).astype(np.int64), minlength=BUCKETS).astype(np.int32)


def parity_of(codes: np.ndarray) -> np.ndarray:
    """PARITY longs: for each range of the hash whether an odd number of codes fall there."""
    bits = 64 * PARITY
    counts = np.bincount((codes >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def set_column(text: Column) -> Column:
    """(key, shingles) of a text; null text counts as empty."""

    @arrow_udf("struct<key:bigint,shingles:array<bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = [shingle_set(_bytes(x)) for x in batch]
            yield pa.StructArray.from_arrays([pa.array(map(key_of, sets), pa.int64()), _lists(sets)], ["key", "shingles"])

    return run(text.cast("binary"))


def posting_column(text: Column, common: np.ndarray, counts: np.ndarray) -> Column:
    """(key, n, fp, first, sketch, parity): key, size and fingerprint of a text's shingle set, what is posted of it, its sketch and its parity."""

    def lists(parts: list[np.ndarray], size: int, kind: type) -> pa.Array:
        flat = pa.array(np.concatenate([np.zeros(0, kind), *parts]))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size, dtype=np.int32)), flat)

    @arrow_udf("struct<key:bigint,n:int,fp:bigint,first:array<bigint>,sketch:array<int>,parity:array<bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            keys, sizes, fps, parts, sketches, parities = [], [], [], [], [], []
            for x in batch:
                codes = shingle_set(_bytes(x))
                keys.append(key_of(codes))
                sizes.append(len(codes))
                fps.append(simhash.signed(simhash.majority(codes)))
                parts.append(posted(codes, common, counts).copy())
                sketches.append(sketch_of(codes))
                parities.append(parity_of(codes))
            made = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), _lists(parts), lists(sketches, BUCKETS, np.int32), lists(parities, PARITY, np.int64)]
            yield pa.StructArray.from_arrays(made, ["key", "n", "fp", "first", "sketch", "parity"])

    return run(text.cast("binary"))


def common_shingles(texts: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several texts of the sample, sorted, and their counts."""
    drawn = texts.where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0).select(F.explode(set_column(F.col("text"))["shingles"]).alias("sh"))
    rows = drawn.groupBy("sh").agg(F.count("*").alias("k")).where("k > 1").orderBy(F.desc("k"), "sh").limit(COMMON).collect()
    pairs = sorted((r.sh % (1 << 64), r.k) for r in rows)
    return np.array([s for s, _ in pairs], np.uint64), np.array([k for _, k in pairs], np.int64)


def _alike(x: str, y: str) -> Column:
    """Whether the sizes of two sets allow the threshold."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _reach(x: str, y: str) -> Column:
    """Whether two sets may share enough if the shingle they meet under is the first that they share."""
    return 9 * F.least(F.col(f"{x}.most"), F.col(f"{y}.most")) >= 4 * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def _close(x: str, y: str) -> Column:
    """Whether the parities of two sets allow the threshold: at most a ninth of n + n is not shared."""
    turned = sum((F.bit_count(F.col(f"{x}.p{k}").bitwiseXOR(F.col(f"{y}.p{k}"))) for k in range(PARITY)), F.lit(0))
    return 9 * turned <= F.col(f"{x}.n") + F.col(f"{y}.n")


def _meet(side: DataFrame) -> DataFrame:
    """Rows x and y of different components under one shingle whose sizes and parities allow the threshold."""
    x, y = side.alias("x"), side.alias("y")
    return x.join(y, (F.col("x.sh") == F.col("y.sh")) & (F.col("x.c") < F.col("y.c")) & _alike("x", "y") & _close("x", "y"))


def _counted(few: DataFrame, many: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components `c` that meet under shingles of few texts and, by how many they are, may reach
    the threshold: 9 shared >= 4 (n + n). Shingles of many texts, under which they do not meet here, count as shared."""
    unmet = many.groupBy("key").agg(F.count("*").alias("unmet"))
    side = few.join(unmet, "key", "left").withColumn("unmet", F.coalesce("unmet", F.lit(0)))
    met = _meet(side)
    n, m = F.col("x.n"), F.col("y.n")
    rows = met.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"), (n + m).alias("both"), (F.ceil(F.greatest(n, m) * 4 / F.lit(5)) - 1).cast("int").alias("unposted"), F.least("x.unmet", "y.unmet").alias("unmet"), _reach("x", "y").alias("reach"))
    pairs = rows.groupBy("a", "b").agg(F.count("*").alias("k"), F.first("both").alias("both"), F.first("unposted").alias("unposted"), F.first("unmet").alias("unmet"), F.max("reach").alias("reach"))
    fits = 9 * (F.col("k") + F.col("unmet") + F.col("unposted")) >= 4 * F.col("both")
    return pairs.where(fits & F.col("reach")).select("a", "b")


def _met(rows: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """rows joined to distinct values of a column; few values are sent to the rows."""
    return rows.join(F.broadcast(ids) if ids.count() <= SMALL else ids, column, how)


def _verified(pairs: DataFrame, prints: DataFrame, docs: DataFrame, named: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose sets reach the threshold. Pairs that sketches rule out need no whole sets."""
    pairs = written(pairs.distinct(), "pairs")
    keys = lambda: pairs.select(F.col("a").alias("key")).unionAll(pairs.select(F.col("b").alias("key"))).distinct()
    sketches = _met(prints.select("key", "n", "sketch"), keys(), "key", "left_semi").dropDuplicates(["key"])
    x, y = (sketches.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")
    most = F.aggregate(F.zip_with("sa", "sb", lambda p, q: F.least(p, q)), F.lit(0), lambda total, k: total + k)
    pairs = written(pairs.join(x, "a").join(y, "b").where(9 * most >= 4 * (F.col("na") + F.col("nb"))).select("a", "b"), "candidates")
    of = written(keys().join(named, "key").select("key", "id"), "named")
    texts = _met(docs.where("id is not null"), of.where("id is not null").select("id").distinct(), "id", "left_semi")
    if of.where("id is null").head(1):
        texts = texts.unionAll(docs.where("id is null"))
    sets = written(texts.select(set_column(F.col("text")).alias("s")).select("s.*"), "sets")
    if sets.count() > of.count():  # ids clash, or rows are repeated
        sets = sets.join(of.select("key"), "key", "left_semi").dropDuplicates(["key"])
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    return both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def _linked(links: DataFrame | None, pairs: DataFrame, prints: DataFrame, docs: DataFrame, named: DataFrame) -> DataFrame:
    """links and the pairs that reach the threshold, as a table; what led to it is deleted."""
    mark = tables()
    found = _verified(pairs, prints, docs, named)
    out = written(found if links is None else links.unionAll(found), "near")
    discard_since(mark, out)
    release(out.sparkSession)
    return out


def by_fingerprint(prints: DataFrame, crowd: int = simhash.CROWD) -> DataFrame:
    """Pairs (a, b) of keys whose fingerprints lie within simhash.RADIUS bits, found by the pivot distance tables: the least keys of either
    fingerprint, and under one fingerprint its least key and each other."""
    keys = prints.select("fp", "key").distinct()
    least = written(keys.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("keys")), "leasts")
    same = keys.join(least.where("keys > 1"), "fp").where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    near = simhash.links(written(simhash.pivot_table(least.select("fp")), "pivots"), crowd)
    x, y = (least.select(F.col("fp").alias(k), F.col("least").alias(f"k{k}")) for k in "ab")
    met = near.join(x, "a").join(y, "b").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    return same.unionAll(met)


def _led(rows: DataFrame, members: DataFrame, turn: int = 0) -> DataFrame:
    """Pairs (a, b) of each member (key, sh, c) and those leaders of its shingle in rows that are of another component. Every turn
    has other leaders."""
    of = F.struct("key", "c")
    leaders = rows.groupBy("sh").agg(F.array_distinct(F.array(*[F.min_by(of, F.xxhash64("key", F.lit(k))) for k in range(turn * LEADERS, (turn + 1) * LEADERS)])).alias("leaders"))
    met = members.join(leaders, "sh").select("key", "c", F.explode("leaders").alias("l")).where("c <> l.c")
    return met.select(F.least("key", "l.key").alias("a"), F.greatest("key", "l.key").alias("b"))


def _apart(met: DataFrame, groups: DataFrame) -> DataFrame:
    """Postings under shingles whose texts are of several components, with the component as c, the number of texts as size, and
    as most what a text can share with one of another component from this shingle on: its other posted shingles are its
    component's alone. Texts that cannot share THRESHOLD of their set that way have no near copy elsewhere and go."""
    of = groups.select(F.col("node").alias("key"), F.col("component").alias("c"))
    rows = met.select("key", "n", "pos", "sh").join(of, "key", "left").withColumn("c", F.coalesce("c", "key"))
    mixed = rows.groupBy("sh").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("sh", "size")
    text = Window.partitionBy("key")
    shared = rows.join(mixed, "sh").withColumn("all", F.expr("n - (n div 5 + 1)") + F.count("*").over(text))
    rows = shared.where(5 * F.col("all") >= 4 * F.col("n")).withColumn("most", F.col("all") - F.row_number().over(text.orderBy("pos")) + 1)
    return written(rows.drop("all"), "apart")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: (id, key, component), component the smallest key reachable over
    links of similarity THRESHOLD or more. Null and blank texts share a key."""
    ship_package(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = written(read.select(F.monotonically_increasing_id().alias("row"), "id", posting_column(F.col("text"), *common_shingles(read, sample)).alias("p")).select("row", "id", "p.*"), "prints")
    named = prints.groupBy("key").agg(F.min("id").alias("id"), F.min("row").alias("row"))
    again = written(prints.select("row").join(named.select("row"), "row", "left_anti"), "again")
    postings = _met(prints, again, "row", "left_anti").select("key", "n", F.posexplode("first").alias("pos", "sh"))
    # counted and joined, not windowed: counts are combined in the map tasks, and a join's hot shingle can be split
    sizes = postings.groupBy("sh").agg(F.count("*").alias("size")).where("size > 1")
    met = written(postings.join(sizes, "sh"), "postings")
    mark = tables()
    links = _linked(None, by_fingerprint(prints), prints, read, named)
    discard_since(mark, links)
    groups = connected_components(links, "links")
    apart = _apart(met, groups)
    heavy = apart.groupBy("key", "c").agg(F.max_by("sh", F.struct("size", "sh")).alias("sh"))
    links = _linked(links, _led(apart, heavy), prints, read, named)
    groups = connected_components(links, "links")
    apart = _apart(apart, groups)
    crowded = lambda: apart.where(F.col("size") > crowd)
    some, turn, before, now = apart, 0, None, crowded().count()
    while some.head(1) and (before is None or 2 * now <= before):
        links = _linked(links, _led(some, some, turn), prints, read, named)
        groups = connected_components(links, "links")
        apart = _apart(apart, groups)
        some, turn, before, now = crowded(), turn + 1, now, crowded().count()
    if apart.head(1):
        bits = prints.select("key", *[F.col("parity")[k].alias(f"p{k}") for k in range(PARITY)])
        apart = written(apart.join(_met(bits, apart.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]), "key"), "parities")
        many = crowded()
        first = many.where(5 * F.col("most") >= 4 * F.col("n"))
        rest = _meet(first).where(_reach("x", "y")).select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"))
        pairs = _counted(apart.where(F.col("size") <= crowd), many).unionAll(rest)
        groups = connected_components(_linked(links, pairs, prints, read, named), "links")
    return prints.select("id", "key").join(groups.withColumnRenamed("node", "key"), "key", "left").select("id", "key", F.coalesce("component", "key").alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, sample: int = SAMPLE) -> DataFrame:
    """Filter: of each component of near copies one row stays, the one with the smallest id (rows
    without id come last; of rows of equal id and equal shingles the least by its columns)."""
    mark = tables()
    classes = written(near_copies(docs, id_col, text_col, crowd, sample), "classes")
    discard_since(mark, classes)
    winners = classes.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key")).alias("w")).select("w.id", "w.key")
    # ids of one row go by id alone; null and clashing ids need the key
    sizes = classes.where("id is not null").groupBy("id").agg(F.count("*").alias("rows"))
    several = written(sizes.where("rows > 1").select("id"), "several")
    lost = written(sizes.where("rows = 1").select("id").join(winners.select("id"), "id", "left_anti").unionAll(several), "lost")
    named = docs.where(F.col(id_col).isNotNull())
    kept = named.join(F.broadcast(lost) if lost.count() <= SMALL else lost, named[id_col] == lost["id"], "left_anti")
    unclear = docs.where(F.col(id_col).isNull())
    if several.head(1):
        unclear = unclear.unionByName(named.join(several, named[id_col] == several["id"], "left_semi"))
    elif not unclear.head(1):
        return kept
    fields = [c for c, t in docs.dtypes if "map<" not in t]  # maps have no order
    marked = unclear.select(*[F.struct(*[F.col(f"`{c}`") for c in some]).alias(n) for n, some in (("_row", docs.columns), ("_order", fields))], F.col(id_col).alias("_id"), set_column(F.col(text_col))["key"].alias("_key"))
    met = marked.join(winners, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_key") == F.col("key")))
    return kept.unionByName(met.groupBy("_id", "_key").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*"))
