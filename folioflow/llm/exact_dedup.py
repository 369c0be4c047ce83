"""Exact duplicates: rows grouped by a 128-bit content hash, bytes compared inside the groups.

1. Every text gets its hash. Grouping by (hash, text) compares bytes, but only of texts that fall into one hash group; copies meet in
   the map tasks first, so a text with a third of all rows leaves each of them once.
2. The groups are then counted by hash. A hash that holds one text alone, which is all of them unless the hash collides, stands for that
   text, so rows find their group by the hash and no text moves a second time. Rows of a hash that holds several texts find theirs by
   hash and text.
3. The join that brings a group back to its rows has one row a group on one side, so adaptive execution can split the rows of a hot
   hash over as many tasks as their size asks for.

All of it is DataFrame functions; nothing leaves the JVM.

Defined cases: null text counts as empty; ids may be null (a null id is kept only in a group without any other) or repeat (equal rows
agree in all columns, also in `kept`; keep_one() returns one of them); an empty table stays empty; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import written


def content_hash(text: Column) -> Column:
    """128 bits of a text's UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def _hashed(docs: DataFrame, id_col: str, text_col: str, hashed: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), hashed(text).alias("hash"))


def groups_of(rows: DataFrame, keep: Callable[[Column], Column] = F.min) -> tuple[DataFrame, DataFrame]:
    """From rows (id, text, hash): the groups (hash, n, keep) of hashes that hold one text, and those (hash, text, n, keep) of
    hashes that hold several."""
    texts = rows.groupBy("hash", "text").agg(F.count("*").alias("n"), keep("id").alias("keep"))
    # of a hash with one text first() is that text's group; the text itself is looked at no more
    by_hash = texts.groupBy("hash").agg(F.count("*").alias("texts"), F.first("n").alias("n"), F.first("keep").alias("keep"))
    by_hash = written(by_hash, "hashes")
    collided = by_hash.where("texts > 1")
    apart = None
    if collided.head(1):
        apart = rows.join(collided.select("hash"), "hash", "left_semi").groupBy("hash", "text").agg(F.count("*").alias("n"), keep("id").alias("keep"))
    return by_hash.where("texts = 1").select("hash", "n", "keep"), apart


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Callable[[Column], Column] = F.min, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row of docs: (id, keep_id, group_size, kept, text_sha256). Of equal texts the row with the smallest id stays;
    keep=F.max keeps the largest. `hashed` is the grouping hash; a bad one costs time, never a result."""
    rows = _hashed(docs, id_col, text_col, hashed)
    single, apart = groups_of(rows, keep)
    sha = F.unhex(F.sha2("text", 256))
    found = rows.select("id", "hash", sha.alias("sha")).join(single, "hash")
    if apart is not None:
        found = found.unionByName(rows.join(apart, ["hash", "text"]).select("hash", "id", sha.alias("sha"), "n", "keep"))
    return found.select("id", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Callable[[Column], Column] = F.min, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Filter with the columns of docs: one row of every text, the one whose id is kept; of rows that share text and id the one
    that is least by its columns in their order (map columns, which have no order, do not count)."""
    fields = [c for c, t in docs.dtypes if "map<" not in t]
    single, apart = groups_of(_hashed(docs, id_col, text_col, hashed), keep)
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.struct(*[F.col(f"`{c}`") for c in fields]).alias("_order"), F.col(id_col).alias("_id"), text.alias("_text"), hashed(text).alias("hash"))
    same = F.col("_id").eqNullSafe(F.col("keep"))
    stay = marked.join(single, "hash").where(same).groupBy("hash").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")
    if apart is not None:
        met = marked.join(apart, (marked["hash"] == apart["hash"]) & (marked["_text"] == apart["text"])).where(same)
        stay = stay.unionByName(met.groupBy(marked["hash"], "_text").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*"))
    return stay
