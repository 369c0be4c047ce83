"""Document store semantics over a change log and over stored JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.chars import trim

# How many documents the front page lists, and the known sources.
RECENT = 5
SOURCES = ["camera", "gallery", "pdf", "unknown"]
SCHEMA = "array<struct<id string, title string, text string, createdAt string, updatedAt string, source string>>"


def replay(log: DataFrame) -> DataFrame:
    """State after a log (id, seq, at, op "save" or "delete", title, text, source): one row per live document.

    The first save of an id, and the first after its deletion, make a new document: created_at and
    source stay from then, title, text and updated_at come from the last save. A document's key is
    its id and generation, the number of deletions before.
    """
    order = W.partitionBy("id").orderBy("seq")
    gone = F.coalesce(F.sum(F.when(F.col("op") == "delete", 1)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = log.withColumn("generation", gone).groupBy("id", "generation").agg(
        F.bool_or(F.col("op") == "delete").alias("deleted"),
        F.min_by(F.struct("at", "source"), F.when(F.col("op") == "save", F.col("seq"))).alias("first"),
        F.max_by(F.struct("at", "title", "text"), F.when(F.col("op") == "save", F.col("seq"))).alias("last"),
    )
    return runs.where("not deleted and first is not null").select("id", "generation", "last.title", "last.text", F.col("first.at").alias("created_at"), F.col("last.at").alias("updated_at"), "first.source")


def since_truncate(log: DataFrame) -> DataFrame:
    """The log behind its last "delete_all" in the order of (at, seq), so of entries of one instant those with a greater
    seq stay (one row, joined to every other)."""
    last = log.where("op = 'delete_all'").agg(F.max(F.struct("at", "seq")).alias("_from"))
    behind = F.col("_from").isNull() | (F.struct("at", "seq") > F.col("_from"))
    return log.join(F.broadcast(last)).where(behind & (F.col("op") != "delete_all")).drop("_from")


def in_order(docs: DataFrame, *tie: str) -> DataFrame:
    return docs.orderBy(F.desc("updated_at"), *tie)


def recent(docs: DataFrame, *tie: str, n: int = RECENT) -> DataFrame:
    return in_order(docs, *tie).limit(n)


def find(docs: DataFrame, id_col: str, value) -> DataFrame:
    return docs.where(F.col(id_col) == value)


def parse(json: Column) -> Column:
    """Stored documents as an array of structs: an object's `documents`, or a bare list; unreadable
    text gives an empty list."""
    wrapped = F.from_json(json, f"struct<documents: {SCHEMA}>")["documents"]
    bare = F.when(F.ltrim(json).startswith("["), F.from_json(json, SCHEMA))
    return F.coalesce(bare, wrapped, F.from_json(F.lit("[]"), SCHEMA))


def unreadable(stored: DataFrame, json: str) -> DataFrame:
    """The rows to set aside: stored text that is no JSON, or neither an object nor a list. load() takes them as empty
    stores, so they are to be kept before anything is written over them; null is no store at all."""
    shape = F.schema_of_variant(F.try_parse_json(json))
    return stored.where(F.col(json).isNotNull() & ~F.coalesce(shape.startswith("ARRAY") | shape.startswith("OBJECT"), F.lit(False)))


def load(stored: DataFrame, json: str, now: Column) -> DataFrame:
    """Rows of stored JSON with the tolerant defaults; rows without an id are skipped."""
    rows = stored.select(*[c for c in stored.columns if c != json], F.explode(parse(F.col(json))).alias("d"))
    created = F.coalesce(F.try_to_timestamp("d.createdAt"), now)
    source = F.when(F.col("d.source").isin(SOURCES), F.col("d.source")).otherwise("unknown")
    return rows.where("d.id is not null and d.id <> ''").select(*[c for c in rows.columns if c != "d"], "d.id", F.coalesce("d.title", F.lit("")).alias("title"), F.coalesce("d.text", F.lit("")).alias("text"), created.alias("created_at"), F.coalesce(F.try_to_timestamp("d.updatedAt"), created).alias("updated_at"), source.alias("source"))


def dump(docs: DataFrame, key: str) -> DataFrame:
    """One JSON text per key: version 1 with the documents, latest first."""
    row = F.struct("id", "title", "text", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("createdAt"), F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("updatedAt"), "source")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("o"), F.col("id").alias("i"), row.alias("row")))), lambda x: x["row"])
    return docs.groupBy(key).agg(F.to_json(F.struct(F.lit(1).alias("version"), ordered.alias("documents"))).alias("json"))


def is_dirty(saved: Column, text: Column) -> Column:
    """Unsaved changes: a saved text that differs, or an unsaved one that is not blank."""
    return F.when(saved.isNotNull(), saved != text).otherwise(trim(text) != "")


def title_for_files(saved: Column, suggested: Column, stamp: Column, app: str = "Folio") -> Column:
    """First title that is not blank, else the application's name with a time stamp."""
    pick = lambda t: F.when(trim(t) != "", trim(t))
    return F.coalesce(pick(saved), pick(suggested), F.concat(F.lit(f"{app}_"), stamp))
