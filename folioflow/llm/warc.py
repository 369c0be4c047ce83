"""WARC fixity: Merkle trees over record archives, compared and descended by mismatch.

An archive is an ordered run of records. Every record is hashed; `FANOUT` neighbours make a node
whose digest covers the digests of its children and the offset range of each within it, and so on up to the
archive's root. Two replicas are compared from the roots: only children of nodes that differ are read
on the next level, so a sound archive costs one comparison and a damaged record one path.
Ranges count from their node's start, so a record that changes length alters its own path and no others.

Leaves that differ are told apart by the records' keys: a record that only stands in another place (behind an inserted or
a lost one) is sound; one of equal key and another digest is changed; the rest are missing or extra.

Everything is DataFrame functions. An archive is cut into parts of about `PART` records, so neither rows without id nor many rows
of one id meet in one task. A group is at most FANOUT children; levels are written to
the shared folder once and the descent joins each with the mismatches above it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._runtime import ship_package, written

FANOUT = 32
#: Records of an archive: id ranges of this length share one. Records of a part, about, in archives that hold more.
SPAN, PART = 1024, 8192
UNIT = ["archive", "part"]


def warc_record(url: Column, body: Column) -> Column:
    """A WARC/1.1 resource record as bytes: header, blank line, body, two line ends."""
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body.cast("binary"), F.lit("\r\n\r\n").cast("binary"))


def archives(pages: DataFrame, span: int = SPAN, parts: DataFrame | None = None) -> DataFrame:
    """Records (archive, part, seq, page_id, key, offset, length, digest) of a page table. An archive holds an id
    range, its records in the order of id, url and html; null html is an empty body; rows without id
    make up archive null. Repeated rows are records of their own. parts: how many parts each large archive has
    (`parts_of`), dealt out by address; without it each archive is one part."""
    body = F.coalesce(F.col("html"), F.lit(""))
    record = warc_record(F.col("url"), body)
    rows = pages.select(F.floor(F.col("page_id") / span).cast("bigint").alias("archive"), "page_id", "url", F.octet_length(record).cast("bigint").alias("length"), F.sha2(record, 256).alias("digest"))
    if parts is None:
        rows = rows.withColumn("part", F.lit(0))
    else:
        large = parts.select(F.col("archive").alias("_archive"), "parts")
        met = rows.join(large, F.col("archive").eqNullSafe(F.col("_archive")), "left")
        rows = met.withColumn("part", F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("parts")).cast("int"), F.lit(0))).drop("_archive", "parts")
    order = W.partitionBy(*UNIT).orderBy("page_id", "url", "digest")
    seq = F.row_number().over(order).cast("bigint") - 1
    offset = F.sum("length").over(order.rowsBetween(W.unboundedPreceding, -1))
    return rows.select(*UNIT, seq.alias("seq"), "page_id", F.col("page_id").cast("string").alias("key"), F.coalesce(offset, F.lit(0)).alias("offset"), "length", "digest")


def parts_of(pages: DataFrame, span: int = SPAN, most: int = PART) -> DataFrame:
    """(archive, parts) of the archives of over `most` records: only repeated ids and rows without id make
    one larger than its id range, so there are at most rows / most of them."""
    sizes = pages.groupBy(F.floor(F.col("page_id") / span).cast("bigint").alias("archive")).agg(F.count("*").alias("n"))
    return sizes.where(F.col("n") > max(span, most)).select("archive", F.ceil(F.col("n") / most).alias("parts"))


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The next level: nodes (archive, part, seq, length, digest) in runs of `fanout`. A digest covers each
    child's digest and where its range ends within the node."""
    children = F.array_sort(F.collect_list(F.struct("seq", "length", "digest")))
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit("").alias("text"))

    def along(state: Column, child: Column) -> Column:
        end = state["end"] + child["length"]
        return F.struct(end.alias("end"), F.concat(state["text"], child["digest"], F.lit(":"), end.cast("string"), F.lit(",")).alias("text"))

    runs = nodes.groupBy(*UNIT, F.floor(F.col("seq") / fanout).cast("bigint").alias("parent")).agg(F.aggregate(children, start, along).alias("whole"))
    return runs.select(*UNIT, F.col("parent").alias("seq"), F.col("whole.end").alias("length"), F.sha2(F.col("whole.text").cast("binary"), 256).alias("digest"))


def tree(records: DataFrame, fanout: int = FANOUT, name: str = "merkle") -> list[DataFrame]:
    """Levels from the records, themselves a written table, up to one root per part of an archive."""
    levels = [records.select(*UNIT, "seq", "length", "digest")]
    most = levels[0].agg(F.max("seq")).first()[0]
    while most:
        levels.append(written(parents(levels[-1], fanout), f"{name}{len(levels)}"))
        most //= fanout
    return levels


def _same_unit(x: str, y: str) -> Column:
    return F.col(f"{x}.archive").eqNullSafe(F.col(f"{y}.archive")) & (F.col(f"{x}.part") == F.col(f"{y}.part"))


def compare(ours: DataFrame, theirs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Places (archive, part, seq) whose leaves differ between two replicas, found from the roots down.
    Empty replicas give an empty result."""
    a, b = tree(ours, fanout, "ours"), tree(theirs, fanout, "theirs")
    # trees of unequal height: the lower one is continued by its own roots
    while len(a) < len(b):
        a.append(written(parents(a[-1], fanout), f"ours{len(a)}"))
    while len(b) < len(a):
        b.append(written(parents(b[-1], fanout), f"theirs{len(b)}"))
    wrong = None
    for x, y in zip(reversed(a), reversed(b), strict=True):
        if wrong is not None:
            above = wrong.alias("w")
            x, y = (t.alias("t").join(above, _same_unit("t", "w") & (F.floor(F.col("t.seq") / fanout) == F.col("w.seq")), "left_semi") for t in (x, y))
        p, q = x.alias("p"), y.alias("q")
        met = p.join(q, _same_unit("p", "q") & (F.col("p.seq") == F.col("q.seq")), "full_outer").where(~F.col("p.digest").eqNullSafe(F.col("q.digest")))
        archive = F.when(F.col("p.seq").isNotNull(), F.col("p.archive")).otherwise(F.col("q.archive"))
        wrong = met.select(archive.alias("archive"), F.coalesce("p.part", "q.part").alias("part"), F.coalesce("p.seq", "q.seq").alias("seq"))
    return wrong


def _paired(ours: DataFrame, theirs: DataFrame, by: list[str], how: str) -> DataFrame:
    """Records of two replicas side by side, the nth of equal values with the nth."""
    nth = F.row_number().over(W.partitionBy(*UNIT, *by).orderBy("seq"))
    p, q = ours.withColumn("nth", nth).alias("p"), theirs.withColumn("nth", nth).alias("q")
    same = _same_unit("p", "q") & (F.col("p.nth") == F.col("q.nth"))
    for c in by:
        same &= F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}"))
    return p.join(q, same, how)


def faults(wrong: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """What is wrong at the places that differ: archive, part, seq, fault ("changed", "missing" from theirs, or "extra" in
    theirs), page_id, offset and length of the record, as we hold it, or as the replica does where only it has one.
    Records without key are told apart by their digests alone, and what is left of them by their order."""
    at = written(wrong, "wrong")
    x, y = (t.alias("t").join(at.alias("w"), _same_unit("t", "w") & (F.col("t.seq") == F.col("w.seq")), "left_semi") for t in (ours, theirs))
    x, y = written(x, "ours-wrong"), written(y, "theirs-wrong")
    sound = _paired(x, y, ["key", "digest"], "inner").select(*[F.col(f"p.{c}").alias(c) for c in UNIT], F.col("p.seq").alias("ours"), F.col("q.seq").alias("theirs"))
    sound = written(sound, "moved")
    left = [t.alias("t").join(sound.alias("s"), _same_unit("t", "s") & (F.col("t.seq") == F.col(f"s.{side}")), "left_anti") for t, side in ((x, "ours"), (y, "theirs"))]
    met = _paired(*left, ["key"], "full_outer")
    mine = F.col("p.seq").isNotNull()
    fault = F.when(F.col("q.seq").isNull(), "missing").when(~mine, "extra").otherwise("changed")
    return met.select(*[F.when(mine, F.col(f"p.{c}")).otherwise(F.col(f"q.{c}")).alias(c) for c in (*UNIT, "seq")], fault.alias("fault"), *[F.when(mine, F.col(f"p.{c}")).otherwise(F.col(f"q.{c}")).alias(c) for c in ("page_id", "offset", "length")])


def audit(pages: DataFrame, replica: DataFrame, span: int = SPAN, fanout: int = FANOUT, most: int = PART) -> DataFrame:
    """Corruption located in a replica of a page table: archive, part, seq, fault, page_id, offset and length
    of the damaged record. Empty tables give what the other one holds, or nothing."""
    parts = written(parts_of(pages, span, most), "parts")
    ours, theirs = (written(archives(t, span, parts), "records") for t in (pages, replica))
    return faults(compare(ours, theirs, fanout), ours, theirs)


def audit_files(spark, ours: str | list[str], theirs: str | list[str], fanout: int = FANOUT) -> DataFrame:
    """The same for WARC files of two folders, files of equal names against each other."""
    x, y = (written(read_records(spark, paths).withColumn("archive", F.regexp_extract("archive", "[^/]*$", 0)), "records") for paths in (ours, theirs))
    return faults(compare(x, y, fanout), x, y)


def _members(data: bytes) -> Iterator[tuple[int, int, bytes, str | None]]:
    """(offset, length, content, error) of the gzip members of a file, or of the file itself."""
    if data[:2] != b"\x1f\x8b":
        yield 0, len(data), data, None
        return
    at = 0
    while at < len(data):
        reader, error = zlib.decompressobj(31), None
        try:
            content = reader.decompress(data[at:])
        except zlib.error:
            content, error = b"", "gzip member is damaged"
        rest = len(reader.unused_data) if reader.eof else 0
        if not reader.eof and error is None:
            error = "gzip member is cut off"
        if error:  # go on behind the next sign of a member
            again = data.find(b"\x1f\x8b\x08", at + 1)
            rest = len(data) - again if again >= 0 else 0
        yield at, len(data) - rest - at, content, error
        at = len(data) - rest


def _records(data: bytes) -> Iterator[tuple[int, int, str | None, str | None]]:
    """(offset, length, key, error) of the records of uncompressed content. What cannot be read as one, up to where the
    next record begins, is a row with an error."""
    at = 0
    while at < len(data):
        end, key, size, error = data.find(b"\r\n\r\n", at), None, None, None
        if not data.startswith(b"WARC/", at) or end < 0:
            error = "no record header"
        else:
            for line in data[at:end].split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                name, value = name.strip().lower(), value.strip()
                if name == b"content-length" and value.isdigit():
                    size = int(value)
                elif name == b"warc-record-id" or (name == b"warc-target-uri" and key is None):
                    key = value.decode("utf-8", "replace")
            error = "no content length" if size is None else "record is cut off" if end + 4 + size > len(data) else None
        if error:
            stop = data.find(b"\r\n\r\nWARC/", at + 1)
            stop = len(data) if stop < 0 else stop + 4
        else:
            stop = min(len(data), end + 4 + size + 4)
        yield at, stop - at, key, error
        at = stop


def read_records(spark, paths: str | list[str]) -> DataFrame:
    """Records of WARC files, plain or of gzip members: archive (the path), part, seq, page_id (null), key (record id, else
    target address), offset, length, digest, error; one row per record. A damaged header, length or member gives a row with an error
    and reading goes on behind it. In gzip files offset and length are those of the record's member. Files are read by Spark as
    bytes, one file at a time, so one must be under 2 GB."""
    ship_package(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows: list[tuple] = []
                for begin, size, data, damage in _members(content.as_buffer().to_pybytes()):
                    packed = size != len(data)
                    if damage:
                        rows.append((path.as_py(), len(rows), None, begin, size, hashlib.sha256(data).hexdigest(), damage))
                        continue
                    for at, length, key, error in _records(data):
                        place = (begin, size) if packed else (begin + at, length)
                        rows.append((path.as_py(), len(rows), key, *place, hashlib.sha256(data[at : at + length]).hexdigest(), error))
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["archive", "seq", "key", "offset", "length", "digest", "error"])

    found = spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(cut, "archive string, seq bigint, key string, offset bigint, length bigint, digest string, error string")
    return found.select("archive", F.lit(0).alias("part"), "seq", F.lit(None).cast("bigint").alias("page_id"), "key", "offset", "length", "digest", "error")
