"""A sink of one text file for each document, with a commit protocol.

    path/_staged/<job>/<task>/<name>.txt    while a task writes
    path/part-00000/<name>.txt              once the job has committed: one rename for each task
    path/_SUCCESS                           behind the last rename

Memory of a task is a batch, whatever its number of files: rows come sorted by name, so that equal names meet, and are read back `BATCH_BYTES` at a time.
A failed task's folder is named by no commit message and goes with the job's staged folder; a failed job leaves nothing. Only a task's
number and folder pass the driver, never names or texts. Names are made unique by Spark before anything is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.chars import utf16_clip
from ..functions.text import sanitize
from ..operators.shipping import shipped

FORMAT = "folio_texts"
#: UTF-16 units of a name that gets a mark; with it, it stays under 255 bytes.
MARKED = 60
#: Bytes of text, and files, after which a reader gives a batch away.
BATCH_BYTES, BATCH_FILES = 1 << 22, 1000


def name_of(title: Column) -> Column:
    return sanitize(F.coalesce(title, F.lit("")))


def named(docs: DataFrame, title: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(name, text) for each document: its sanitised title, and behind it the id in brackets where other documents share the name
    (letter case does not tell names apart) or the name itself ends in brackets, so that no marked name meets a plain one. Documents that
    share the id as well are numbered. Null titles are empty, null texts too."""
    base = docs.select(name_of(F.col(title)).alias("plain"), F.coalesce(F.col(id_col).cast("string"), F.lit("none")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumn("low", F.lower("plain"))
    shared = base.groupBy("low").agg((F.count("*") > 1).alias("shared"))
    same = W.partitionBy("low", "id")
    k = F.row_number().over(same.orderBy("text")) - 1
    rows = base.withColumn("k", k).join(shared, "low")
    mark = F.concat(F.lit(" ("), sanitize(F.col("id")), F.when(F.col("k") > 0, F.concat(F.lit("-"), F.col("k").cast("string"))).otherwise(""), F.lit(")"))
    needed = F.col("shared") | F.col("plain").rlike(r" \([^()]*\)\z")
    return rows.select(F.when(needed, F.concat(utf16_clip(F.col("plain"), MARKED), mark)).otherwise(F.col("plain")).alias("name"), "text")


def _files(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class TaskFiles(WriterCommitMessage):
    task: int
    folder: str
    files: int


class TextWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, root = _files(self.path)
        folder, before, n = f"{root}/_staged/{self.job}/{uuid.uuid4().hex}", None, 0
        store.create_dir(folder, recursive=True)
        for batch in iterator:
            for name, text in zip(batch["name"], batch["text"], strict=True):
                name = name.as_py()
                if name == before:
                    raise ValueError(f"two documents are named {name!r}")
                before, n = name, n + 1
                with store.open_output_stream(f"{folder}/{name}.txt") as out:
                    if text.is_valid:
                        out.write(text.as_buffer())
        context = TaskContext.get()
        return TaskFiles(context.partitionId() if context else 0, folder, n)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        store, root = _files(self.path)
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.task):
            if m.files:
                store.move(m.folder, f"{root}/part-{m.task:05d}")
        self._drop(store, root)
        with store.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        self._drop(*_files(self.path))

    def _drop(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/_staged/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_staged/{self.job}")
        if store.get_file_info(f"{root}/_staged").type != fs.FileType.NotFound and not store.get_file_info(fs.FileSelector(f"{root}/_staged")):
            store.delete_dir(f"{root}/_staged")


class TextReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _files(self.path)
        if store.get_file_info(f"{root}/_SUCCESS").type == fs.FileType.NotFound:
            raise ValueError(f"no job has finished at {self.path}")
        return [InputPartition(i.base_name) for i in store.get_file_info(fs.FileSelector(root)) if i.base_name.startswith("part-")]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        store, root = _files(self.path)
        names, texts, held = [], [], 0
        for info in store.get_file_info(fs.FileSelector(f"{root}/{partition.value}")):
            with store.open_input_stream(info.path) as file:
                texts.append(file.read())
            names.append(info.base_name.removesuffix(".txt"))
            held += len(texts[-1])
            if held >= BATCH_BYTES or len(names) >= BATCH_FILES:
                yield _batch(pa, names, texts)
                names, texts, held = [], [], 0
        if names:
            yield _batch(pa, names, texts)


def _batch(pa, names: list[str], texts: list[bytes]):
    columns = [pa.array(names, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["name", "text"])


class TextFiles(DataSource):
    """Rows (name, text) as files; only a path without a finished job is written to, and only a finished one read."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, text string"

    def reader(self, schema) -> DataSourceReader:
        return TextReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        from pyarrow import fs

        path = self.options["path"]
        store, root = _files(path)
        if overwrite or store.get_file_info(f"{root.rstrip('/')}/_SUCCESS").type != fs.FileType.NotFound:
            raise ValueError(f"{path} holds the files of a finished job; they are not overwritten")
        return TextWriter(path)


def write(rows: DataFrame, path: str) -> None:
    """Rows (name, text), names unique, as path/part-…/<name>.txt."""
    rows.sparkSession.dataSource.register(TextFiles)
    shipped(rows).select("name", "text").sortWithinPartitions("name").write.format(FORMAT).mode("append").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of what write() left, empty texts included, one task for each folder; an error while no job has finished."""
    spark.dataSource.register(TextFiles)
    return shipped(spark.read.format(FORMAT).load(path))
