"""One file in the order of a table's rows, written by all tasks.

Rows become lines in Spark. Each task of the data source writes its partition's lines as a part of its own; the commit
joins the parts of the tasks that count, in order, by reads of ``BLOCK`` bytes. So a table of any size has one file that a
person opens, without one task or a driver that holds the table. Repeated or lost tasks leave parts that nobody joins.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

BLOCK = 8 << 20


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    size: int


class OrderedText(DataSource):
    """Options: ``path`` (a folder that gets the file ``file``), ``parts`` (a folder for the parts), ``header``."""

    @classmethod
    def name(cls) -> str:
        return "ordered_text"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return OrderedWriter(dict(self.options))


class OrderedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.parts, self.file, self.header = (options[k] for k in ("path", "parts", "file", "header"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        number = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(self.parts)
        fs.create_dir(root, recursive=True)
        part, size = f"{root}/{number}-{uuid.uuid4().hex}", 0
        with fs.open_output_stream(part) as out:
            for batch in iterator:
                for line in batch.column(0):
                    out.write(raw := ((line.as_py() or "") + "\n").encode("utf-8", "replace"))
                    size += len(raw)
        return Part(number, part, size)

    def commit(self, messages: list[Part | None]) -> None:
        fs, to = pafs.FileSystem.from_uri(self.path)
        _, root = pafs.FileSystem.from_uri(self.parts)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(whole := f"{root}/whole") as out:
            if self.header:
                out.write((self.header + "\n").encode())
            for m in sorted((m for m in messages if m), key=lambda m: m.number):
                with fs.open_input_file(m.path) as part:
                    for at in range(0, m.size, BLOCK):
                        out.write(part.read_at(min(BLOCK, m.size - at), at))
        if fs.get_file_info(to).type != pafs.FileType.NotFound:
            fs.delete_dir(to)  # as late as this, so the rows may come from what is replaced
        fs.create_dir(to, recursive=True)
        fs.move(whole, f"{to}/{self.file}")
        fs.delete_dir(root)

    def abort(self, messages: list[Part | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.parts)
        if fs.get_file_info(root).type != pafs.FileType.NotFound:
            fs.delete_dir(root)


def _qualified(spark: SparkSession, path: str) -> str:
    """The absolute path that tasks use: Hadoop's default store for a bare one, plain for local files."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return full.removeprefix("file:").replace("//", "/") if full.startswith("file:") else full


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_lines(lines: DataFrame, path: str, file: str, header: str = "", overwrite: bool = False) -> None:
    """The one string column of ``lines``, in the order of its partitions and rows, as the only file of a folder.

    A null is an empty line; an empty table gives the header alone. A taken path is an error unless it may be replaced.
    """
    spark = lines.sparkSession
    if not overwrite and _exists(spark, path):
        raise FileExistsError(path)
    to = _qualified(spark, path.rstrip("/"))
    above, name = to.rsplit("/", 1)
    spark.dataSource.register(OrderedText)
    writer = lines.select(F.col(lines.columns[0]).alias("value")).write.format("ordered_text").mode("append")
    writer.option("parts", f"{above}/_{name}-{uuid.uuid4().hex}").option("file", file).option("header", header).save(to)


def write_table(df: DataFrame, path: str, sep: str = ",", overwrite: bool = False) -> None:
    """A table as one delimited file with a header; quotes are doubled, values may hold line ends, nulls are blank.

    Column names may repeat. Sort before, as ``orderBy`` keeps its order over partitions.
    """
    head = io.StringIO()
    csv.writer(head, delimiter=sep, lineterminator="").writerow(df.columns)
    own = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    write_lines(own.select(F.to_csv(F.struct(*own.columns), {"sep": sep, "escape": '"'})), path, "part-00000.csv", head.getvalue(), overwrite)
