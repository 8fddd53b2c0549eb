"""A sink that writes strings as they are: no byte is added, and a pack is whole or not there.

``df.write.format("satchel_pack").option("path", ...)`` takes ``corpus, value`` sorted within
partitions.  Each task writes its rows of a corpus to one shard; a manifest, written last, names
the shards (``committer``).  ``read_pack`` follows it, and so do those who take the shards by the
manifest's list; a job that died leaves no manifest.  The folder may be local or in any store that
Arrow's file systems know by URI; a target that exists is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from satchel.sources.committer import Write, committed, place

_NULL = "__HIVE_DEFAULT_PARTITION__"


@dataclass
class Shards(WriterCommitMessage):
    names: list[str]


class PackWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        if overwrite:
            raise ValueError("A pack is never overwritten.")
        self.path, self.own = path, Write(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shards:
        store, target = place(self.path)
        task = TaskContext.get()
        names: list[str] = []
        out = corpus = None
        for batch in iterator:
            for name, value in zip(batch.column("corpus").to_pylist(), batch.column("value").cast(pa.binary()).to_pylist()):
                if out is None or name != corpus:
                    if out is not None:
                        out.close()
                    corpus = name
                    folder = "corpus=" + quote(name if name is not None else _NULL, safe=" ")
                    store.create_dir(f"{target}/{folder}", recursive=True)
                    names.append(f"{folder}/{self.own.name(task.partitionId(), task.taskAttemptId(), len(names), '.txt')}")
                    out = store.open_output_stream(f"{target}/{names[-1]}", compression=None)
                out.write(value or b"")
        if out is not None:
            out.close()
        return Shards(names)

    def commit(self, messages: list[Shards | None]) -> None:
        self.own.commit([n for m in messages if m for n in m.names])

    def abort(self, messages: list[Shards | None]) -> None:
        self.own.abort()


class PackSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "satchel_pack"

    def schema(self) -> str:
        return "corpus string, value string"

    def writer(self, schema, overwrite: bool) -> PackWriter:
        return PackWriter(self.options["path"], overwrite)


def read_pack(spark: SparkSession, path: str) -> DataFrame:
    """``corpus, part, value``: the shards of a pack, whose values in the order of ``part`` are its text.

    A folder without manifest is no pack.
    """
    names = committed(path)
    if names is None:
        raise FileNotFoundError(f"{path} holds no finished pack.")
    rows = []
    for part, name in enumerate(names):
        corpus = unquote(name.split("/")[0].removeprefix("corpus="))
        rows.append((None if corpus == _NULL else corpus, part, name))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = place(path)
        for batch in batches:
            for corpus, part, name in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_stream(f"{folder}/{name}", compression=None) as file:
                    yield pa.RecordBatch.from_arrays([pa.array([corpus], pa.string()), pa.array([part], pa.int32()), pa.array([file.read()], pa.binary()).cast(pa.string())], names=["corpus", "part", "value"])

    shards = spark.createDataFrame(rows, "corpus string, part int, name string")
    # One task for each shard.
    return shards.repartitionById(max(1, len(rows)), "part").mapInArrow(read, "corpus string, part int, value string")


def refuse_existing(path: str) -> None:
    store, target = place(path)
    if store.get_file_info(target).type != fs.FileType.NotFound:
        raise FileExistsError(f"{path} exists already; a pack is never overwritten.")
