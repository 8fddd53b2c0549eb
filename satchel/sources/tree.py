"""Raw folders, dot files included, listed and read by executors.

``walk`` lists a folder in rounds: each round is one Spark job over the folders that the rounds
before have found, and every folder is listed by exactly one task.  A task goes on into what it
finds for a bounded number of folders and hands the others to the next round, so neither a
wide nor a deep tree is the work of one task, and a chain of a thousand folders takes a few rounds.  With
``prune``, folders that it drops are never entered.  ``read_files`` packs listed files into read tasks
of about equal bytes.

The format ``satchel_tree`` reads the same rows with ``spark.read`` (each folder below the root is one
task; for modest trees) and, with ``spark.readStream``, in bounded batches: the driver lists ahead,
and writes what a batch holds below ``frontier`` before its offset is known to Spark, so a restart
repeats the same batches and loses none.

Rows: ``corpus, path, is_dir, size, content, error``.  Links are listed with an error and not followed.
Folders that cannot be listed and files that cannot be read are rows with an error.  Names that are not
UTF-8 have their bytes replaced in ``path`` and an error.  The folder has to be mounted on every executor,
the frontier where the driver runs, also after a restart.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from satchel.plans.running import running_total
from satchel.plans.session import scratch_path, stage

SCHEMA = "corpus string, path string, is_dir boolean, size bigint, content binary, error string"
#: Folders that a task may enter in the round that finds them.
AHEAD = 256
#: Bytes of files that one task reads, and what opening a file counts for.
TASK_BYTES, OPEN_BYTES = 128 << 20, 64 << 10
#: Files of a micro-batch.
BATCH_FILES = 512


def list_folder(root: str, folder: str) -> Iterator[tuple[str, bool, int, str | None]]:
    """``path, is_dir, size, error`` of what a folder holds, by name; one row with an error if it cannot be listed."""
    try:
        with os.scandir(os.path.join(root, folder)) as listing:
            entries = sorted(listing, key=lambda e: e.name)
    except OSError as exc:
        yield folder, True, 0, f"could not list: {exc.strerror}"
        return
    for entry in entries:
        path = f"{folder}/{entry.name}" if folder else entry.name
        named = path.encode("utf-8", "replace").decode()
        if entry.is_dir(follow_symlinks=False):
            yield named, True, 0, None if named == path else "name is not UTF-8"
        elif named != path:
            yield named, False, 0, "name is not UTF-8"
        elif entry.is_symlink():
            yield path, False, 0, "link content was not read"
        else:
            try:
                yield path, False, entry.stat(follow_symlinks=False).st_size, None
            except OSError as exc:
                yield path, False, 0, f"could not read: {exc.strerror}"


def read_file(root: str, path: str) -> tuple[bytes | None, str | None]:
    """A file's bytes, or why there are none."""
    try:
        with open(os.path.join(root, path), "rb") as body:
            return body.read(), None
    except OSError as exc:
        return None, f"could not read: {exc.strerror}"


_LISTED = pa.schema([("path", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64()), ("error", pa.string()), ("open", pa.bool_())])
_READ = pa.schema([("path", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _lister(root: str, ahead: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ahead
        for batch in batches:
            pending, rows = batch.column("path").to_pylist()[::-1], []
            while pending:
                for path, is_dir, size, error in list_folder(root, pending.pop()):
                    # What a task enters itself is on its stack, the rest is left open.
                    enter = is_dir and error is None and own > 0
                    own -= enter
                    rows.append((path, is_dir, size, error, is_dir and error is None and not enter))
                    if enter:
                        pending.append(path)
                if len(rows) >= 10_000:
                    yield _batch(rows, _LISTED)
                    rows = []
            yield _batch(rows, _LISTED)

    return listed


@dataclass(frozen=True)
class Round:
    """What one round of a walk has listed."""

    folders: int
    found: int


def walk(
    spark: SparkSession, path: str, corpus: str = "corpus", prune: Callable[[DataFrame], DataFrame] | None = None,
    ahead: int = AHEAD, rounds: list[Round] | None = None,
) -> DataFrame:
    """``corpus, path, is_dir, size, error`` of everything below a folder, itself left out.

    ``prune`` takes rows of a round (``corpus, path, is_dir, size, error``) and returns those
    that stay; folders that it drops are not entered.  ``rounds`` receives a number of folders
    and rows for each round.
    """
    root, out = os.path.abspath(path), scratch_path(spark, "walk")
    front, folders, k = spark.createDataFrame([("",)], "path string"), 1, 0
    lister = _lister(root, 0 if prune else ahead)
    kept = ("corpus", "path", "is_dir", "size", "error")
    while folders:
        tasks = min(folders, 4 * spark.sparkContext.defaultParallelism)
        listed = front.repartition(tasks, "path").mapInArrow(lister, "path string, is_dir boolean, size bigint, error string, open boolean")
        listed = listed.withColumn("corpus", F.lit(corpus))
        if prune:
            # The mark goes with the row, whatever columns a pruning function passes on.
            listed = prune(listed.select(*kept)).select(*kept).withColumn("open", F.col("is_dir") & F.col("error").isNull())
        listed.select(*kept, "open").write.parquet(f"{out}/round={k}")
        level = spark.read.parquet(f"{out}/round={k}")
        sums = level.agg(F.count(F.lit(1)).alias("found"), F.count_if("open").alias("open")).first()
        if rounds is not None:
            rounds.append(Round(folders, sums["found"]))
        front, folders, k = level.where("open").select("path"), sums["open"], k + 1
    return spark.read.parquet(out).select(*kept)


def _reader(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, is_dir, size, error in zip(*(batch.column(c).to_pylist() for c in ("path", "is_dir", "size", "error"))):
                content = None
                if not is_dir and error is None:
                    content, error = read_file(root, path)
                    size = len(content or b"")
                rows.append((path, is_dir, size, content, error))
                held += size
                if len(rows) >= 1000 or held >= 32 << 20:
                    yield _batch(rows, _READ)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, _READ)

    return read


def read_files(listing: DataFrame, path: str, task_bytes: int = TASK_BYTES, open_bytes: int = OPEN_BYTES) -> DataFrame:
    """The listed rows with the content of files, dealt out to tasks by bytes.

    Rows come along in the order of their paths, so a task reads files of few folders.  A file is
    one row and read by one task.
    """
    cost = F.when(F.col("is_dir"), 0).otherwise(F.col("size") + open_bytes).cast("bigint")
    placed = running_total(listing, ["path"], cost, "before", ["corpus"]).withColumn("task", F.floor(F.col("before") / task_bytes).cast("int"))
    placed = stage(placed, "placed")
    tasks = (placed.agg(F.max("task")).first()[0] or 0) + 1
    dealt = placed.repartitionById(tasks, "task")
    read = dealt.select("corpus", "path", "is_dir", "size", "error")
    names = listing.select("corpus").distinct().collect()
    if len(names) > 1:
        raise ValueError("A folder is one corpus.")
    found = read.mapInArrow(_reader(os.path.abspath(path)), "path string, is_dir boolean, size bigint, content binary, error string")
    return found.select(F.lit(names[0][0] if names else None).alias("corpus"), "path", "is_dir", "size", "content", "error")


@dataclass
class Folder(InputPartition):
    top: str
    deep: bool


@dataclass
class Files(InputPartition):
    rows: list[tuple[str, bool, int, str | None]]


class TreeDataSource(DataSource):
    """``format('satchel_tree').options(path=..., corpus=...)``; streams also need ``frontier`` and may set
    ``batch_files`` and ``task_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "satchel_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = os.path.abspath(options["path"])
        self.corpus = options.get("corpus", "corpus")

    def partitions(self) -> list[InputPartition]:
        tops = sorted(p for p, is_dir, _, error in list_folder(self.root, "") if is_dir and p and error is None)
        return [Folder("", False), *(Folder(t, True) for t in tops)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        pending = [partition.top]
        while pending:
            for row in list_folder(self.root, pending.pop()):
                if row[1] and row[3] is None and partition.deep:
                    pending.append(row[0])
                yield _whole(self.root, self.corpus, row)


def _whole(root: str, corpus: str, row: tuple[str, bool, int, str | None]) -> tuple:
    path, is_dir, size, error = row
    if is_dir or error is not None:
        return corpus, path, is_dir, size, None, error
    content, error = read_file(root, path)
    return corpus, path, False, len(content or b""), content, error


class TreeStream(DataSourceStreamReader):
    """One pass over a folder in batches of ``batch_files`` rows.

    An offset is the number of batches so far.  Below ``frontier``, ``batch-<n>.json`` holds the
    rows of the n-th batch, ``state.json`` the folders that are still to be listed, how many batches
    are written and how many were handed to Spark.  The state is replaced after the batches it counts, and a
    batch is handed out after the state says so; so what Spark knows is always on disk, and a batch
    that a crash kept from Spark is part of the next one.
    """

    def __init__(self, options: dict) -> None:
        if "frontier" not in options:
            raise ValueError("A stream over a folder needs the option frontier: a folder that outlives the query.")
        self.root = os.path.abspath(options["path"])
        self.corpus = options.get("corpus", "corpus")
        self.frontier = options["frontier"].removeprefix("file://")
        self.most = max(1, int(options.get("batch_files", BATCH_FILES)))
        self.task_bytes = max(1, int(options.get("task_bytes", TASK_BYTES)))

    def _file(self, name: str) -> str:
        return os.path.join(self.frontier, name)

    def _save(self, name: str, value: object) -> None:
        os.makedirs(self.frontier, exist_ok=True)
        with open(self._file(f"{name}.tmp"), "w") as out:
            json.dump(value, out)
            out.flush()
            os.fsync(out.fileno())
        os.replace(self._file(f"{name}.tmp"), self._file(name))

    def _state(self) -> dict:
        try:
            with open(self._file("state.json")) as file:
                return json.load(file)
        except FileNotFoundError:
            return {"open": [""], "rows": [], "written": 0, "handed": 0}

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        """One batch further, if there is any."""
        state = self._state()
        if state["handed"] == state["written"]:
            rows, pending = state["rows"], state["open"]
            while pending and len(rows) < self.most:
                found = list(list_folder(self.root, pending.pop()))
                rows += found
                pending += [r[0] for r in reversed(found) if r[1] and r[3] is None]
            # A wide folder is several batches, written at once; the remainder waits for the next folder.
            cut = len(rows) if not pending else len(rows) - len(rows) % self.most
            for at in range(0, cut, self.most):
                state["written"] += 1
                self._save(f"batch-{state['written']}.json", rows[at:min(at + self.most, cut)])
            state["rows"] = rows[cut:]
        if state["handed"] < state["written"]:
            state["handed"] += 1
            self._save("state.json", state)
        return {"batch": state["handed"]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        tasks, held = [Files([])], 0
        for n in range(start["batch"] + 1, end["batch"] + 1):
            with open(self._file(f"batch-{n}.json")) as file:
                for row in map(tuple, json.load(file)):
                    if held > 0 and held + row[2] > self.task_bytes:
                        tasks.append(Files([]))
                        held = 0
                    tasks[-1].rows.append(row)
                    held += row[2] + OPEN_BYTES
        return tasks

    def read(self, partition: Files) -> Iterator[tuple]:
        for row in partition.rows:
            yield _whole(self.root, self.corpus, row)

    def commit(self, end: dict) -> None:
        """Batches up to here are never asked for again."""
        n = end["batch"]
        while n > 0 and os.path.exists(self._file(f"batch-{n}.json")):
            os.remove(self._file(f"batch-{n}.json"))
            n -= 1


def read_stream(spark: SparkSession, path: str, frontier: str, corpus: str = "corpus", batch_files: int = BATCH_FILES) -> DataFrame:
    """A folder as a stream of bounded batches."""
    spark.dataSource.register(TreeDataSource)
    return spark.readStream.format("satchel_tree").options(path=path, corpus=corpus, frontier=frontier, batch_files=batch_files).load()
