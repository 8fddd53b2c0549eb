"""Progressive review: the corpus arrives in bounded micro-batches.

Streaming results are for looking at; a pack is always written by a fresh batch
job over the table (``plans.export``), never from a stream's state.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from satchel.functions import paths as P
from satchel.operators import rollup, selection, sensitive as V
from satchel.plans.session import scratch_path
from satchel.plans.settings import RunSettings

BATCH_FILES = 512
#: Tables of one level of a running roll-up that are merged into one of the next.
FAN = 8
#: Bytes of override keys that are sent to every task.
MOST_LOOKED_UP = 16 << 20


def read_stream(
    spark: SparkSession, path: str, schema, format: str = "parquet", batch_files: int = BATCH_FILES, glob: str = ""
) -> DataFrame:
    """Files that land in a folder, at most ``batch_files`` per micro-batch."""
    reader = spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", batch_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def once(stream: DataFrame, ingest_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each path counts once.

    Without an ingest time the state is the inventory itself; with one, duplicates
    are only remembered for ``delay``, which suits an endless stream.
    """
    keyed = stream.withColumn("path_key", P.path_key("path"))
    keys = ["corpus", "path_key"]
    if ingest_time is None:
        return keyed.dropDuplicates(keys).drop("path_key")
    return keyed.withWatermark(ingest_time, delay).dropDuplicatesWithinWatermark(keys).drop("path_key")


def stamped(stream: DataFrame, column: str = "ingest_time") -> DataFrame:
    """Add the time at which a row's batch began: it never runs backwards, so no row is too late for a watermark."""
    return stream.withColumn(column, F.current_timestamp())


def running_types(stream: DataFrame, extensions, dot_files) -> DataFrame:
    """Counts per type so far."""
    return rollup.type_counts(stream, extensions, dot_files)


def running_rollup(stream: DataFrame) -> DataFrame:
    """Files, bytes and tokens per directory so far, for trees that are small.

    A streaming aggregate, whose state and (in complete mode) answer hold every
    directory; :func:`start_rollup` writes what a batch changes only.
    """
    return (
        stream.select(
            "corpus", F.explode(selection.chain(P.parent("path"))).alias("directory"), "text_bytes", "tokens")
        .groupBy("corpus", "directory")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("text_bytes").alias("text_bytes"), F.sum("tokens").alias("tokens"))
    )


#: Columns of a table of sums.
ROLLUP = "corpus string, directory string, files bigint, text_bytes bigint, tokens bigint"


def _merged(deltas: DataFrame) -> DataFrame:
    """One row per directory of several deltas, spelled as the first of its spellings."""
    sums = ("files", "text_bytes", "tokens")
    return (
        deltas.groupBy("corpus", P.path_key("directory").alias("__key"))
        .agg(F.min("directory").alias("directory"), *[F.sum(n).alias(n) for n in sums])
        .drop("__key")
    )


def _runs(out: str, batches: int) -> list[str]:
    """The fewest tables that hold what the first ``batches`` batches added, each once."""
    found, level = [], 0
    while batches:
        found += [f"{out}/level-{level}/run-{k}" for k in range(batches // FAN * FAN, batches)]
        batches, level = batches // FAN, level + 1
    return found


def start_rollup(
    stream: DataFrame, out: str, checkpoint: str, ingest_time: str | None = None, delay: str = "1 day", **trigger
):
    """Keep sums per directory below ``out`` while files arrive; :func:`read_rollup` reads them.

    A batch writes one row for each directory that it touches, and nothing else: there
    is no state of directories.  Every ``FAN`` tables of a level are merged into one of the
    next by the batch that completes them, so a row is rewritten once per level and readers
    meet few tables.  All names follow from batch numbers: a batch repeated after a failure
    replaces what it wrote.  With ``ingest_time`` each path counts once (:func:`once`), and
    no path is remembered for longer than ``delay``; :func:`stamped` gives such a column.
    """
    spark = stream.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        rollup.contributions(batch).write.mode("overwrite").parquet(f"{out}/level-0/run-{number}")
        level, done = 1, number + 1
        while done % FAN == 0:
            done //= FAN
            parts = [f"{out}/level-{level - 1}/run-{k}" for k in range((done - 1) * FAN, done * FAN)]
            _merged(spark.read.schema(ROLLUP).parquet(*parts)).write.mode("overwrite").parquet(f"{out}/level-{level}/run-{done - 1}")
            level += 1

    files = stream if ingest_time is None else once(stream, ingest_time, delay)
    writer = files.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_rollup(spark: SparkSession, out: str, checkpoint: str) -> DataFrame:
    """Files, bytes and tokens per directory, of the batches that are finished."""
    done = committed_batches(spark, checkpoint)
    if not done:
        return spark.createDataFrame([], ROLLUP)
    return _merged(spark.read.schema(ROLLUP).parquet(*_runs(out, done[-1] + 1)))


def drain_rollup(stream: DataFrame, label: str, ingest_time: str | None = None) -> DataFrame:
    """The sums per directory when everything present has been read."""
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    start_rollup(stream, out, checkpoint, ingest_time, availableNow=True).awaitTermination()
    return read_rollup(spark, out, checkpoint)


def inherit_choice(stream: DataFrame, overrides: DataFrame, default: Column) -> DataFrame:
    """Late files take the choice of their nearest ancestor, or their own; no state.

    Overrides whose keys take at most ``MOST_LOOKED_UP`` bytes are sent to the tasks, which
    look a path and its ancestors up, nearest first, in one pass.  More of them are joined,
    with one equi-join for each depth that occurs among them; both answer alike.  Of
    overrides that repeat a path, one that excludes counts.  Files without corpus or path,
    and overrides without corpus, path or choice, meet nothing.
    """
    keyed = (
        overrides.filter("corpus IS NOT NULL AND path IS NOT NULL AND included IS NOT NULL")
        .groupBy("corpus", P.path_key(P.normalize("path")).alias("__key")).agg(F.min("included").alias("__inc")))
    size = keyed.agg(F.sum(F.octet_length("corpus") + F.octet_length("__key"))).first()[0]
    if size is None:
        return stream.withColumn("included", default)
    key = P.path_key(P.normalize("path"))
    if size <= MOST_LOOKED_UP:
        table = stream.sparkSession.sparkContext.broadcast({(r[0], r[1]): r[2] for r in keyed.toLocalIterator()})
        return stream.withColumn("included", F.coalesce(_look_up(table)("corpus", key), default))
    depth = F.when(F.col("__key") == "", 0).otherwise(P.depth("__key"))
    # A path has few levels, however many overrides there are.
    levels = sorted((r[0] for r in keyed.select(depth).distinct().collect()), reverse=True)
    out, found = stream.withColumn("__parts", P.segments(key)), []
    for level in levels:
        name = f"__inc{level}"
        above = F.when(F.size("__parts") >= level, F.array_join(F.slice("__parts", 1, level), "/")) if level else F.when(F.col("path").isNotNull(), "")
        out = out.withColumn("__key", above).join(
            keyed.where(depth == level).withColumnRenamed("__inc", name), ["corpus", "__key"], "left").drop("__key")
        found.append(F.col(name))
    return out.withColumn("included", F.coalesce(*found, default)).drop("__parts", *[f"__inc{level}" for level in levels])


def _look_up(table):
    """The choice of a key or of its nearest ancestor that has one, in a broadcast dict."""

    def choose(corpus: pa.Array, key: pa.Array) -> pa.Array:
        known, out = table.value, []
        for c, k in zip(corpus.to_pylist(), key.to_pylist()):
            found = None
            while k is not None and found is None:
                found, k = known.get((c, k)), k.rpartition("/")[0] if k else None
            out.append(found)
        return pa.array(out, pa.bool_())

    return F.arrow_udf(choose, "boolean")


def running_findings(stream: DataFrame, settings: RunSettings = RunSettings()) -> DataFrame:
    """Findings of new bodies as they arrive; stateless."""
    return V.finding_rows(V.scan(stream, settings), settings)


def start(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", **trigger):
    """Write every micro-batch into a folder of its own, ``batch=<n>`` below ``out``.

    A batch repeated after a failure replaces itself.  ``trigger`` as of ``DataStreamWriter.trigger``.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def committed_batches(spark: SparkSession, checkpoint: str) -> list[int]:
    """Numbers of the batches that a query has finished, from its commit log."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    log = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    files = log.getFileSystem(hadoop)
    if not files.exists(log):
        return []
    names = [f.getPath().getName() for f in files.listStatus(log)]
    return sorted(int(n) for n in names if n.isdigit())


def read_batches(spark: SparkSession, out: str, checkpoint: str, schema, newest: bool = False) -> DataFrame:
    """What finished batches hold; of a query in complete mode the ``newest`` is the answer.

    A batch that was being written when the query ended is not part of it, even if its folder is whole.
    """
    done = committed_batches(spark, checkpoint)
    done = done[-1:] if newest else done
    if not done:
        return spark.createDataFrame([], schema)
    # The log keeps the last hundred batches or so; all before them are finished too.
    table = spark.read.option("basePath", out).schema(schema).parquet(out)
    batch = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/[^/]*$", 1).cast("bigint")
    return table.where((batch <= done[-1]) & (batch >= (done[-1] if newest else 0))).drop("batch")


def freeze(query, out: str, checkpoint: str, schema, newest: bool = False) -> DataFrame:
    """Stop a running query and read the batches it has finished; the result no longer changes."""
    query.stop()
    return read_batches(SparkSession.active(), out, checkpoint, schema, newest)


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream until everything present has been read and return its table."""
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    start(stream, out, checkpoint, mode, availableNow=True).awaitTermination()
    return read_batches(spark, out, checkpoint, stream.schema, newest=mode == "complete")
