"""A4, A5: whole files in, restored text out."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.operators.rewrite import restore
from maskweave.operators.tables import written

_LIST_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: What Spark names a folder of rows without a key.
_NO_KEY = "__HIVE_DEFAULT_PARTITION__"
#: Files of a reading task at most, and bytes of the contents that it hands on at once (a longer file is alone).
_TASK_FILES, _STEP_BYTES = 20_000, 4 << 20


def _hidden(name: str) -> bool:
    """What Spark's readers leave out."""
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def _entries(deep: bool):
    """Files and, unless they are searched too (``deep``), folders of the given folders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folders = [raw for b in batches for raw in b.column("raw").to_pylist()]
        found: list[tuple[bytes, bool]] = []
        while folders:
            with os.scandir(folders.pop()) as entries:
                for x in entries:
                    if _hidden(os.fsdecode(x.name)):
                        continue
                    if x.is_dir() and deep:
                        folders.append(x.path)
                    elif x.is_dir() or x.is_file():
                        found.append((x.path, x.is_dir()))
                    if len(found) == 10_000:
                        yield _entry_batch(found)
                        found = []
        if found:
            yield _entry_batch(found)

    return run


def _entry_batch(found: list[tuple[bytes, bool]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found])], ["raw", "folder"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, content, length) of the files; those that cannot be read or are empty are left out; one that has gone fails the task."""
    rows: list[tuple[str, bytes, int]] = []
    held = 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.int64()))], ["path", "content", "length"])
    for b in batches:
        for raw in b.column("raw").to_pylist():
            try:
                with open(raw, "rb") as f:
                    content = f.read()
            except FileNotFoundError:
                raise
            except OSError:
                continue
            if not content:  # as Spark's reader does
                continue
            if rows and held + len(content) > _STEP_BYTES:
                yield make()
                rows, held = [], 0
            rows.append(("file:" + raw.decode("utf-8", "replace"), content, len(content)))
            held += len(content) + 200
    if rows:
        yield make()


def _local_files(spark: SparkSession, folder: str, glob: str | None) -> DataFrame:
    """(path, content, length) of the files below a local folder that all tasks see.  Tasks list the files, into the
    checkpoint folder, and read them, so the driver keeps no entry for a file."""
    tasks, shape = 4 * spark.sparkContext.defaultParallelism, "raw binary, folder boolean"
    top = spark.createDataFrame([(bytearray(os.fsencode(folder)),)], "raw binary").coalesce(1)
    top = written(top.mapInArrow(_entries(False), shape), "listed-top")
    below = top.filter("folder").select("raw").repartition(tasks).mapInArrow(_entries(True), shape)
    listed = top.filter("NOT folder").unionByName(below)
    if glob:
        pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern.compile(glob).pattern()
        name = F.regexp_extract(F.col("raw").cast("string"), r"([^/]*)$", 1)
        listed = listed.filter(F.regexp_like(name, F.lit(f"(?s)\\A(?:{pattern})\\z")))
    listed = written(listed.select("raw"), "listed")
    tasks = max(tasks, -(-listed.count() // _TASK_FILES))
    return listed.repartition(tasks).mapInArrow(_contents, "path string, content binary, length long")


def _spark_files(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    """(path, content, length) by Spark's reader, whose driver keeps an entry for each file."""
    reader = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    before = spark.conf.get(_LIST_TASKS)
    spark.conf.set(_LIST_TASKS, str(4 * spark.sparkContext.defaultParallelism))
    try:
        return reader.load(path)
    finally:
        spark.conf.set(_LIST_TASKS, before)


def read_texts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """A4: one row per file – path, base name, lower-case extension, UTF-8 content, bytes, reason.
    Files that cannot be read are skipped (``ignoreCorruptFiles``); a file that is no UTF-8 text has
    null content and says so in ``reason``.  A file is read whole by one task.  The files of a ``file:`` folder are
    listed by tasks; elsewhere Spark lists them, by a few tasks a core (its 10,000 tasks take longer to start than to list)."""
    local = None
    if urlsplit(path).scheme == "file" and not set(path) & set("*?[]{}\\"):
        local = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath()
    df = _local_files(spark, local, glob) if local is not None and os.path.isdir(local) else _spark_files(spark, path, glob)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return df.select(
        "path",
        name.alias("name"),
        F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("extension"),
        text.alias("content"),
        F.col("length").alias("bytes"),
        F.when(text.isNull(), F.lit("not UTF-8 text")).alias("reason"),
    )


def _one_file_each(folder: str, key: str):
    """Rows come sorted by key; a file gets its name once it is whole, so a task that runs again replaces it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        own = os.path.join(folder, str(context.partitionId()))
        os.makedirs(own, exist_ok=True)
        draft = os.path.join(own, f".draft-{context.taskAttemptId()}")
        name, out, n = None, None, 0
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1)):
                if out is None or k != name:
                    if out is not None:
                        out.close()
                        os.replace(draft, os.path.join(own, f"{key}={_NO_KEY if name is None else name}.txt"))
                    name, out, n = k, open(draft, "wb"), n + 1
                out.write(raw.as_py() or b"")
                out.write(b"\n")
        if out is not None:
            out.close()
            os.replace(draft, os.path.join(own, f"{key}={_NO_KEY if name is None else name}.txt"))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    return run


def write_texts(df: DataFrame, key_col: str, text_col: str, path: str) -> None:
    """One text file for each (integral) key, its rows' texts as lines; the path holds ``key=value``.

    In a ``file:`` folder the tasks write the files themselves, into a folder for each task: Hadoop's local file
    system starts a ``chmod`` for every file and folder.  Elsewhere Spark's text writer makes a folder for each key."""
    dealt = df.select(key_col, F.col(text_col)).repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key_col)
    if urlsplit(path).scheme != "file":
        dealt.write.partitionBy(key_col).text(path)
        return
    rows = dealt.select(key_col, F.col(text_col).cast("binary")).sortWithinPartitions(key_col)
    rows.mapInArrow(_one_file_each(unquote(urlsplit(path).path), key_col), "files long").agg(F.sum("files")).collect()


def write_restored(df: DataFrame, vault: DataFrame, key_cols: list[str], text_col: str, path: str) -> None:
    """A5: restore tokens (D1), then write the rows as Parquet with their keys."""
    restored = restore(df, vault, key_cols, text_col)
    restored.write.mode("overwrite").parquet(path)
