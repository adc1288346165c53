"""Helpers that all operators of this subpackage share.

Conventions
-----------
* A null text counts as the empty text; a null id stays null in the result.
* Only the columns that an operator names are read, so extra columns, whatever
  their names, never clash with internal ones.
* Python code runs on bounded slices (:func:`slices`), so one batch of very long
  texts never multiplies in memory.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space: what parts words everywhere in this subpackage.
WHITE = " \t\n\x0b\x0c\r"
#: Bytes of text that a slice holds at most, but for a single longer text.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset (local tests) a temporary folder of this machine
    takes its place, which is right for a single JVM alone.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="revoicer-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, so a
    lost executor costs no recomputation, and later steps see one fixed result."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What operators remember in a Python worker from task to task.
MEMORIES: dict[str, dict] = {}


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES, memory: str = "") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches to slices of about ``limit`` bytes of text; yields each with
    its texts as UTF-8 bytes (null: empty). Workers are used by one operator after another:
    what others than this one (``memory``) remember is dropped first."""
    for name, other in MEMORIES.items():
        if name != memory:
            other.clear()
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
        at, n = 0, len(sizes)
        ends = np.cumsum(sizes)
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at), [x or b"" for x in column.slice(at, to - at).to_pylist()]
            at = to
    give_back()


def without_cycles(fn: Callable) -> Callable:
    """A generator that runs without the collector of reference cycles: for work that
    makes many small objects and no cycles, where each pass of it only costs time."""

    @functools.wraps(fn)
    def run(batches):
        gc.disable()
        try:
            yield from fn(batches)
        finally:
            gc.enable()

    return run


def give_back() -> None:
    """Return freed memory to the system: workers are used again, by other operators too."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_slices(df: DataFrame, fn: Callable, schema: str | T.StructType, text: str = "text") -> DataFrame:
    """``fn(batch, texts) -> dict of columns`` over every slice, by ``mapInArrow``."""
    struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = arrow_schema(struct)

    @without_cycles
    def run(batches):
        for batch, texts in slices(batches, text):
            yield record(fn(batch, texts), arrow)

    return df.mapInArrow(run, struct)


def arrow_schema(struct: T.StructType) -> pa.Schema:
    kinds = {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
        "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32()),
    }
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in struct.fields])


def record(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in schema:
        x = columns[field.name]
        x = x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=field.type, from_pandas=False)
        arrays.append(x if x.type == field.type else x.cast(field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and the list sizes."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat, type=kind))


def id_crc(ids: list) -> np.ndarray:
    """crc32 of each id as text; a null id counts as empty text."""
    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) for i in ids), dtype=np.int64, count=len(ids))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def words_of(texts: list[bytes], lower: bool = False) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts, one after the other, and how many each text has."""
    parts = [(x.lower() if lower else x).split() for x in texts]
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    return [w for p in parts for w in p], sizes


def ids_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def file_system(uri: str):
    """``(pyarrow file system, path)`` of a folder's URI."""
    import pyarrow.fs as fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def with_columns(docs: DataFrame, fn: Callable, fields: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``docs`` (or its columns ``keep``) with what ``fn(batch, texts)`` adds, by
    ``mapInArrow``; ``fields`` is the DDL of the added columns. No join, no shuffle."""
    added = T._parse_datatype_string(fields)
    keep = docs.columns if keep is None else keep
    out = T.StructType([docs.schema[c] for c in keep] + added.fields)
    arrow = arrow_schema(added)

    @without_cycles
    def run(batches):
        for batch, texts in slices(batches, text):
            more = record(fn(batch, texts), arrow)
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in keep] + more.columns, names=[*keep, *arrow.names])

    return docs.mapInArrow(run, out)


# ---- tables by block --------------------------------------------------------
# A block is a slice of a task's input. Some operators need, for the words of a block,
# facts of the whole corpus: they are shuffled to one side file per block in the shared
# folder, so that texts themselves never move.


def blocks(batches: Iterator[pa.RecordBatch], limit: int = 16 << 20) -> Iterator[tuple[int, pa.RecordBatch, list[bytes]]]:
    """(block, batch, texts): a block's number holds its task's partition, so it is the
    same in every pass over the same files."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for i, (batch, texts) in enumerate(slices(batches, limit=limit)):
        yield part << 24 | i, batch, texts


def write_file(folder: str, name: str, rows: pa.Table) -> None:
    """An Arrow file that appears whole; every attempt of a task writes the same rows, so
    the first file that is there may stay."""
    from pyspark import TaskContext

    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    own, final = f"{root}/{name}.{TaskContext.get().taskAttemptId()}", f"{root}/{name}"
    with fs.open_output_stream(own, compression=None) as out, pa.ipc.new_file(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    try:
        fs.move(own, final)
    except OSError:
        if not fs.get_file_info(final).is_file:
            raise
        fs.delete_file(own)


def read_file(folder: str, name: str) -> pa.Table | None:
    """What :func:`write_file` wrote; None where there is no such file."""
    fs, root = file_system(folder)
    path = f"{root}/{name}"
    if not fs.get_file_info(path).is_file:
        return None
    with fs.open_input_file(path) as source:
        return pa.ipc.open_file(source).read_all()


def write_by_block(rows: DataFrame, folder: str) -> None:
    """One Arrow file per block from rows (block, ...). A block's rows are the same in
    every attempt, and a file appears whole, so a repeated task does no harm."""
    names = [c for c in rows.columns if c != "block"]
    schema = arrow_schema(rows.select(*names).schema)
    done_schema = pa.schema([("block", pa.int64())])

    def run(batches):
        now, parts, done = None, [], []

        def close():
            write_file(folder, f"{now}.arrow", pa.Table.from_batches(parts, schema))
            done.append(now)

        for batch in batches:
            block = np.asarray(column(batch, "block"))
            edges = np.flatnonzero(np.diff(block)) + 1
            for a, b in zip([0, *edges], [*edges, len(block)], strict=True):
                if b > a:
                    if now is not None and block[a] != now:
                        close()
                        parts = []
                    now = int(block[a])
                    parts.append(pa.RecordBatch.from_arrays([column(batch, c).slice(a, b - a).cast(schema.field(c).type) for c in names], schema=schema))
        if now is not None:
            close()
        yield record({"block": done}, done_schema)

    rows.select("block", *names).repartition("block").sortWithinPartitions("block").mapInArrow(run, "block bigint").write.format("noop").mode("overwrite").save()


def read_block(folder: str, block: int) -> pa.Table | None:
    """A block's rows; None for a block without any."""
    return read_file(folder, f"{block}.arrow")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new name in this run's part of the shared folder. Results read what lies there, so
    it stays until the driver's process ends, which removes it."""
    root = f"{shared_dir(spark)}/revoicer/{spark.sparkContext.applicationId}"
    if root not in RUNS:
        RUNS.add(root)
        atexit.register(removed, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


RUNS: set[str] = set()


def removed(root: str) -> None:
    with contextlib.suppress(Exception):  # at the end of the process there is no one to tell
        fs, path = file_system(root)
        fs.delete_dir(path)
