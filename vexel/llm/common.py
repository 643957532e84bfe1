"""Shared helpers: reading tables, cutting lineage in the shared folder, digest tools."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds at once, unless one row alone has more.
CHUNK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; one of our own only where none is set, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Session setting under which Spark removes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Session setting: binary logarithm of the groups that the hash map in compiled code takes.
HASHED = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"


#: Bytes of a table's files for each partition of an exchange that moves all its text, and the size of what has no known one.
SPREAD_BYTES, UNKNOWN = 10 << 20, 1 << 60


def spread(docs: DataFrame) -> int:
    """Partitions of an exchange of all texts: as many as the session has, but more for large tables, so that none must spill."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(slots(docs.sparkSession), 1 if size > UNKNOWN else -(-size // SPREAD_BYTES))


@contextlib.contextmanager
def settings(spark: SparkSession, given: dict) -> Iterator[None]:
    """Has these settings of the session, but for those that are None, hold inside only."""
    given = {key: str(value) for key, value in given.items() if value is not None}
    before = {key: spark.conf.get(key, None) for key in given}
    for key, value in given.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def stored(df: DataFrame, partitions: int | None = None, batch_bytes: int | None = None) -> DataFrame:
    """The same rows, written as a Parquet table to the shared folder; it goes when the session ends, or by discard().

    partitions: of the exchanges on the way, where the session's are too few. batch_bytes: of what goes to Python at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    # what is written needs no shuffle files any more
    given = {CLEANUP: "true", "spark.sql.shuffle.partitions": partitions, "spark.sql.execution.arrow.maxBytesPerBatch": batch_bytes}
    with settings(spark, given):
        df.write.parquet(path)
    _file_system(spark, path)[0].deleteOnExit(_file_system(spark, path)[1])
    collect_plans(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def collect_plans(spark: SparkSession) -> None:
    """Has the driver collect its garbage where its heap has grown over half of what it may take.

    What ends leaves its plans behind, and a heap that has room grows before it collects them: hundreds of small stages
    would take all of it, however little lives.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        spark._jvm.java.lang.System.gc()


def discard(*tables: DataFrame) -> None:
    """Removes tables of stored() that nothing reads any more."""
    for df in tables:
        fs, place = _file_system(df.sparkSession, df.stored_at)
        fs.delete(place, True)


def _file_system(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores on end as it takes to differ from df's columns in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slots(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the column ``text`` holds about ``limit`` bytes in each."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = batch.column("text").nbytes
        step = max(1, n if size <= limit else int(n * limit / size))
        for i in range(0, n, step):
            yield batch.slice(i, step)


def column_buffers(column: pa.Array) -> tuple:
    """(bytes of all values on end as a memory view, offsets as a list) of a string or binary array."""
    import numpy as np

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, kind, count=len(column) + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_text(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty) alone, whatever else the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
