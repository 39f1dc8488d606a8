"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that setting is missing (tests on one machine) is a local
    temporary folder used and recorded in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession) -> None:
    """Batches of whole texts that go to Python are bounded by their rows and bytes, so a worker's memory is too."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage by writing `df` as a Parquet table in the shared folder."""
    bound_batches(df.sparkSession)
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table that materialize() wrote and that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.startswith((shared_root(spark), shared_root(spark).replace("file://", "file:"))):
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished steps now; it does so when the driver's JVM collects what referred to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """mapInArrow for functions of one record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def row_struct(df: DataFrame, name: str = "row") -> F.Column:
    """All columns as one struct, so that no added column can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def trim() -> None:
    """Gives a worker's unused memory back to the system, which an idle worker would keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system's C library has it
        ctypes.CDLL(None).malloc_trim(0)


def free_caches() -> None:
    """In a worker that has tokenized before: drop the token caches."""
    tokens = sys.modules.get(f"{__package__}.tokens")
    if tokens is not None and tokens.release():
        trim()


def freed(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`fn`, a function for mapInArrow, which gives its worker's memory back when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            trim()

    return run


def packed(df: DataFrame, text: str = "text", level: int = 1) -> DataFrame:
    """`df` with its string column `text` as zstandard frames in `packed`, null as null: half of what a shuffle would write of it."""
    import zstandard

    others = [c for c in df.columns if c != text]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        z = zstandard.ZstdCompressor(level=level)
        out = [None if t is None else z.compress(t) for t in (x.as_buffer() if x.is_valid else None for x in batch.column(text))]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(out, pa.binary())], [*others, "packed"])

    schema = T.StructType([*[df.schema[c] for c in others], T.StructField("packed", T.BinaryType())])
    return map_arrow(df.select(*others, text), run, schema)


def unpack(frames: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each frame, one at a time; nothing for null."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    for x in frames:
        yield z.decompress(x.as_py()) if x.is_valid else b""


def utf8(value: str | None) -> bytes:
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def file_system(uri: str):
    """(pyarrow file system, path in it) of a file in the shared folder; file, hdfs, s3 and gs are known."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("/"):
        uri = uri.replace("file:", "file://", 1)
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> str:
    system, path = file_system(uri)
    system.create_dir(path, recursive=True)
    return uri
