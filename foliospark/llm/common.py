"""Shared plumbing: table access, shared-folder tables, Arrow batch helpers, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of strings and binaries, handed to Python code at once; a row larger than that comes alone. Word
#: lists take some ten times the bytes of their texts, so a worker's memory is bounded by rows' own size alone.
SLICE_ROWS = 2048
SLICE_BYTES = 1 << 20
#: The byte whitespace that separates words in every operator here.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session in one process (tests) gets a local one if none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='foliospark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by materialize()."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


#: Bytes of strings and binaries that a broadcast table has at most.
BROADCAST_BYTES = 32 << 20


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint where counts of rows and bytes prove df small, else df itself (a shuffled join follows)."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    size = F.sum(sum(texts, F.lit(0)).cast("long")) if texts else F.lit(0)
    found = df.limit(max_rows + 1).agg(F.count("*").alias("rows"), size.alias("bytes")).first()
    return F.broadcast(df) if found["rows"] <= max_rows and (found["bytes"] or 0) <= BROADCAST_BYTES else df


def _sizes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of strings and binaries in each row."""
    out = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            out += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
            out += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each part has at most ``rows`` rows and, but for a single longer one, ``size`` bytes."""
    for batch in batches:
        ends = np.cumsum(_sizes(batch))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(int(np.searchsorted(ends, before + size, "right")), at + rows)
            to = max(to, at + 1)
            yield batch.slice(at, to - at)
            at = to


def _release() -> None:
    """Give what a finished task has freed back to the system: workers are kept for later tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


#: Rows and bytes of the batches that Spark hands to Python workers; the session's own settings where they are less.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2048, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow with batches that are bounded in bytes, in workers that keep no memory after a task."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    for name, most in BATCH.items():
        now = df.sparkSession.conf.get(name)
        if not now.isdigit() or not 0 < int(now) <= most:  # with a unit or without bound
            df.sparkSession.conf.set(name, most)
    return df.mapInArrow(tidy, schema)


def arrow_map(df: DataFrame, schema: str, step: Callable, setup: Callable | None = None, rows: int = SLICE_ROWS) -> DataFrame:
    """Map slices of df to dicts of columns. setup() runs once per task and its result goes to step(state, batch)."""

    def run(batches):
        state = setup() if setup else None
        for part in slices(batches, rows):
            out = step(state, part)
            if out is not None:
                yield pa.RecordBatch.from_pydict(out, schema=fields)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema))
    return map_batches(df, run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [x if x is not None else "" for x in batch.column(name).to_pylist()]
