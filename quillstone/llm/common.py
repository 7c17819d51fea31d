"""Shared helpers: durable scratch tables, Arrow mapping and hashing.

Iterative operators cut their lineage with *written tables* in the folder that
the cluster names in ``spark.checkpoint.dir``; a lost executor then costs a
re-read, never a rebuild.  Nothing here keeps state on one machine's disk
unless Spark itself runs on one machine.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a purely local master may fall back to a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/quillstone"
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="quillstone-")
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return f"file://{_LOCAL[app]}"


#: Spark's own switch: shuffle files are deleted at the end of the SQL execution that wrote them.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Scratch:
    """Written tables of one operator call.

    :meth:`drop` and :meth:`release` delete what is no longer read; what a lazy
    result still reads goes when the session's file systems close.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.held: set[str] = set()
        path, fs = self._at(self.root)
        fs.deleteOnExit(path)

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, tag: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{tag}"

    def save(self, df: DataFrame, tag: str, *, free: bool = False) -> DataFrame:
        """Write ``df`` once and return a reader of the written table.

        ``free``: the shuffle files go when it is written, not when the driver happens to collect garbage.
        """
        path = self.path(tag)
        with _setting(self.spark, FREE_SHUFFLES, "true") if free else contextlib.nullcontext():
            df.write.option("compression", "zstd").parquet(path)
        self.held.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables made by :meth:`save` that nothing will read again."""
        for t in tables:
            path, fs = self._at(t._scratch_path)
            fs.delete(path, True)
            self.held.discard(t._scratch_path)

    def release(self, *keep: DataFrame) -> None:
        """Delete every saved table but those of ``keep``."""
        for gone in self.held - {t._scratch_path for t in keep}:
            path, fs = self._at(gone)
            fs.delete(path, True)
            self.held.discard(gone)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, columns: list[str], max_bytes: int = 8 << 20, max_rows: int = 4096):
    """Cut Arrow batches into dicts of column -> list, of bounded size.

    ``max_bytes`` bounds what the variable-length columns of a slice hold; a
    single value above it has a slice of its own.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.full(n, 8 * batch.num_columns, np.int64)
        for column in batch.columns:
            if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) or pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            elif pa.types.is_list(column.type):
                sizes += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + max_bytes, "right"))
            to = min(max(to, at + 1), at + max_rows, n)
            part = batch.slice(at, to - at)
            yield {c: part.column(part.schema.get_field_index(c)).to_pylist() for c in columns}
            at = to
    trim()


def trim() -> None:
    """Give what a worker has freed back to the system: idle workers share an executor's memory with those of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def to_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    A table in fewer splits than cores is small; a larger one is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shards_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Number of tasks so that each takes about ``per_task`` rows."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows // per_task))


def may_be_least(hashed, total: int, most: int):
    """Whether a row can be among the ``most`` of smallest 64-bit hash of ``total``, but for a chance of no account.

    A limit on ordered rows sends ``most`` of each task to the driver; with this before it, some 1.5 times ``most`` in all.
    """
    share = (1.5 * most + 100) / max(total, 1)
    return F.lit(True) if share >= 1 else hashed < F.lit(int(share * 2**64) - 2**63)


def held_out_expr(doc_id: str = "doc_id"):
    """True for the fifth of documents that language models never learn from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 1
