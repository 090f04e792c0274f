"""Shared pieces: working folders, byte-level word hashing, Arrow slicing and components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U64 = np.uint64
#: Most bytes of text that one vectorised step takes; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free(columns: list[str], *names: str) -> list[str]:
    """Each name, with as many underscores after it as it takes to differ from all columns, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` without its columns of these names, whatever their case; what takes their place is about to come."""
    gone = {n.lower() for n in names}
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in gone))


def schema_with(docs: DataFrame, more: str) -> StructType:
    """The schema of ``docs`` and the columns of the DDL string ``more``."""
    return StructType([*docs.schema.fields, *StructType.fromDDL(more).fields])


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local master gets a folder of this process, as in tests;
    on a cluster no machine-local folder can stand in, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Workspace:
    """A folder for intermediate tables in the shared checkpoint folder of the cluster.

    Tables cut lineage: whatever reads them again after an executor is lost reads files that all executors share.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/tidemark-{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more, and lets Spark delete the shuffle files behind them."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        free_shuffles(self.spark)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files go only when the driver's JVM collects the plans that own them."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def shrink_heaps(spark: SparkSession) -> None:
    """Executors' heaps grow while something runs and stay as large beside whatever Python workers come next; a full
    collection returns what is free to the system. One task for each core reaches all executors unless others are busy."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.call_function("reflect", F.lit("java.lang.System"), F.lit("gc"))).collect()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Inside, what runs hands Python so many rows at most at a time. A batch of whole texts lies in the memory of both the
    JVM, whose buffers double as they grow, and of the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lean(run):
    """``run``, a function for mapInArrow, after whose last batch the worker gives memory back to the system: an idle
    worker lives on for a while beside what runs next."""

    def then_free(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
        if trim is not None:
            trim(0)

    return then_free


def slices(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``most`` bytes of text each, or one longer row."""
    array = batch.column(column)
    if not len(array):
        return
    ends = np.cumsum(np.maximum(pc.binary_length(array).fill_null(0).to_numpy(zero_copy_only=False), 1))
    at = 0
    while at < len(array):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offsets of its rows; null counts as empty."""
    array = array.fill_null("") if array.null_count else array
    wide = pa.types.is_large_string(array.type)
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = U64(0x9E3779B97F4A7C15)
_BACK = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_BYTE = _BYTE[_LOWER]
_powers: dict[str, np.ndarray] = {}


def powers(base: np.uint64, name: str, n: int) -> np.ndarray:
    """base ** 0, 1, ... n-1 modulo 2 ** 64; kept up to a bounded length."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 4096), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= STEP_BYTES + 1:
            _powers[name] = have
    return have[:n]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """H with H[0] = 0; (H[e] - H[s]) * back-power(s) is the hash of codes[s:e]."""
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * powers(_BASE, "base", len(codes)), out=out[1:])
    return out


#: White space that ends a word: 0x20 and 0x09 to 0x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of each row's first word (one more entry at the end)."""
    gap = separator[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets[:-1]] = True
    before = np.empty(len(data), dtype=bool)
    if len(data):
        before[0] = True
        before[1:] = gap[:-1]
    begins = ~gap & (before | first[:-1])
    starts = np.flatnonzero(begins)
    last = np.empty(len(data), dtype=bool)
    if len(data):
        last[-1] = True
        last[:-1] = gap[1:] | first[1:-1]
    ends = np.flatnonzero(~gap & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words with A-Z in lower case."""
    h = prefix_hash(_LOWER_BYTE[data])
    return mix((h[ends] - h[starts]) * powers(_BACK, "back", len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def run_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of codes[i : i + width] for each i that has so many."""
    n = len(codes) - width + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(width if n > 0 else 0):
        out += codes[j : j + n] * U64(pow(0xD6E8FEB86659FD93, j + 1, 2**64))
    return mix(out)


def shingles(array: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each row's word shingles; of fewer words, the whole sequence is one."""
    data, offsets = text_bytes(array)
    starts, ends, first = words(data, offsets)
    codes = word_hashes(data, starts, ends)
    runs = run_hashes(codes, width)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            yield run_hashes(codes[a:b], int(b - a)) ^ U64(b - a)
        else:
            yield np.zeros(0, np.uint64)


def connected_components(ws: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, component) for each end of an edge (a, b); component is the smallest id that can be reached.

    In a round every node takes its least neighbour as parent. Along parents every second id only falls, so the only
    cycles are pairs, and the lesser of a pair is the least id of its tree. Pointer jumping finds these roots, and the
    edges between trees make the next round's graph. A tree has two nodes at least: n nodes take at most log2 n rounds,
    of at most log2 n jumps, whatever the order of ids. All is written to the shared folder, and only whether something
    is left reaches the driver. The least of neighbours is combined before it is shuffled, so a hub is no burden for
    one task.
    """
    left = ws.save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges-0")
    labels, k = None, 0
    while True:
        least = ws.save(left.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to")), f"{name}-least-{k}")
        after = least.select(F.col("id").alias("to"), F.col("to").alias("then"))
        trees = ws.save(least.join(after, "to").select("id", F.when((F.col("then") == F.col("id")) & (F.col("id") < F.col("to")), F.col("id")).otherwise(F.col("to")).alias("to")), f"{name}-trees-{k}-0")
        used, j = [f"{name}-edges-{k}", f"{name}-least-{k}"], 0
        while True:
            after = trees.select(F.col("id").alias("to"), F.col("to").alias("then"))
            now = ws.save(trees.join(after, "to").select("id", F.col("to").alias("old"), F.col("then").alias("to")), f"{name}-trees-{k}-{j + 1}")
            used.append(f"{name}-trees-{k}-{j}")
            j += 1
            trees = now.select("id", "to")
            if not now.where("old <> to").limit(1).count():
                break
        used.append(f"{name}-trees-{k}-{j}")
        if labels is None:
            labels = ws.save(trees.withColumnRenamed("to", "component"), f"{name}-{k}")
        else:
            further = trees.select(F.col("id").alias("component"), "to")
            labels = ws.save(labels.join(further, "component", "left").select("id", F.coalesce("to", "component").alias("component")), f"{name}-{k}")
            used.append(f"{name}-{k - 1}")
        a, b = trees.select(F.col("id").alias("a"), F.col("to").alias("at")), trees.select(F.col("id").alias("b"), F.col("to").alias("bt"))
        left = ws.save(left.join(a, "a").join(b, "b").where("at <> bt").select(F.col("at").alias("a"), F.col("bt").alias("b")).distinct(), f"{name}-edges-{k + 1}")
        more = left.limit(1).count()
        ws.drop(*used, *([] if more else [f"{name}-edges-{k + 1}"]))
        if not more:
            return labels
        k += 1
