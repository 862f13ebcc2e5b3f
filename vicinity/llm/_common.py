"""Helpers that the corpus operators share: durable intermediate tables, text slices, flat byte arrays."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Bytes of text that a Python worker turns into numpy arrays at a time (a longer text is one slice).
SLICE_BYTES = 1 << 18
#: Rows of an Arrow batch at most: batches wait in memory outside the heap, and rows here are whole texts.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder for intermediate tables; on one machine (a local master) a folder is made where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.split("[")[0] == "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="vicinity-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


#: Rows of a narrow table that a task writes, about.
ROWS_A_TASK = 100_000


def durable(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage of a narrow table: it is written to the shared folder and cleaned with its last reference.

    ``rows``, the number expected, keeps a small table from becoming a file for each of many shuffle partitions.
    """
    shared_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_TASK)))).checkpoint(eager=True)


_tables: list[str] = []


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """A wide table, written as Parquet under the shared folder and read again; see ``drop_tables``."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables_so_far() -> int:
    """A mark for ``drop_tables``."""
    return len(_tables)


def drop_tables(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the tables of ``written`` that were made after a mark, but for the last ``keep``, once no result that
    reads them is needed any more."""
    for place in _tables[since : len(_tables) - keep]:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _tables.remove(place)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand in every worker, in batches that fit whole texts."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    ship(spark)
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))

    def run(batches):
        yield from function(batches)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives what a task has freed back to the system: Python workers are used again and would keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of the table has (Spark takes names without regard to case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while (name := f"_{name}").lower() in taken:
            pass
        taken.add(name.lower())
        out.append(name)
    return out


def tidy(spark: SparkSession) -> None:
    """Gives the driver's memory back, after a fit or between the parts of a long plan: both its processes keep what
    they once took, and Spark lets go of finished shuffles, broadcasts and checkpoints when its collector runs."""
    release()
    spark._jvm.System.gc()


def whole_text(text: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text), F.lit(""))


def slices(batch, column: str, limit: int = SLICE_BYTES, rows: int = 1024) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow batch whose texts have about ``limit`` bytes together, and ``rows`` rows at most."""
    offsets = text_offsets(batch.column(column))
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = min(n, start + rows, max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1))
        yield start, stop
        start = stop


def text_offsets(column) -> np.ndarray:
    """UTF-8 offsets of a string or binary Arrow column, nulls as empty."""
    import pyarrow.compute as pc

    return np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))))


def flat_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string or binary Arrow column end to end, and the offsets of its rows."""
    import pyarrow as pa

    offsets = text_offsets(column)
    kind = pa.large_binary()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    joined = column.cast(kind) if not pa.types.is_large_binary(column.type) else column
    data = joined.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), offsets
    first = int(np.frombuffer(joined.buffers()[1], np.int64, 1, joined.offset * 8)[0]) if len(joined) else 0
    return np.frombuffer(data, np.uint8, int(offsets[-1]), first), offsets


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACES = mixed(np.arange(1, 257, dtype=np.uint64) * _MIX) | np.uint64(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes for which ``inside`` holds, never across rows: a 64-bit hash, the row and the length of each."""
    return word_places(data, offsets, inside)[:3]


def word_places(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same, and where each run starts."""
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    run = np.cumsum(begins)[inside] - 1
    at = np.flatnonzero(inside)
    place = at - starts[run]
    with np.errstate(over="ignore"):
        # bytes 256 apart in a word share a factor, so the place's turn enters the value as well
        value = (data[at].astype(np.uint64) + np.uint64(1) + (place >> 8).astype(np.uint64) * np.uint64(257)) * _PLACES[place & 255]
    first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    length = np.diff(np.append(first, len(run)))
    with np.errstate(over="ignore"):
        hashed = mixed(np.add.reduceat(value, first) + length.astype(np.uint64) * _MIX)
    return hashed, np.searchsorted(offsets, starts, "right") - 1, length, starts


def groups(batches, key: str) -> Iterator:
    """Tables of neighbouring Arrow rows with equal ``key``, across batches; the rows must come sorted by it."""
    import pyarrow as pa

    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and values[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = values[a]
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least member of each of ``n`` nodes' components under the given links."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        apart = a != b
        if not apart.any():
            break
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
    return root


#: Links of a node beyond which it counts as a hub, at least (what one task reads in a moment), and hubs of a round at
#: most (two numbers each are broadcast).
HUB = 100_000
HUBS = 16384


def _with_heads(rows: DataFrame, heads: DataFrame, links: int) -> DataFrame:
    """Rows (v, m) with their node's ``to`` from heads (v, to, n), each node once.

    Nodes with more than ``limit`` links are broadcast, so that their rows stay where they are; as a row is a link,
    there are at most ``HUBS`` of them, whatever the size. All other nodes are joined by a shuffle.
    """
    limit = max(HUB, -(-2 * links // HUBS))
    if 2 * links <= limit:  # no node can be a hub
        return rows.join(heads.select("v", "to"), "v")
    hubs = F.broadcast(heads.where(F.col("n") > limit).select("v", "to"))
    rest = rows.join(hubs.select("v"), "v", "left_anti").join(heads.where(F.col("n") <= limit).select("v", "to"), "v")
    return rows.join(hubs, "v").unionByName(rest)


def components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """Connected components of undirected links between numbers: every linked ``node`` and its component's least, ``root``.

    Alternates star operations over the distributed links until none changes; nothing but a checksum reaches the
    driver. Each round's links are checkpointed, minima are taken before the shuffle, and hubs are no hot keys.
    ``rows``: links expected.
    """
    links = durable(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).where("v > m").distinct(), rows)
    before = links.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "m"))).first()
    while True:
        both = links.unionByName(links.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.min("m").alias("to"), F.count("*").alias("n"))
        # large star: higher neighbours of a node link to its least neighbour or itself
        large = _with_heads(both.where("m > v"), least, before[0]).select(F.col("m").alias("v"), F.least("to", "v").alias("m"))
        large = large.distinct()
        # small star: lower neighbours and the node itself link to the least of them
        low = large.groupBy("v").agg(F.min("m").alias("to"), F.count("*").alias("n"))
        small = _with_heads(large, low, before[0]).select(F.col("m").alias("v"), F.col("to").alias("m")).unionByName(low.select("v", F.col("to").alias("m")))
        links = durable(small.where("v > m").distinct(), before[0])
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "m"))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("v").alias("node"), F.col("m").alias("root")).unionByName(links.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())
