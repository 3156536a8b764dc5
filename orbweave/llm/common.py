"""Helpers that the corpus operators share."""

from __future__ import annotations

import bisect
import ctypes
import functools
import itertools
import tempfile
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Text is handed on in slices of about so many characters, so that a batch of
#: very long texts needs no more memory than a batch of short ones.
SLICE_CHARS = 4_000_000


#: Bytes of one Arrow batch that goes to a worker, where the session has Spark's default (64 MB):
#: a batch is in the JVM's and the worker's memory several times over.
ARROW_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """The frame, in a session whose Arrow batches are bounded by ARROW_BYTES unless it was told otherwise."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == "67108864b":
        conf.set(key, str(ARROW_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str | None) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE_CHARS of text each (one row at least)."""
    if column is None or batch.num_rows < 2:
        yield batch
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > SLICE_CHARS:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


_resident: dict[Hashable, object] = {}
_asked: set[Hashable] = set()


def resident(key: Hashable, make: Callable[[], object]):
    """What a worker keeps from one task to the next: the last such thing alone, and only
    as long as tasks ask for it, so that stages with models of their own don't add up
    in a worker that serves them all."""
    _asked.add(key)
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def made(make: Callable[[], object]):
    """What `make` gives; unless that asked for what the worker keeps, it keeps it no longer.
    (Tasks name this function only: what they name themselves would be sent with them.)"""
    _asked.clear()
    out = make()
    if not _asked:
        _resident.clear()
    return out


@functools.lru_cache(maxsize=1)
def _libc() -> ctypes.CDLL | None:
    """The C library, told to give large blocks back when they are freed; None where it isn't glibc."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        return None
    return libc


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


def map_columns(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]],
    schema: str,
    text: str | None = "text",
) -> DataFrame:
    """Map batches of rows to columns. `make` runs once in each task, so what it
    returns may keep state; that function gets slices of about SLICE_CHARS."""
    out: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _libc()
        step = made(make)
        for batch in batches:
            for part in slices(batch, text):
                if part.num_rows:
                    got = step(part)
                    yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)
        del step
        give_back()

    return bounded_batches(df).mapInArrow(run, out)


def map_sorted(
    df: DataFrame,
    keys: list[str],
    order: list,
    make: Callable[[], Callable[[pa.RecordBatch | None], dict[str, list]]],
    schema: str,
    text: str | None = None,
) -> DataFrame:
    """Like map_columns, over rows dealt by keys and sorted by keys and an order: a group's
    rows come one after the other, in as many batches as they take, so that its function
    need keep no more of a group than it wants. It is called with None at a partition's end."""
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return map_stream(dealt, make, schema, text)


def map_stream(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch | None], dict[str, list]]], schema: str, text: str | None = None) -> DataFrame:
    """Like map_columns; the function is called with None at a partition's end."""
    out: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = made(make)
        parts = (part for batch in batches for part in slices(batch, text) if part.num_rows)
        for part in itertools.chain(parts, [None]):
            got = step(part)
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    return bounded_batches(df).mapInArrow(run, out)


def portions(batch: list[str], chars: int) -> Iterator[list[str]]:
    """The texts in parts of about so many characters (one text at least)."""
    start, total = 0, 0
    for i, text in enumerate(batch):
        if i > start and total + len(text) > chars:
            yield batch[start:i]
            start, total = i, 0
        total += len(text)
    if batch:
        yield batch[start:]


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's values, null as the empty text."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def clear_of(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans (start, end) that overlap none of those taken."""
    if not spans or not taken:
        return spans
    order = sorted(taken)
    starts = [a for a, _ in order]
    reach = list(itertools.accumulate((b for _, b in order), max))  # the greatest end up to each
    out = []
    for a, b in spans:
        before = bisect.bisect_left(starts, b)  # those that start before the span ends
        if not before or reach[before - 1] <= a:
            out.append((a, b))
    return out


def ascii_lower(text: str) -> bytes:
    """UTF-8 of a text with A-Z lower-cased and nothing else."""
    return text.encode().lower()


def splitmix(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit integers so that every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where none is set and all runs on this machine."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="orbweave-")
        sc.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, folder: str) -> DataFrame:
    """The table, written as Parquet and read again."""
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def removed(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches `at` of a flat array, one after the other, and where each ends."""
    n = sizes[at]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[at] - (ends - n), n) + np.arange(total)], ends


def distinct_parts(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of lists of strings: where each list starts and the last ends, each part's place among the distinct parts, and those."""
    parts = lists.flatten().dictionary_encode()
    sizes = np.asarray(pc.list_value_length(lists), np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), np.asarray(parts.indices, np.int64), parts.dictionary.to_pylist()


#: Ids that may be sent to every executor: 16 bytes each, so 16 MB at most.
BROADCAST_IDS = 1_000_000


def matching(df: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """df's rows whose `column` is among the ids (one column of that name, distinct,
    checkpointed). Up to BROADCAST_IDS of them are sent to all executors, so that
    df isn't shuffled; more meet df by a shuffle."""
    return df.join(broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, how)
