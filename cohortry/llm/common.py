"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.session import broadcast_if_small, shared_folder  # noqa: F401

# The three-way split of the labelled rows: remainder 1 is never learned from.
FOLDS, HELD_OUT_FOLD = 3, 1

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# Arrow batches for Python workers: texts differ much in length, so bytes and not rows bound them.
BATCH_BYTES = 8 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver was started, and give them small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (_ROOT, known) if p)
    return spark


def freed(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task over Arrow batches that hands its memory back to the system when it ends.

    Workers are used again by later stages; without this each keeps the most it
    ever took.
    """
    @functools.wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library: it has no such call

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables of one run in the folder that all executors share.

    A stored table cuts the lineage like a checkpoint, survives lost executors,
    and tells the optimizer its true size. ``drop`` removes those that no later
    step reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}

    def store(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(stored)] = path
        return stored

    def drop(self, *tables: DataFrame) -> None:
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        for one in tables:
            path = self.paths.pop(id(one), None)
            if path is not None:
                place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(hadoop).delete(place, True)


def held_out(doc_id) -> F.Column:
    """True for the fold that nothing is learned from; a null id is held out too."""
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(True))


def bounded_sample(labelled: DataFrame, bound: int, *keys: str) -> DataFrame:
    """About ``bound`` rows per stratum of ``keys``, chosen by a hash of ``doc_id``.

    A count per stratum gives the rate, so the rows that stay do not depend on
    partitioning, and no row but those that stay is moved. Every text of a
    stratum smaller than the bound is taken.
    """
    counts = {tuple(r[k] for k in keys): r["n"] for r in labelled.groupBy(*keys).agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20))
    keep = F.lit(False)
    for values, n in counts.items():
        same = F.lit(True)
        for key, value in zip(keys, values):
            same = same & (F.col(key) == F.lit(value))
        keep = keep | (same & (draw < int((1 << 20) * min(1.0, bound / max(n, 1)))))
    return labelled.where(keep)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit words."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = random_words(11, 256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = np.ones(64, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    """Powers of a fixed odd multiplier, kept between calls."""
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, 2 * len(_POWERS)), np.uint64(0xD6E8FEB86659FD93))
            steps[0] = 1
            _POWERS = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (one more entry at the end)."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def text_pieces(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Slices of a text column, each of about ``size`` bytes (a longer text is a piece of its own)."""
    _, offsets = text_buffer(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield texts.slice(at, end - at)
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE,
                spans: bool = False) -> tuple[np.ndarray, ...]:
    """A 64-bit hash per word (maximal runs without white space, A-Z lowered), and the words before each text.

    ``spans`` adds where every word begins and ends. ``space`` says which bytes
    part words.
    """
    none = np.zeros(0, np.int64)
    empty = (np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    if not len(data):
        return (*empty, none, none) if spans else empty
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    if not len(starts):
        return (*empty, none, none) if spans else empty
    # Bytes before the first word count for no word; spaces inside the runs add nothing.
    run = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, run)
    with np.errstate(over="ignore"):
        value = _BYTE[_LOWER[data[starts[0]:]]]
        value *= _powers(int(run.max()) + 1)[place]
        value[~inside[starts[0]:]] = 0
        hashes = mix64(np.add.reduceat(value, starts - starts[0]))
    first = np.searchsorted(starts, offsets)
    if not spans:
        return hashes, first
    after = np.append(inside[1:], False)
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return hashes, first, starts, ends
