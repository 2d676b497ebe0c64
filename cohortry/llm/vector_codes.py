"""Product-quantization codes of vectors, trained by active-entry Lloyd rounds in exact integers.

Every component ``x`` becomes the integer ``floor(scale * x)``; a vector is cut
into equal consecutive parts, and each part position has a codebook of its own.
A round assigns every part to the nearest entry (squared distance, ties to the
lower index) and then moves each entry to the floor of its parts' mean.

Most parts keep their entry after the first rounds, so each part carries its
entry and the exact distance to it. In the next round a part whose entry did not
move compares that stored distance with the moved entries alone: the others are
as far away as before, and lost then. Only a part whose own entry moved is
compared with all of them again.

The vectors stay where they are. A round reads the state of the round before,
writes the new one to the shared folder together with one row of sums per task,
and only those sums (parts x entries) come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from cohortry.llm.common import Scratch, broadcast_if_small, freed, ready

# Squared distances of a part, between integers up to R apart from zero, are at most 4 R^2 times its components; below
# 2^62 they fit a long.
_EXACT_BITS = 62

# Vectors in one piece of work: 4,096 of 1,024 dimensions are 32 MB of integers.
PIECE = 4096

LAST_LONG = 2**63 - 1


@dataclass(frozen=True)
class Codebooks:
    """``entries[part][index]`` are the integer components of an entry; Python integers, so of any size."""

    entries: tuple[tuple[tuple[int, ...], ...], ...]

    @property
    def parts(self) -> int:
        return len(self.entries)

    def digest(self) -> str:
        """SHA-256 of all components in decimal by part, entry and position, joined by commas."""
        flat = (str(x) for part in self.entries for entry in part for x in entry)
        return hashlib.sha256(",".join(flat).encode()).hexdigest()

    def moved_from(self, before: Codebooks) -> np.ndarray:
        """Which entries differ, as ``[part, index]``."""
        return np.array([[a != b for a, b in zip(p, q)] for p, q in zip(self.entries, before.entries)], dtype=bool)


def _usable(vector: str) -> F.Column:
    """Not null, not empty, and every component a finite number."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def _integers(values: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """``floor(scale * x)``; Python integers where 64 bits could overflow."""
    if not wide:
        return np.floor(values * float(scale)).astype(np.int64)
    out = np.empty(values.size, dtype=object)
    out[:] = [n * scale // m for n, m in (x.as_integer_ratio() for x in values.ravel().tolist())]
    return out.reshape(values.shape)


def _distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """``[row, entry]`` squared distances of one part position."""
    out = np.empty((len(parts), len(entries)), dtype=parts.dtype)
    for i, entry in enumerate(entries):
        gap = parts - entry
        out[:, i] = (gap * gap).sum(axis=1)
    return out


def assign(ints: np.ndarray, book: np.ndarray, codes: np.ndarray | None, far: np.ndarray | None,
           moved: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entries ``[row, part]``, their exact distances, and the number of distances computed.

    ``ints`` is ``[row, part, position]``, ``book`` ``[part, entry, position]``.
    Without ``codes`` every part is compared with every entry.
    """
    n, parts, _ = ints.shape
    k = book.shape[1]
    if codes is None:
        codes, far = np.zeros((n, parts), np.uint8), np.zeros((n, parts), ints.dtype)
        rescan = np.ones((n, parts), dtype=bool)
        active = [np.arange(0)] * parts
    else:
        codes, far = codes.copy(), far.copy()
        rescan = moved[np.arange(parts)[None, :], codes]
        active = [np.flatnonzero(moved[p]) for p in range(parts)]
    work = 0
    for p in range(parts):
        full = np.flatnonzero(rescan[:, p])
        if len(full):
            found = _distances(ints[full, p], book[p])
            best = found.argmin(axis=1)
            codes[full, p], far[full, p] = best, found[np.arange(len(full)), best]
            work += found.size
        rest = np.flatnonzero(~rescan[:, p])
        if len(rest) and len(active[p]):
            found = _distances(ints[rest, p], book[p, active[p]])
            best = found.argmin(axis=1)
            distance, entry = found[np.arange(len(rest)), best], active[p][best]
            held, own = far[rest, p], codes[rest, p]
            closer = (distance < held) | ((distance == held) & (entry < own))
            codes[rest, p], far[rest, p] = np.where(closer, entry, own), np.where(closer, distance, held)
            work += found.size
    return codes, far, work


class _Sums:
    """Counts and component sums of the parts of each entry."""

    def __init__(self, parts: int, k: int, width: int, wide: bool):
        self.count = np.zeros((parts, k), np.int64)
        self.total = np.zeros((parts, k, width), object if wide else np.int64)

    def add(self, ints: np.ndarray, codes: np.ndarray) -> None:
        k = self.count.shape[1]
        for p in range(ints.shape[1]):
            self.count[p] += np.bincount(codes[:, p], minlength=k)
            for i in np.unique(codes[:, p]):
                self.total[p, i] += ints[codes[:, p] == i, p].sum(axis=0)


def _fields(kind: pa.DataType, wide: bool) -> list[pa.Field]:
    """What a round keeps of a vector, then (null in those rows) the sums of a task for one entry."""
    exact = pa.string() if wide else pa.int64()
    return [pa.field("vec_id", pa.int64()), pa.field("label", pa.string()), pa.field("embedding", pa.list_(kind)),
            pa.field("codes", pa.binary()), pa.field("far", pa.list_(exact)), pa.field("error", pa.int64()),
            pa.field("part", pa.int32()), pa.field("entry", pa.int32()), pa.field("n", pa.int64()), pa.field("total", pa.list_(exact)), pa.field("work", pa.int64())]


_KEPT = 6


def _ragged(values: np.ndarray, wide: bool) -> pa.Array:
    """Rows of integers as a list column."""
    flat = pa.array([str(x) for x in values.ravel().tolist()]) if wide else pa.array(values.ravel().astype(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)


def _squares(column: pa.Array, parts: int, wide: bool) -> np.ndarray:
    if not wide:
        return np.asarray(column.flatten()).reshape(-1, parts)
    out = np.empty(len(column) * parts, dtype=object)
    out[:] = [int(x) for x in column.flatten().to_pylist()]
    return out.reshape(-1, parts)


def _round(book: Codebooks, scale: int, fields: list[pa.Field], wide: bool, moved: np.ndarray | None):
    """A task: state batches in, the new state out, and at the end the sums of all of it."""
    parts, width = book.parts, len(book.entries[0][0])
    dtype = object if wide else np.int64
    entries = np.array(book.entries, dtype=dtype)
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, work = _Sums(parts, entries.shape[1], width, wide), 0
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                piece = batch.slice(at, PIECE)
                values = np.asarray(piece["embedding"].flatten()).astype(float)
                ints = _integers(values, scale, wide).reshape(-1, parts, width)
                codes = far = None
                if moved is not None:
                    codes = np.frombuffer(b"".join(piece["codes"].to_pylist()), np.uint8).reshape(-1, parts)
                    far = _squares(piece["far"], parts, wide)
                codes, far, done = assign(ints, entries, codes, far, moved)
                work += done
                total.add(ints, codes)
                error = [min(int(x), LAST_LONG) for x in far.sum(axis=1).tolist()]
                kept = [piece["vec_id"], piece["label"], piece["embedding"].cast(fields[2].type), pa.array([r.tobytes() for r in codes], pa.binary()),
                        _ragged(far, wide), pa.array(error, pa.int64())]
                yield pa.RecordBatch.from_arrays(kept + [pa.nulls(piece.num_rows, f.type) for f in fields[_KEPT:]], schema=schema)
        p, i = np.nonzero(total.count)
        if len(p):
            given = [pa.array(p, pa.int32()), pa.array(i, pa.int32()), pa.array(total.count[p, i]), _ragged(total.total[p, i], wide),
                     pa.array([work] + [0] * (len(p) - 1), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(p), f.type) for f in fields[:_KEPT]] + given, schema=schema)

    return run


def first_entries(vectors: DataFrame, parts: int, entries: int, scale: int) -> Codebooks:
    """The parts of the vectors with the smallest ids, in that order (equal ids by their components, null ids last)."""
    chosen = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    ints = [_integers(np.array(row["embedding"], float), scale, True).tolist() for row in chosen]
    width = len(ints[0]) // parts
    return Codebooks(tuple(tuple(tuple(v[p * width:(p + 1) * width]) for v in ints) for p in range(parts)))


def _summed(written: DataFrame, width: int, wide: bool) -> tuple[dict, int]:
    """``{(part, entry): (count, component sums)}`` over all tasks, and the distances computed; both bounded by the codebooks."""
    sums = written.where("part is not null")
    if wide:
        # Integers of any size, one group of short rows (as many as there were tasks) per entry.
        def add(rows):
            total = [str(sum(map(int, column))) for column in zip(*rows["total"])]
            return rows.iloc[:1].assign(n=rows["n"].sum(), total=[total], work=rows["work"].sum())

        sums = sums.select("part", "entry", "n", "total", "work").groupBy("part", "entry").applyInPandas(add, "part int, entry int, n long, total array<string>, work long")
    else:
        exact = [F.sum(F.col("total")[i].cast("decimal(38,0)")).cast("string").alias(f"t{i}") for i in range(width)]
        sums = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.sum("work").alias("work"), *exact)
        sums = sums.select("part", "entry", "n", "work", F.array(*[f"t{i}" for i in range(width)]).alias("total"))
    rows = sums.collect()
    return {(r["part"], r["entry"]): (r["n"], [int(x) for x in r["total"]]) for r in rows}, sum(r["work"] for r in rows)


def moved_entries(book: Codebooks, sums: dict) -> Codebooks:
    """Each entry becomes the floor of its parts' mean; an entry without parts stays."""
    def entry(p: int, i: int) -> tuple[int, ...]:
        n, total = sums.get((p, i), (0, ()))
        return tuple(x // n for x in total) if n else book.entries[p][i]

    return Codebooks(tuple(tuple(entry(p, i) for i in range(len(part))) for p, part in enumerate(book.entries)))


def train_codes(vectors: DataFrame, scratch: Scratch, parts: int = 8, entries: int = 16, rounds: int = 6,
                scale: int = 4096) -> tuple[DataFrame | None, Codebooks | None, list[int]]:
    """Codes of all usable vectors of ``vectors(vec_id, embedding, label)``.

    Returns the coded rows ``(vec_id, label, embedding, codes, far, error)``,
    where ``codes`` has a byte per part, ``far`` the exact distances and
    ``error`` their sum (at most 2^63 - 1); the final codebooks; and how many
    distances each round computed. Vectors that are null or empty or hold null
    or non-finite components are left out; repeated rows and null ids count like
    any others. Vectors of different lengths, or of a length that ``parts`` does
    not divide, are an error. No usable vector gives ``(None, None, [])``.
    """
    ready(vectors.sparkSession)
    kept = vectors.where(_usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    reach = F.greatest(F.abs(F.array_max("embedding")), F.abs(F.array_min("embedding")))
    shape = kept.agg(F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most"), F.max(reach).alias("reach")).first()
    if shape["least"] is None:
        return None, None, []
    if shape["least"] != shape["most"] or shape["most"] % parts:
        raise ValueError(f"vectors of {shape['least']} to {shape['most']} components; {parts} equal parts need one length they divide")
    width = shape["most"] // parts
    wide = shape["reach"] * scale + 1 >= (2.0**_EXACT_BITS / (4 * width)) ** 0.5
    kind = kept.schema["embedding"].dataType.elementType
    fields = _fields(pa.float32() if isinstance(kind, T.FloatType) else pa.float64(), wide)
    ddl = T.StructType([T.StructField(f.name, from_arrow_type(f.type)) for f in fields])
    book, state, before, work = first_entries(kept, parts, entries, scale), kept, None, []
    for turn in range(rounds + 1):
        moved = None if before is None else book.moved_from(before)
        written = scratch.store(state.mapInArrow(freed(_round(book, scale, fields, wide, moved)), ddl))
        if turn:
            scratch.drop(last)
        last = written
        sums, done = _summed(written, width, wide)
        work.append(done)
        state = written.where("part is null").select(*[f.name for f in fields[:_KEPT]])
        if turn < rounds:
            before, book = book, moved_entries(book, sums)
    return state, book, work


def code_vectors(vectors: DataFrame, scratch: Scratch, **settings) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` per usable vector; an empty table gives no rows.

    ``label_error`` sums ``error`` over all rows of equal ``label`` (nulls
    together), at most 2^63 - 1. The sums of the labels are broadcast only after
    a count.
    """
    coded, book, _ = train_codes(vectors, scratch, **settings)
    if coded is None:
        empty = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], empty)
    most = F.lit(LAST_LONG).cast("decimal(38,0)")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    found = coded.join(broadcast_if_small(by_label), F.col("label").eqNullSafe(F.col("_label")))
    return found.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(book.digest()).alias("codebooks_sha256"))
