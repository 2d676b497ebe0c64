"""Packing of tokenized documents into fixed windows by best-fit decreasing."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from cohortry.llm.common import Scratch, freed, ready, text_pieces

WINDOW = 4096
# Pieces that one packing task should hold; the number of tasks follows the table.
GROUP_PIECES = 20_000
# Words a worker meets before it forgets those not met since as many ago, and texts tokenized at a time.
WORDS, PIECE_BYTES = 150_000, 1 << 20


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit words."""
    return struct.pack(f"<{len(ids)}I", *ids)


class WordTokenizer:
    """Token ids of texts, with the ids of words seen before looked up.

    Tokens of this vocabulary never cross white space, so a text's ids are those
    of its words in a row. Texts outside Latin-1, whose case and composed forms are
    less plain, and texts with the marks of special tokens go to the tokenizer
    whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        # Byte-level models read every byte as a visible character: printable ones as themselves, the others from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        others = [b for b in range(256) if b not in plain]
        self.visible = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: bytes) -> bytes | None:
        """Ids of a word of letters, which is one piece for the model, perhaps with a mark after it; None for others."""
        text = word.decode("latin-1")
        if text.isalpha():
            shown = text if text.isascii() else text.encode("utf-8").decode("latin-1").translate(self.visible)
            return _packed([t.id for t in self.tokenize(shown)])
        if len(text) > 1 and text[:-1].isalpha() and text[-1] in ".,;:!?":
            both = [self.known.get(word[:-1]) or self._word(word[:-1]), self.known.get(word[-1:]) or self._whole([text[-1]])[0].astype("<u4").tobytes()]
            self.known[word[:-1]], self.known[word[-1:]] = both
            return both[0] + both[1]
        return None

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        split: list[tuple[int, list[bytes]]] = []
        whole: list[int] = []
        for i, text in enumerate(texts):
            try:
                words = None if "<|" in text else text.lower().encode("latin-1").split()
            except UnicodeEncodeError:
                words = None
            if words is None:
                whole.append(i)
            else:
                split.append((i, words))
        if len(self.known) > WORDS:
            self.known, self.older = {}, self.known
        new = list(set(chain.from_iterable(w for _, w in split)) - self.known.keys())
        rest = []
        for word in new:
            found = self.older.get(word) or self._word(word)
            if found is None:
                rest.append(word)
            else:
                self.known[word] = found
        for low in range(0, len(rest), 10_000):
            some = rest[low:low + 10_000]
            for word, ids in zip(some, self._whole([w.decode("latin-1") for w in some])):
                self.known[word] = ids.astype("<u4").tobytes()
        for i, words in split:
            out[i] = np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4")
        for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = ids
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker process, kept between tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def cut_documents(docs: DataFrame, end_id: int = 2, window: int = WINDOW, path: str | None = None,
                  key: str = "doc_id", text: str = "text", emit: Sequence[str] = ("ids",)) -> DataFrame:
    """Pieces ``(doc_id, start, length, doc_tokens)`` of every document, and what ``emit`` asks for.

    ``ids`` are the token ids, ``ids_crc32`` the unsigned CRC-32 of them as
    little-endian unsigned 32-bit words; where only checksums are wanted, no ids
    leave the task.

    A document is its token ids and then ``end_id``; a null or empty text is
    ``end_id`` alone. Documents longer than a window are cut into full windows
    from their start; the rest, if any, is the last piece. Rows may repeat or
    lack a key: every row is cut on its own.
    """
    ready(docs.sparkSession)
    path = path or public_tokenizers.path("word_bpe_49k.json")
    kinds = {"ids": "array<int>", "ids_crc32": "long"}
    schema = "doc_id long, start long, length long, doc_tokens long" + "".join(f", {c} {kinds[c]}" for c in emit)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            keys, at = batch.column(0).to_pylist(), 0
            for piece in text_pieces(batch.column(1), PIECE_BYTES):
                doc, start, length, total, flat = [], [], [], [], []
                for k, ids in zip(keys[at:at + len(piece)], tokenizer.ids([t or "" for t in piece.to_pylist()])):
                    n = len(ids) + 1
                    flat += [ids, np.array([end_id], np.uint32)]
                    for s in range(0, n, window):
                        doc.append(k)
                        start.append(s)
                        length.append(min(window, n - s))
                        total.append(n)
                ends, whole = np.cumsum([0, *length]), np.concatenate(flat).astype("<u4")
                more = {
                    "ids": lambda: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(whole.astype(np.int32))),
                    "ids_crc32": lambda: pa.array([zlib.crc32(whole[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])], pa.int64()),
                }
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()),
                     *[more[c]() for c in emit]], names=["doc_id", "start", "length", "doc_tokens", *emit])
                at += len(piece)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).mapInArrow(
        freed(cut), schema)


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree that finds the tightest one for a piece.

    A node holds how many windows are open below it. The tightest window is the
    first open capacity at or above the length.
    """

    def __init__(self, window: int):
        self.leaves = 1 << (window).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        if capacity:
            self.open[capacity].append(window)
            self._change(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The tightest open window that holds ``length``: its capacity and number."""
        node = length + self.leaves
        if not self.count[node]:
            while True:
                if node == 1:
                    return None
                if node % 2 == 0 and self.count[node + 1]:
                    node += 1
                    break
                node >>= 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._change(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset of every piece: longest first, each into the tightest window that is open."""
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = OpenWindows(window), 0
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        found = tree.take(length)
        if found is None:
            found = (window, opened)
            opened += 1
        capacity, place[i] = found
        offset[i] = window - capacity
        tree.put(capacity - length, int(place[i]))
    return place, offset


def pack_pieces(pieces: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (gapless from 0 in each sequence).

    Equal pieces are counted first, and each copy then goes to a group by a hash
    of all it holds and its number among the copies: neither an id that many rows
    share or lack nor a text that stands often makes a group larger. The pieces
    set the number of groups, so that a group stays at about GROUP_PIECES at every
    size and wastes at most a part of its last windows. A sequence id is the
    group's number and the window's. The pieces are stored once, not cut twice.
    """
    columns = pieces.columns
    counted = scratch.store(pieces.groupBy(*columns).agg(F.count("*").alias("_copies")))
    total = counted.agg(F.sum("_copies")).first()[0] or 0
    groups = max(1, -(-total // GROUP_PIECES))
    # In two steps, so that no array is as long as a text is frequent.
    step = F.lit(GROUP_PIECES).cast("long")
    chunk = counted.withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"), step)))
    copies = chunk.withColumn("_copy", F.explode(F.sequence(F.col("_from"), F.least(F.col("_copies"), F.col("_from") + step - 1))))
    dealt = copies.select(*columns, "_copy", F.xxhash64(*columns).alias("_tie")).withColumn("_group", F.pmod(F.xxhash64(*columns, "_copy"), F.lit(groups)))
    schema = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    keys = [(c, "ascending") for c in [*(c for c in columns if not isinstance(pieces.schema[c].dataType, ArrayType)), "_tie", "_copy"]]

    def pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, sort_keys=keys))
        place, offset = best_fit_decreasing(np.asarray(group["length"]), window)
        packed = group.select(columns).append_column("sequence_id", pa.array((key[0].as_py() << 32) + place))
        return packed.append_column("offset", pa.array(offset))

    return dealt.groupBy("_group").applyInArrow(pack, schema)
