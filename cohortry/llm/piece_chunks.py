"""SentencePiece ids and back, by a table of distinct marked words.

SentencePiece writes white space as a marker in front of each word. Where no
piece of the vocabulary has a marker behind another character, no piece reaches
from one marked word into the next, and a text's ids are those of its words one
after the other. So the words of a block of documents are told apart once, each
distinct word is segmented (and its ids decoded) once by the model itself, and
every occurrence takes its ids from that table by position.

A block is a few megabytes of text inside one task: no text and no word is
shuffled, and a task holds one block and its table whatever the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortry.llm.common import freed, ready, text_buffer, text_pieces

# Text of a block in bytes; words repeat more often in a larger one.
BLOCK = 8 << 20

MARKER = "▁"

# What can be asked for per document.
EMITS = {
    "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(),
}


def separable(model) -> bool:
    """True if the model segments every marked word by itself.

    No piece may hold a marker behind another character, and texts must reach
    the pieces unchanged: one marker in front, one for each space.
    """
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            if MARKER in model.id_to_piece(i).lstrip(MARKER):
                return False
    probes = ("a", " a  b ", "ﬁ ①\tx\n", f"{MARKER}a{MARKER} b", "A\u0301 Å")

    def spelled(text: str) -> str:
        pieces = [(model.id_to_piece(i), model.is_byte(i)) for i in model.encode(text)]
        return b"".join(bytes([int(p[3:5], 16)]) if byte else p.encode() for p, byte in pieces).decode(errors="replace")

    return all(spelled(p) == MARKER + p.replace(" ", MARKER) for p in probes) and model.encode("") == []


def marked_words(texts: pa.Array, whole: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The marked words of all texts in a row, and the words before each text (one more entry at the end).

    A word is a run of markers (spaces) and what follows up to the next one; the
    marker in front of every text is added. A null or empty text has no word.
    ``whole`` takes each text as one word.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
    data, offsets = text_buffer(marked)
    if not len(data):
        return pa.array([], pa.large_string()), np.zeros(len(offsets), np.int64)
    opens = np.zeros(len(data), dtype=bool)
    begins = offsets[:-1][np.diff(offsets) > 0]
    if not whole:
        mark = data == 0x20
        closes = mark.copy()
        wide = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
        mark[wide], closes[wide + 2] = True, True
        opens[1:] = mark[1:] & ~closes[:-1]
    opens[begins] = True
    starts = np.flatnonzero(opens)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    return words, np.searchsorted(starts, offsets)


class Table:
    """The distinct words of a block: their ids, the ids in decimal, and what the ids decode to."""

    def __init__(self, model, words: pa.Array):
        self.eos = model.eos_id()
        listed = words.to_pylist()
        rest = [w[1:] for w in listed]
        ids = model.encode(rest, num_threads=1) if rest else []
        # The marker alone: the model adds it to any text but the empty one.
        alone = [model.piece_to_id(MARKER)]
        ids = [found if text else alone for found, text in zip(ids, rest)]
        self.decoded = [" " + text for text in (model.decode(ids) if ids else [])] + [""]
        ids.append([self.eos])
        self.text = [" ".join(map(str, found)) for found in ids]
        self.lengths = np.array([len(found) for found in ids], np.int64)
        self.ids = np.array([i for found in ids for i in found], np.int32)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def gather(self, words: np.ndarray) -> np.ndarray:
        """The ids of a row of words, by position."""
        lengths = self.lengths[words]
        total = int(lengths.sum())
        return self.ids[np.repeat(self.starts[words] - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)]


def encode_block(model, texts: pa.Array, emit: Sequence[str], whole: bool = False) -> dict[str, pa.Array]:
    """The asked columns for some texts, each distinct word segmented once."""
    words, first = marked_words(texts, whole)
    coded = words.dictionary_encode()
    table = Table(model, coded.dictionary)
    # Every document ends with one more entry of the table: the end id.
    places = np.insert(np.asarray(coded.indices).astype(np.int64), first[1:], len(table.text) - 1)
    ends = first + np.arange(len(first))
    tokens = np.concatenate([[0], np.cumsum(table.lengths[places])])[ends]
    out = {}
    if "n_tokens" in emit:
        out["n_tokens"] = pa.array(np.diff(tokens))
    if "ids" in emit:
        out["ids"] = pa.ListArray.from_arrays(pa.array(tokens.astype(np.int32)), pa.array(table.gather(places)))

    def joined(parts: list[str], separator: str) -> tuple[np.ndarray, np.ndarray]:
        taken = pa.array(parts, pa.large_string()).take(pa.array(places))
        rows = pa.LargeListArray.from_arrays(pa.array(ends.astype(np.int64)), taken)
        return text_buffer(pc.binary_join(rows, pa.scalar(separator, pa.large_string())))

    def hashed(data: np.ndarray, at: np.ndarray, skip: int = 0) -> pa.Array:
        view = memoryview(np.ascontiguousarray(data))
        return pa.array([hashlib.sha256(view[min(a + skip, b):b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.string())

    if "ids_sha256" in emit:
        out["ids_sha256"] = hashed(*joined(table.text, " "))
    if "decoded" in emit or "decoded_sha256" in emit:
        # The model drops the marker it put in front of the text.
        data, at = joined(table.decoded, "")
        if "decoded_sha256" in emit:
            out["decoded_sha256"] = hashed(data, at, 1)
        if "decoded" in emit:
            out["decoded"] = pa.array([bytes(data[min(a + 1, b):b]).decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.string())
    return out


def encode_documents(docs: DataFrame, path: str, emit: Sequence[str] = ("ids",), text: str = "text", block: int = BLOCK) -> DataFrame:
    """Add the columns of ``emit`` (names of ``EMITS``) to ``docs``: ids with an end id, and what they decode to.

    ``path`` is a SentencePiece model file the driver can read; tasks get its
    bytes. A null or empty text has the end id only and decodes to nothing.
    Repeated rows and any ids count like others; columns of ``docs`` that bear
    an emitted name are replaced; an empty table gives no rows. A model whose
    pieces may cross words segments whole texts, each distinct one of a block
    once.
    """
    ready(docs.sparkSession)
    import sentencepiece

    with open(path, "rb") as file:
        proto = file.read()
    whole = not separable(sentencepiece.SentencePieceProcessor(model_proto=proto))
    kept = [c for c in docs.columns if c not in emit or c == text]
    schema = T.StructType([docs.schema[c] for c in kept if c not in emit] + [T.StructField(c, EMITS[c]) for c in emit])
    arrow = to_arrow_schema(schema)
    held = [c for c in kept if c not in emit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        for batch in batches:
            at = 0
            for piece in text_pieces(batch[text], block):
                rows = batch.slice(at, len(piece))
                at += len(piece)
                found = encode_block(model, piece, emit, whole)
                columns = [rows[c].cast(arrow.field(c).type) for c in held] + [found[c].cast(arrow.field(c).type) for c in emit]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select(*kept).mapInArrow(freed(run), schema)


def decode_ids(rows: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Add the text that the model's own decoder gives for an array of ids; null for a null array."""
    ready(rows.sparkSession)
    with open(path, "rb") as file:
        proto = file.read()

    @F.pandas_udf("string")
    def decoded(column):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        return column.map(lambda one: None if one is None else model.decode([int(i) for i in one]))

    return rows.withColumn(name, decoded(F.col(ids)))
