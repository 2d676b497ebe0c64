"""Language identification with hyperdimensional n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import bounded_sample, freed, random_words, ready

# Dimensions of a vector, and the letters of an n-gram.
DIMENSIONS, GRAM = 512, 3
# Letter classes: 0 is the gap between words, then a-z, then the lower-case Latin-1
# letters from U+00DF on; any other letter is hashed to one of the last five.
CLASSES = 64
# Documents per language that profiles are learned from, chosen by a hash of the id.
SAMPLE = 4000
# Texts of one Arrow batch are profiled in pieces of about so many characters.
PIECE_CHARS = 1 << 20


def letter_vectors() -> np.ndarray:
    """A random vector of +1 and -1 for each letter class."""
    bits = np.unpackbits(random_words(17, CLASSES * DIMENSIONS // 64).view(np.uint8))
    return (bits.reshape(CLASSES, DIMENSIONS).astype(np.int8) * 2 - 1)


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """Bound vectors of trigrams: the first letter permuted twice, the second once, multiplied with the third."""
    letters = letter_vectors()
    a, b, c = codes // (CLASSES * CLASSES), codes // CLASSES % CLASSES, codes % CLASSES
    return (np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]).astype(np.float32)


def _letter_table() -> np.ndarray:
    """Letter class of every code point below 0x10000 (letters beyond are classed one by one)."""
    table = np.zeros(0x10000, np.uint8)
    for point in range(0x10000):
        letter = chr(point)
        if letter.isalpha():
            low = letter.lower()[0]
            at = ord(low)
            if 97 <= at <= 122:
                table[point] = at - 96
            elif 0xDF <= at <= 0xFF:
                table[point] = 27 + at - 0xDF
            else:
                table[point] = 59 + at % 5
    return table


_TABLE: np.ndarray | None = None


def letter_classes(text: str) -> np.ndarray:
    """The letter class of every character; characters that are no letters are gaps."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _letter_table()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = _TABLE[np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    if len(far):
        classes = classes.copy()
        classes[far] = [59 + int(p) % 5 if chr(p).isalpha() else 0 for p in points[far]]
    return classes


def profiles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bundled trigram vector of every text, and its number of letters.

    All texts of a piece are laid in one row with gaps between them; a matrix of
    trigram counts is multiplied with the vectors of the trigrams that occur.
    Runs of gaps count as one gap.
    """
    parts = [letter_classes(f" {t} ") for t in texts]
    classes = np.concatenate(parts).astype(np.int32)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    letters = np.bincount(owner[classes > 0], minlength=len(texts))
    keep = np.ones(len(classes), bool)
    keep[1:] = (classes[1:] > 0) | (classes[:-1] > 0)
    classes, owner = classes[keep], owner[keep]
    if len(classes) < GRAM:
        return np.zeros((len(texts), DIMENSIONS), np.float32), letters
    codes = (classes[:-2] * CLASSES + classes[1:-1]) * CLASSES + classes[2:]
    whole = (owner[:-2] == owner[2:]) & (classes[1:-1] > 0)
    codes, owner = codes[whole], owner[:-2][whole]
    known = np.zeros(CLASSES ** 3, bool)
    known[codes] = True
    found = np.flatnonzero(known)
    place = np.zeros(CLASSES ** 3, np.int32)
    place[found] = np.arange(len(found))
    counts = np.bincount(owner * len(found) + place[codes], minlength=len(texts) * len(found))
    return counts.reshape(len(texts), len(found)).astype(np.float32) @ gram_vectors(found), letters


def _pieces(texts: list[str]) -> Iterator[list[str]]:
    piece, size = [], 0
    for text in texts:
        if piece and (size + len(text) > PIECE_CHARS or len(piece) >= 256):
            yield piece
            piece, size = [], 0
        piece.append(text)
        size += len(text)
    if piece:
        yield piece


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per language the summed unit profiles of a partition."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for language, texts in batch.groupby("label")["text"]:
            for piece in _pieces(texts.tolist()):
                vectors, _ = profiles(piece)
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                total[language] = total.get(language, 0) + (vectors / np.maximum(norms, 1e-9)).sum(axis=0)
    for language, vector in total.items():
        yield pd.DataFrame({"label": language, "dimension": np.arange(DIMENSIONS), "value": vector.astype(float)})


def learn_prototypes(labelled: DataFrame, sample: int = SAMPLE, text: str = "text", label: str = "lang") -> dict[str, np.ndarray]:
    """A unit prototype per language: the bundle of the profiles of about ``sample`` labelled documents.

    Rows with a null text or label teach nothing. Partitions send sums, so what
    reaches the driver is one number per language and dimension.
    """
    ready(labelled.sparkSession)
    rows = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(text).alias("text"), F.col(label).alias("label"))
    chosen = bounded_sample(rows, sample, "label").select("text", "label")
    sums = chosen.mapInPandas(_sums, "label string, dimension int, value double").groupBy("label", "dimension").agg(F.sum("value").alias("value"))
    prototypes: dict[str, np.ndarray] = {}
    for row in sums.collect():
        prototypes.setdefault(row["label"], np.zeros(DIMENSIONS))[row["dimension"]] = row["value"]
    return {k: (v / n).astype(np.float32) for k, v in sorted(prototypes.items()) if (n := np.linalg.norm(v)) > 0}


def identify_languages(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (cosine with the nearest prototype, not below 0).

    A text that is null or has no letter, and any text where there are no
    prototypes, is ``und`` with score 0. Equal cosines go to the language that
    sorts first. Whole texts count. Own columns of these names are replaced.
    """
    ready(docs.sparkSession)
    names = list(prototypes)
    matrix = np.stack([prototypes[n] for n in names]) if names else np.zeros((0, DIMENSIONS), np.float32)
    kind = "struct<lang_pred: string, score: double>"

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            languages, scores = [], []
            for piece in _pieces([t or "" for t in batch.to_pylist()]):
                vectors, letters = profiles(piece)
                norms = np.linalg.norm(vectors, axis=1)
                if not names:
                    languages += ["und"] * len(piece)
                    scores += [0.0] * len(piece)
                    continue
                cosines = vectors @ matrix.T / np.maximum(norms, 1e-9)[:, None]
                best = cosines.argmax(axis=1)
                for i, b in enumerate(best):
                    languages.append(names[b] if letters[i] else "und")
                    scores.append(float(min(max(cosines[i, b], 0.0), 1.0)) if letters[i] else 0.0)
            yield pa.StructArray.from_arrays([pa.array(languages, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    # Iterators of Arrow arrays must stay annotated with real types for Spark to see their kind.
    judge.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    judged = F.arrow_udf(freed(judge), kind)(F.col(text))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, judged.alias("_judged")).select(*kept, "_judged.lang_pred", "_judged.score")
