"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import freed, mix64, ready, text_buffer, text_pieces, word_hashes

# Words of the shortest tile (items with fewer: all their words), and of a seed.
TILE = 5
# Share of an item's words that tiles must cover.
COVERAGE = 0.5
# Benchmark words that one broadcast index holds; more are gone through in blocks.
BLOCK_WORDS = 4_000_000
PIECE_BYTES = 1 << 20

# Bytes that belong to no word: all of ASCII that is neither letter nor digit.
_GAP = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(max(n, 1), np.uint64(base))
    steps[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(steps, dtype=np.uint64)


class Rolling:
    """Karp-Rabin hashes of all windows of a word sequence, for any window length."""

    def __init__(self, words: np.ndarray):
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(words * _powers(_BASE, len(words)), dtype=np.uint64, out=self.sums[1:])
            self.back = _powers(_INVERSE, len(words) + 1)

    def windows(self, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[length:] - self.sums[:-length]) * self.back[:len(self.sums) - length]


def _free_windows(marked: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows in which nothing is marked."""
    total = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(total[length:] == total[:-length])


def greedy_tiles(item: np.ndarray, text: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """Tiles ``(item place, text place, length)``: again and again the longest matches between what is still unmarked.

    Matches of one length are taken from left to right and never overlap, in
    either sequence. The length is found by bisection, since a match holds
    shorter ones. Ends when no match of ``shortest`` words is left.
    """
    tiles: list[tuple[int, int, int]] = []
    here, there = Rolling(item), Rolling(text)
    used_here, used_there = np.zeros(len(item), bool), np.zeros(len(text), bool)

    def matches(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        mine, theirs = _free_windows(used_here, length), _free_windows(used_there, length)
        a, b = here.windows(length)[mine], there.windows(length)[theirs]
        return mine, a, theirs[np.isin(b, a)], b[np.isin(b, a)]

    high = min(len(item), len(text))
    while high >= shortest > 0:
        if not len(matches(shortest)[2]):
            break
        low, top = shortest, high
        while low < top:
            middle = (low + top + 1) // 2
            if len(matches(middle)[2]):
                low = middle
            else:
                top = middle - 1
        mine, a, theirs, b = matches(low)
        places: dict[int, list[int]] = {}
        for place, code in zip(mine.tolist(), a.tolist()):
            places.setdefault(code, []).append(place)
        for starts in places.values():
            starts.reverse()
        for place, code in zip(theirs.tolist(), b.tolist()):
            if used_there[place:place + low].any():
                continue
            # What is used stays used, so a word that repeats is not gone through again for every place.
            starts = places.get(code, [])
            while starts and used_here[starts[-1]:starts[-1] + low].any():
                starts.pop()
            for start in reversed(starts):
                if not used_here[start:start + low].any() and np.array_equal(item[start:start + low], text[place:place + low]):
                    used_here[start:start + low] = True
                    used_there[place:place + low] = True
                    tiles.append((start, place, low))
                    break
        high = low
        if not tiles or tiles[-1][2] != low:
            high -= 1
    return tiles


@dataclass
class Index:
    """Seeds of some benchmark items: a seed is the hash of the first words of a possible tile."""

    items: list[int]
    words: list[np.ndarray]
    begin: np.ndarray  # words before each item
    seeds: dict[int, tuple[np.ndarray, np.ndarray]]  # by seed length: sorted hashes, and the place of each in all items in a row


def build_index(items: list[tuple[int, str]]) -> Index:
    """Items without words are left out: nothing can cover them."""
    column = pa.array([t or "" for _, t in items], pa.large_string())
    hashes, first = word_hashes(*text_buffer(column), _GAP)
    ids, words, begin, found = [], [], [0], {}
    for (item_id, _), a, b in zip(items, first[:-1], first[1:]):
        if b > a:
            own = hashes[a:b]
            length = min(TILE, len(own))
            # A seed that an item repeats covers several places; all are kept.
            code = Rolling(own).windows(length)
            found.setdefault(length, []).append((code, np.arange(begin[-1], begin[-1] + len(code))))
            ids.append(item_id)
            words.append(own)
            begin.append(begin[-1] + len(own))
    seeds = {}
    for length, parts in found.items():
        code, place = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(code, kind="stable")
        seeds[length] = (code[order], place[order])
    return Index(ids, words, np.array(begin), seeds)


def leaks(words: np.ndarray, index: Index, coverage: float) -> list[tuple[int, float, int]]:
    """``(item, share of the item covered, tiles)`` for items that the words cover far enough."""
    candidates: set[int] = set()
    rolling = None
    for length, (code, place) in index.seeds.items():
        if len(words) < length:
            continue
        rolling = rolling or Rolling(words)
        mine = np.unique(rolling.windows(length))
        low, high = np.searchsorted(code, mine, "left"), np.searchsorted(code, mine, "right")
        hit = low < high
        if not hit.any():
            continue
        shared = np.sort(np.concatenate([place[a:b] for a, b in zip(low[hit], high[hit])]))
        owner = np.searchsorted(index.begin, shared, "right") - 1
        # The words that shared seeds cover: tiles cannot cover more, since every window of a tile is one.
        fresh = np.minimum(np.diff(shared, append=shared[-1] + length), length)
        fresh[:-1][owner[1:] != owner[:-1]] = length
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        for item, covered in zip(owner[first], np.add.reduceat(fresh, first)):
            if covered >= coverage * len(index.words[item]):
                candidates.add(int(item))
    out = []
    for item in sorted(candidates):
        own = index.words[item]
        tiles = greedy_tiles(own, words, min(TILE, len(own)))
        share = sum(t[2] for t in tiles) / len(own)
        if share >= coverage:
            out.append((index.items[item], share, len(tiles)))
    return out


def _leaks_of(index, coverage: float) -> callable:
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for piece in text_pieces(batch, PIECE_BYTES):
                hashes, first = word_hashes(*text_buffer(piece), _GAP)
                # One look-up for all texts of the piece; only texts with a seed are tiled.
                hot = np.zeros(len(hashes) + 1, bool)
                if len(hashes):
                    rolling = Rolling(hashes)
                    for length, (code, _) in index.value.seeds.items():
                        if len(hashes) >= length:
                            window = rolling.windows(length)
                            place = np.minimum(np.searchsorted(code, window), len(code) - 1)
                            hot[:len(window)] |= code[place] == window
                total = np.concatenate([[0], np.cumsum(hot)])
                for a, b in zip(first[:-1], first[1:]):
                    rows.append([{"item_id": i, "coverage": c, "tiles": n} for i, c, n in leaks(hashes[a:b], index.value, coverage)]
                                if total[b] > total[a] else [])
            yield pa.array(rows, pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32())])))

    find.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return find


def leaked_items(benchmark: DataFrame, text: Column, coverage: float = COVERAGE) -> Column:
    """Array of ``(item_id, coverage, tiles)``: benchmark items of which tiles in the text cover enough words.

    Words are runs of letters and digits, A-Z lowered. Reordered passages count,
    since tiles may lie in any order. The benchmark reaches the tasks in blocks
    of about BLOCK_WORDS words, each a broadcast of bounded size; every text is
    held against all of them. A null text, or one without words, has no leaks;
    items without words (or null) never leak; an empty benchmark gives empty
    arrays. Repeated items are reported as often as they stand.
    """
    spark = ready(benchmark.sparkSession)
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).where("text is not null")
    words = rows.agg(F.sum(F.length("text") / 5)).collect()[0][0] or 0
    blocks = int(words // BLOCK_WORDS) + 1
    found = []
    for block in range(blocks):
        items = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        index = spark.sparkContext.broadcast(build_index([(r["item_id"], r["text"]) for r in items]))
        found.append(F.arrow_udf(freed(_leaks_of(index, coverage)), "array<struct<item_id: long, coverage: double, tiles: int>>")(text))
    return found[0] if len(found) == 1 else F.concat(*found)
