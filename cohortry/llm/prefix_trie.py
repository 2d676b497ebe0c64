"""The trie of all conversation prefixes, as member intervals of the sorted conversations.

Conversations are sorted as sequences of turns. Those that share a prefix then
stand next to each other, and the prefix of length ``d`` at some place reaches
to both sides as far as neighbours have at least ``d`` turns in common: as long
as the minimum over their common lengths (LCPs) is at least ``d``. A sparse
table holds the minima over all runs of 1, 2, 4, ... LCPs, and every candidate
prefix finds its two ends by binary search in it, independently of all others.
A prefix is a candidate where it first occurs, so each node is found once.

Sums over a member interval are differences of running sums, so a node's
members, children, leaves and saved tokens need nothing but its two ends.

The sorted conversations are dealt over tasks by range, equal ones by their id.
A task works on blocks of a bounded number of turns. Nodes that reach over the
edge of a block are few (prefixes of the conversations at its two edges); each
block gives its share of them, and the shares are added up by node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import Scratch, broadcast_if_small, freed, ready
from cohortry.session import small_table

# Turns in a block, and bytes of one turn's digest.
BLOCK_TURNS, DIGEST = 1 << 18, 16

EMPTY = hashlib.sha256(b"").hexdigest()

WORD = r"[^\x20\x09-\x0D]+"


def sequences(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: per conversation an array of ``(token, words)`` in order.

    Turns are ordered by ``turn`` (null first), equal numbers by role and then by
    digest. A turn's token is a digest of role and text (null counts as empty),
    ``words`` the number of words of the text. Rows without ``conv_id`` belong to
    no conversation. Texts are not shuffled; one conversation's digests must fit
    in a task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("token"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "token", "words")))
    return slim.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["token"].alias("token"), t["words"].alias("words"))).alias("turns"))


def branched(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation ``c`` with its first ``h`` turns taken from ``c - c % every``; ``h = crc32(c) % most``.

    If that one has fewer turns all are taken, if it is absent none; then follow
    the turns of ``c`` itself after its first ``h``.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    base = conversations.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most - 1).alias("_head"))
    joined = conversations.join(base, F.col("conv_id") - F.col("conv_id") % every == F.col("_base"), "left")
    head = F.coalesce(F.slice("_head", F.lit(1), h), F.slice("turns", 1, 0))
    tail = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(head, tail).alias("turns"))


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Minima of all runs of 2^k neighbours, one array per k."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half, last = 1 << (len(table) - 1), table[-1]
        table.append(np.minimum(last[:-half], last[half:]))
    return table


def range_minimum(table: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of ``values[first..last]`` for each pair, from two overlapping runs."""
    level = np.frexp(last - first + 1)[1] - 1
    out = np.empty(len(first), table[0].dtype)
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[k][first[at]], table[k][last[at] - (1 << k) + 1])
    return out


def extents(table: list[np.ndarray], place: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place that share ``depth`` turns with each ``place``.

    ``table`` is over the LCPs, where entry ``i`` belongs to places ``i - 1`` and
    ``i`` (entry 0 to nothing here). Every step tries to widen an end by a power
    of two.
    """
    left, right = place.copy(), place.copy()
    n = len(table[0])
    for k in range(len(table) - 1, -1, -1):
        step = 1 << k
        can = np.flatnonzero(right + step < n)
        can = can[table[k][right[can] + 1] >= depth[can]]
        right[can] += step
        can = np.flatnonzero(left - step >= 0)
        can = can[table[k][left[can] - step + 1] >= depth[can]]
        left[can] -= step
    return left, right


def common_lengths(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Turns that each sequence shares with the one before it (0 for the first); ``tokens`` holds all of them in a row."""
    n = len(lengths)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    starts = np.cumsum(lengths) - lengths
    most = np.minimum(lengths[1:], lengths[:-1])
    lcp[1:] = most
    owner = np.repeat(np.arange(n - 1), most)
    place = np.arange(most.sum()) - np.repeat(np.cumsum(most) - most, most)
    differs = np.flatnonzero(tokens[starts[1:][owner] + place] != tokens[starts[:-1][owner] + place])
    np.minimum.at(lcp, owner[differs] + 1, place[differs])
    return lcp


@dataclass
class Block:
    """Neighbouring sorted conversations, and what they share with those outside (-1: nobody is there)."""

    conv: np.ndarray
    keys: list[bytes]
    lengths: np.ndarray
    words: np.ndarray
    before: int
    after: int
    order: tuple[int, int]


# A node, or (with ``node``) a block's share of one; ``above`` names a parent that is shared itself.
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
        "node binary, above binary, ends string, block long, part long")
_ARROW = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
                    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("node", pa.binary()), ("above", pa.binary()),
                    ("ends", pa.string()), ("block", pa.int64()), ("part", pa.int64())])


def _sum_before(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def block_nodes(block: Block) -> pa.RecordBatch:
    """All nodes that occur in a block."""
    n, lengths = len(block.conv), block.lengths
    tokens = np.frombuffer(b"".join(block.keys), dtype=f"V{DIGEST}")
    lcp = common_lengths(tokens, lengths)
    lcp[0] = block.before
    table, smallest = sparse_table(lcp), sparse_table(block.conv)

    # Candidates: every prefix where it first occurs in the block; the first place has the root too.
    known = lcp.copy()
    known[0] = -1
    place = np.repeat(np.arange(n), lengths - known)
    depth = known[place] + 1 + np.arange(len(place)) - np.repeat(_sum_before(lengths - known)[:-1], lengths - known)
    left, right = extents(table, place, depth)
    up_left, up_right = extents(table, place, depth - 1)

    word_sums = _sum_before(block.words)
    starts = np.cumsum(lengths) - lengths
    upto = lambda i, d: word_sums[starts[i] + np.maximum(d, 0)] - word_sums[starts[i]]

    everything = np.arange(n)
    total = upto(everything, lengths)
    new = total - upto(everything, lcp)
    totals, news = _sum_before(total), _sum_before(new)
    follower = np.append(lcp[1:], block.after)
    leaves = _sum_before(follower < lengths)
    n_convs = right - left + 1

    open_left = (left == 0) & (block.before >= depth)
    open_right = (right == n - 1) & (block.after >= depth)
    above = upto(left, depth - 1)
    opening = np.where(open_left, new[0], total[left] - above)
    saved = totals[right + 1] - totals[left] - n_convs * above - (news[right + 1] - news[left + 1] + opening)

    # A child begins where a longer conversation shares exactly ``depth`` turns with the one before it.
    begins = np.flatnonzero(lengths > lcp)
    at = lcp[begins] * (n + 1) + begins
    order = np.argsort(at, kind="stable")
    at = at[order]
    children = np.searchsorted(at, depth * (n + 1) + right, "right") - np.searchsorted(at, depth * (n + 1) + left, "right")
    children += np.where(open_left, (block.before == depth) & (lengths[0] > depth), lengths[left] > depth)

    # Equal conversations stand together, by id: those that end at a node are the run at its left end.
    same = np.zeros(n, dtype=bool)
    same[1:] = (lcp[1:] == lengths[1:]) & (lcp[1:] == lengths[:-1])
    run = np.append(np.flatnonzero(~same), n)
    texts = pa.ListArray.from_arrays(pa.array(run.astype(np.int32)), pa.array(block.conv).cast(pa.string()))
    texts = pc.binary_join(texts, ",")
    ending = np.flatnonzero(lengths[left] == depth)
    which = np.searchsorted(run, left[ending], "right") - 1
    sha: list[str | None] = [EMPTY] * len(place)
    ends: list[str | None] = [None] * len(place)
    shared = open_left | open_right
    for i, text in zip(ending.tolist(), texts.take(pa.array(which)).to_pylist()):
        if shared[i]:
            ends[i] = text
        else:
            sha[i] = hashlib.sha256(text.encode()).hexdigest()

    # The parent's ends were searched for from the same place, so whether it is shared is known as well.
    up_shared = (depth > 0) & (((up_left == 0) & (block.before >= depth - 1)) | ((up_right == n - 1) & (block.after >= depth - 1)))
    parent = range_minimum(smallest, up_left, up_right)
    names: dict[tuple[int, int], bytes] = {}

    def name(i: int, d: int) -> bytes:
        if (i, d) not in names:
            names[i, d] = hashlib.md5(block.keys[i][:d * DIGEST]).digest()
        return names[i, d]

    node: list[bytes | None] = [None] * len(place)
    over: list[bytes | None] = [None] * len(place)
    for i in np.flatnonzero(shared).tolist():
        node[i] = name(int(left[i]), int(depth[i]))
    for i in np.flatnonzero(up_shared).tolist():
        over[i] = name(int(up_left[i]), int(depth[i]) - 1)
    columns = [
        pa.array(range_minimum(smallest, left, right)), pa.array(depth), pa.array(parent, mask=(depth == 0) | up_shared), pa.array(n_convs), pa.array(children.astype(np.int64)),
        pa.array(leaves[right + 1] - leaves[left]), pa.array(saved), pa.array(sha, pa.string()), pa.array(node, pa.binary()), pa.array(over, pa.binary()),
        pa.array(ends, pa.string()), pa.array(np.full(len(place), block.order[0])), pa.array(np.full(len(place), block.order[1]))]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def _shared_turns(a: bytes | None, b: bytes | None) -> int:
    """Turns that two keys have in common; -1 without one of them."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // DIGEST
    x, y = np.frombuffer(a, dtype=f"V{DIGEST}", count=n), np.frombuffer(b, dtype=f"V{DIGEST}", count=n)
    differs = np.flatnonzero(x != y)
    return int(differs[0]) if len(differs) else n


def _blocks(edges: dict[int, tuple[int, int]], turns: int):
    """A task: sorted conversations of some ranges in, nodes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, np.ndarray]] = []
        at, part, size, before = None, 0, 0, -1

        def close(after: int) -> pa.RecordBatch:
            keys = [key for _, key, _ in held]
            lengths = np.array([len(key) // DIGEST for key in keys], np.int64)
            words = np.concatenate([w for _, _, w in held]) if held else np.zeros(0, np.int64)
            return block_nodes(Block(np.array([c for c, _, _ in held], np.int64), keys, lengths, words.astype(np.int64), before, after, (at, part)))

        for batch in batches:
            words = batch["words"]
            offsets = np.asarray(words.offsets)
            flat = np.asarray(words.values)
            for i, (block, conv, key) in enumerate(zip(batch["block"].to_pylist(), batch["conv_id"].to_pylist(), batch["key"].to_pylist())):
                if block != at:
                    if held:
                        yield close(edges[at][1])
                    held, at, part, size, before = [], block, 0, 0, edges[block][0]
                elif size >= turns:
                    between = _shared_turns(held[-1][1], key)
                    yield close(between)
                    held, part, size, before = [], part + 1, 0, between
                held.append((conv, key, flat[offsets[i]:offsets[i + 1]]))
                size += len(key) // DIGEST + 1
        if held:
            yield close(edges[at][1])

    return run


def _edges(ranges: DataFrame) -> dict[int, tuple[int, int]]:
    """Per range the turns shared across its first and its last edge: two numbers a range come to the driver."""
    numbers = sorted(row["block"] for row in ranges.select("block").collect())
    pairs = small_table(ranges.sparkSession, list(zip(numbers, numbers[1:])), "block long, next long")

    @F.pandas_udf("int")
    def shared(last, first):
        return pd.Series([_shared_turns(bytes(a), bytes(b)) for a, b in zip(last, first)], dtype="int32")

    nexts = ranges.select(F.col("block").alias("next"), F.col("first").alias("next_first"))
    joined = ranges.join(pairs, "block").join(nexts, "next").select("block", "next", shared("last", "next_first").alias("lcp")).collect()
    after = {row["block"]: row["lcp"] for row in joined}
    before = {row["next"]: row["lcp"] for row in joined}
    return {block: (before.get(block, -1), after.get(block, -1)) for block in numbers}


def _joined_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the ids that end at a node, streamed over the shares of its blocks."""
    at, digest = None, None
    for batch in batches:
        done = []
        for node, text in zip(batch["node"].to_pylist(), batch["ends"].to_pylist()):
            if node != at:
                if at is not None:
                    done.append((at, digest.hexdigest()))
                at, digest = node, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        if done:
            yield _ended(done)
    if at is not None:
        yield _ended([(at, digest.hexdigest())])


def _ended(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["ended", "sha"])


def prefix_trie(conversations: DataFrame, scratch: Scratch, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per distinct prefix of ``conversations(conv_id, turns)``, the root (depth 0) included.

    ``conv_id`` is the smallest member, ``parent_conv_id`` that of the parent
    (null at the root), ``n_convs`` the members, ``n_children`` and ``n_leaves``
    count below, ``saved_tokens`` what sharing this subtree saves, and
    ``ends_sha256`` the digest of the ids of the members that end here. A
    conversation without turns is a member of the root. Without conversations
    there is no row.
    """
    spark = ready(conversations.sparkSession)
    tokens = F.transform("turns", lambda t: t["token"])
    keyed = scratch.store(conversations.select(
        "conv_id", F.unhex(F.array_join(tokens, "")).alias("key"), F.transform("turns", lambda t: t["words"].cast("long")).alias("words")))
    size = keyed.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    if not size:
        return spark.createDataFrame([], NODE).select(*RESULT)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // block_turns))
    ordered = keyed.repartitionByRange(tasks, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    ordered = scratch.store(ordered.select(F.spark_partition_id().cast("long").alias("block"), F.monotonically_increasing_id().alias("place"), "conv_id", "key", "words"))
    scratch.drop(keyed)
    ranges = ordered.groupBy("block").agg(F.min_by("key", "place").alias("first"), F.max_by("key", "place").alias("last"))
    edges = _edges(scratch.store(ranges))
    dealt = ordered.repartitionById(tasks, F.col("block").cast("int")).sortWithinPartitions("block", "place")
    found = scratch.store(dealt.select("block", "conv_id", "key", "words").mapInArrow(freed(_blocks(edges, block_turns)), NODE))
    scratch.drop(ordered)
    return _whole_nodes(found, scratch)


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _whole_nodes(found: DataFrame, scratch: Scratch) -> DataFrame:
    """Add up the shares of nodes that reach over the edge of a block, and fetch the parents that do."""
    shares = found.where("node is not null")
    added = shares.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("above").alias("above"), F.min("parent_conv_id").alias("parent_conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    texts = shares.where("ends is not null").select("node", "block", "part", "ends")
    digests = texts.repartition("node").sortWithinPartitions("node", "block", "part").select("node", "ends").mapInArrow(_joined_ends, "ended binary, sha string")
    nodes = scratch.store(added.join(digests, F.col("node") == F.col("ended"), "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY))))
    parents = broadcast_if_small(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("_parent_conv_id")))

    whole = found.where("node is null").select("above", *RESULT).unionByName(nodes.select("above", *RESULT))
    below = whole.where("above is not null").join(parents, F.col("above") == F.col("parent"))
    below = below.withColumn("parent_conv_id", F.col("_parent_conv_id"))
    return whole.where("above is null").select(*RESULT).unionByName(below.select(*RESULT))
