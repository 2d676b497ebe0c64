"""Near-duplicate documents: tensored MinHash tables, checked on full shingle sets, united to components."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import Scratch, broadcast_if_small, freed, mix64, random_words, ready, text_buffer, text_pieces, word_hashes
from cohortry.llm.components import connected_components

SHINGLE = 5
# Two collections of half keys, HALVES at least, each of ROWS minhashes; a table's key
# joins one half key of either, so 2 * n * ROWS minhashes serve n ** 2 tables.
# All tables miss a pair of just the wanted similarity with probability MISS at most.
HALVES, ROWS, MISS = 12, 4, 3e-4
# Members that meet their pivot in one task, and classes of one block of a large cluster.
BLOCK, CLUSTER_BLOCK = 64, 256
# Columns of the membership matrix that are multiplied at a time.
COLUMNS = 8192
# Texts of one Arrow batch are worked on in pieces of about so many bytes.
PIECE_BYTES = 1 << 20

_PLACE = random_words(5, SHINGLE) | np.uint64(1)


def missed(similarity: float, halves: int) -> float:
    """Probability that a pair meets in no table."""
    return 1 - (1 - (1 - similarity ** ROWS) ** halves) ** 2


def halves_for(percent: int) -> int:
    """Half keys of a collection that a similarity of ``percent`` needs."""
    n = HALVES
    while missed(percent / 100, n) > MISS:
        n += 1
    return n


def shingle_hashes(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its shingles.

    Words are runs without white space, A-Z lowered. A text of fewer than
    SHINGLE words has its whole sequence as one shingle; one without words has
    none.
    """
    words, first = word_hashes(data, offsets)
    with np.errstate(over="ignore"):
        n = len(words)
        whole = np.zeros(max(n - SHINGLE + 1, 0), np.uint64)
        for k in range(SHINGLE):
            whole += words[k:n - SHINGLE + 1 + k] * _PLACE[k] if n >= SHINGLE else 0
        whole = mix64(whole)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= SHINGLE:
                yield np.unique(whole[a:b - SHINGLE + 1])
            elif b > a:
                # The length takes part, so a short text equals no shingle of a longer one.
                yield mix64(np.array([(words[a:b] * _PLACE[:b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def _signatures(halves_each: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    odds = random_words(3, 2 * halves_each * ROWS) | np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, halves = [], [], []
            for piece in text_pieces(batch.column(1), PIECE_BYTES):
                for s in shingle_hashes(*text_buffer(piece)):
                    sizes.append(len(s))
                    if not len(s):
                        digests.append(None)
                        halves.append(None)
                        continue
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    low = np.empty(len(odds), np.uint64)
                    with np.errstate(over="ignore"):
                        for i, odd in enumerate(odds):
                            low[i] = (s * odd).min()
                        pairs = low.reshape(-1, ROWS)
                        halves.append(mix64((pairs * _PLACE[:ROWS]).sum(axis=1)).view(np.int64))
            flat = [h for h in halves if h is not None]
            values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64))
            ends = np.cumsum([0] + [0 if h is None else len(h) for h in halves])
            offsets = pa.array(ends.astype(np.int32), mask=np.array([h is None for h in halves] + [False]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "n_shingles", "digest", "halves"])

    return sign


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", halves: int = HALVES) -> DataFrame:
    """``doc_id, n_shingles, digest, halves``: the set's size, its exact fingerprint, and 2 * ``halves`` half keys."""
    ready(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).mapInArrow(
        freed(_signatures(halves)), "doc_id long, n_shingles long, digest binary, halves array<long>")


def table_keys(classes: DataFrame, halves: int = HALVES) -> DataFrame:
    """``(rep, n, key)`` for every table in which a class can meet another.

    The first collection is counted alone first: a half key that one class
    holds meets nobody in any of its tables, and most do.
    """
    first = classes.select("rep", "n", "halves", F.posexplode(F.slice("halves", 1, halves)).alias("i", "half"))
    shared = first.groupBy("i", "half").agg(F.count("*").alias("c")).where("c > 1").select("i", "half")
    met = first.join(shared, ["i", "half"])
    tables = met.select("rep", "n", "i", "half", F.posexplode(F.slice("halves", halves + 1, halves)).alias("j", "other"))
    return tables.select("rep", "n", F.xxhash64("i", "half", "j", "other").alias("key"))


def _jaccard_blocks(key, group):
    """Similarity of a block's members to its pivot."""
    sets = {}
    texts = group.text
    for doc, s in zip(group.doc.tolist(), shingle_hashes(*text_buffer(pa.array(texts, pa.large_string())))):
        sets[doc] = s
    pivot = sets[key[0]]
    out = []
    for doc, s in sets.items():
        if doc != key[0]:
            both = len(np.intersect1d(pivot, s, assume_unique=True))
            out.append((key[0], doc, both, len(pivot) + len(s) - both))
    return group.iloc[:0].assign(a=[], b=[], both=[], either=[])[["a", "b", "both", "either"]] if not out else \
        type(group)(out, columns=["a", "b", "both", "either"])


def similarities(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``(a, b, both, either)``: intersection and union of the full sets of every pair ``(a, b)``.

    ``texts(rep, text)`` has one row per class. A pivot ``a`` with many members
    is cut into blocks of about BLOCK members with a copy of the pivot in each.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = pairs.join(sizes, "a").select("a", F.col("b").alias("doc"), F.pmod(F.xxhash64("b"), "blocks").alias("block"))
    pivots = sizes.select("a", F.col("a").alias("doc"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    wanted = members.unionByName(pivots)
    filled = wanted.join(texts.withColumnRenamed("rep", "doc"), "doc")
    return filled.groupBy("a", "block").applyInPandas(_jaccard_blocks, "a long, b long, both long, either long")


def spanning_links(docs: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A forest of links that joins the same documents as all links among ``docs`` do."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[a:b], column[a:b] - low] = 1
        both += held @ held.T
    size = np.array([len(x) for x in sets])
    inter = both.astype(np.int64)
    linked = inter * 100 >= (size[:, None] + size[None, :] - inter) * percent
    np.fill_diagonal(linked, False)
    out, fresh = [], np.ones(len(sets), bool)
    for seed in range(len(sets)):
        if fresh[seed]:
            fresh[seed], open_ = False, [seed]
            while open_:
                at = open_.pop()
                for other in np.flatnonzero(linked[at] & fresh):
                    fresh[other] = False
                    open_.append(int(other))
                    out.append((docs[at], docs[other]))
    return out


def _block_links(percent: int):
    def links(group):
        docs = group.drop_duplicates("doc")
        sets = list(shingle_hashes(*text_buffer(pa.array(docs.text, pa.large_string()))))
        return type(group)(spanning_links(docs.doc.tolist(), sets, percent), columns=["a", "b"])

    return links


def _lengths_allow(percent: int):
    """Two sets whose sizes differ too much cannot be similar enough."""
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent


def _block_pairs(members: DataFrame, percent: int) -> DataFrame:
    """``(pair, doc)``: the classes of every two blocks of a cluster that may hold links between components.

    ``members(cluster, component, rep, n)``. A component of CLUSTER_BLOCK classes
    or more has blocks of its own, which never meet each other; smaller ones
    share blocks.
    """
    sized = members.groupBy("cluster", "component").agg(F.count("*").alias("c"))
    large = F.col("c") >= CLUSTER_BLOCK
    small = sized.where(~large).groupBy("cluster").agg(F.sum("c").alias("small"))
    sized = sized.join(small, "cluster", "left")
    own = sized.select("cluster", "component", F.when(large, F.col("component")).alias("alone"),
                       F.ceil(F.when(large, F.col("c")).otherwise(F.col("small")) / CLUSTER_BLOCK).alias("blocks"))
    placed = members.join(own, ["cluster", "component"]).withColumn(
        "block", F.xxhash64("alone", F.pmod(F.xxhash64(F.when(F.col("alone").isNull(), F.col("component")).otherwise(F.col("rep"))), "blocks")))
    blocks = placed.groupBy("cluster", "block").agg(F.first("alone").alias("alone"), F.min("n").alias("low"), F.max("n").alias("high"))
    one = blocks.select("cluster", *[F.col(c).alias(f"{c}_1") for c in ("block", "alone", "low", "high")])
    two = blocks.select("cluster", *[F.col(c).alias(f"{c}_2") for c in ("block", "alone", "low", "high")])
    pairs = one.join(two, "cluster").where(
        "(block_1 < block_2 and not (alone_1 <=> alone_2 and alone_1 is not null)) or (block_1 = block_2 and alone_1 is null)")
    pairs = pairs.where((F.col("high_1") * 100 >= F.col("low_2") * percent) & (F.col("high_2") * 100 >= F.col("low_1") * percent))
    sides = pairs.select("cluster", F.xxhash64("cluster", "block_1", "block_2").alias("pair"),
                         F.explode(F.array_distinct(F.array("block_1", "block_2"))).alias("block"))
    return sides.join(placed.select("cluster", "block", F.col("rep").alias("doc")), ["cluster", "block"]).select("pair", "doc")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    1. Documents with equal shingle sets become one class, named by the smallest id.
    2. Classes that agree on a half key of both collections meet in a table;
       classes that met, directly or through others, form a cluster.
    3. The smallest class of a cluster is compared with all others, on full
       sets; links with 100 * intersection >= percent * union unite components.
    4. Clusters that are still divided are cut into blocks, and every two
       blocks are compared in a task of their own, which returns a spanning
       forest of the links it confirmed. So no link of a cluster is lost, and
       pairs are never rows.

    A text without words (or null) is linked with nothing: its component is its
    own id. A row without id stays alone with a null component and is kept.
    Rows that share an id and a text share the result. Only classes of clusters
    move their texts. Empty input gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    halves = halves_for(percent)
    signed = scratch.store(signatures(docs, key, text, halves))
    classes = scratch.store(
        signed.where("digest is not null and doc_id is not null").groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("halves").alias("halves")))
    tables = scratch.store(table_keys(classes, halves))
    leaders = tables.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last").select("key", "a")
    met = tables.join(leaders, "key").where("a <> rep").select("a", F.col("rep").alias("b")).distinct()
    clusters = connected_components(met, scratch).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    members = scratch.store(clusters.join(classes.select("rep", "n").groupBy("rep").agg(F.max("n").alias("n")), "rep"))
    scratch.drop(tables)
    # One text per class: that of the row with its smallest id.
    wanted = broadcast_if_small(members.select(F.col("rep").alias("doc_id")))
    texts = scratch.store(
        docs.select(F.col(key).cast("long").alias("doc_id"), text).join(wanted, "doc_id", "left_semi")
        .groupBy(F.col("doc_id").alias("rep")).agg(F.max(text).alias("text")))
    names = members.withColumn("component", F.col("rep"))
    pivots = members.where("rep = cluster").select("cluster", F.col("n").alias("n_a"))
    pairs = (members.where("rep <> cluster").join(pivots, "cluster").withColumn("n_b", F.col("n"))
             .where(_lengths_allow(percent)).select(F.col("cluster").alias("a"), F.col("rep").alias("b")))
    found = similarities(pairs, texts)
    linked = scratch.store(found.where(F.col("both") * 100 >= F.col("either") * percent).select("a", "b"))
    # A star: whoever is linked to the pivot belongs to it.
    names = scratch.store(members.join(linked.withColumnRenamed("b", "rep"), "rep", "left")
                          .select("cluster", "rep", "n", F.coalesce("a", "rep").alias("component")))
    divided = names.groupBy("cluster").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    rest = names.join(divided.select("cluster"), "cluster")
    met = _block_pairs(rest, percent).join(texts.withColumnRenamed("rep", "doc"), "doc")
    further = met.groupBy("pair").applyInPandas(_block_links(percent), "a long, b long")
    links = linked.unionByName(further)
    named = connected_components(links, scratch).select(F.col("node").alias("rep"), "component")
    scratch.drop(texts, members, names, linked)
    ours = classes.select("digest", "rep").join(named, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    joined = signed.drop("halves").join(ours, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
