"""Embedding near-duplicates: a small-world graph per shard, every shard searched, links checked, components united."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.common import Scratch, freed, ready
from cohortry.llm.components import connected_components
from cohortry.session import small_table

# Vectors of one graph at most, about, and bytes of them in double precision; shards at least; queries that are audited together.
SHARD_ROWS, SHARD_BYTES, SHARDS, BLOCK_ROWS = 100_000, 64 << 20, 8, 8192
# Tables smaller than a shard are asked in so many slots of at least so many queries; others in slots of the size of a shard.
SLOTS, SLOT_ROWS = 4, 16_384
# Bytes of one piece of a stored graph; tasks of one exchange at most.
PIECE_BYTES, TASKS = 1 << 20, 4096
# Neighbours of a node in the lowest layer (half of it above), and the beam of construction.
DEGREE, BUILD_BEAM = 24, 48
# The first beam of a search; queries audited per task, near copies planted for its audit; the recall they must reach.
BEAM, AUDIT, PROBES, RECALL = 24, 48, 96, 0.98
# Products that an exact comparison takes at a time.
EXACT_CELLS = 4_000_000
# Queries that walk together, and candidates each of them opens in a step.
TOGETHER, OPENED = 256, 4


def search_layer(links: np.ndarray, vectors: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of many queries at once: ids and similarities, best first, -1 where fewer were met.

    ``links[node]`` are its neighbours, padded with -1. Each step opens the best
    unopened candidates of every query until its whole beam is open.
    """
    n = len(queries)
    ids = np.full((n, beam), -1, np.int32)
    sims = np.full((n, beam), -np.inf, np.float32)
    opened = np.ones((n, beam), bool)
    seen = np.zeros((n, len(vectors)), bool)
    row = np.arange(n)
    width = min(entry.shape[1], beam)
    start = np.take_along_axis(entry, np.argsort(entry, axis=1)[:, ::-1], axis=1)[:, :width]
    twice = np.zeros_like(start, bool)
    twice[:, 1:] = start[:, 1:] == start[:, :-1]
    start = np.where(twice, -1, start)
    ids[:, :width] = start
    sims[:, :width] = np.where(start >= 0, np.einsum("qkd,qd->qk", vectors[start], queries), -np.inf)
    opened[:, :width] = start < 0
    seen[np.repeat(row, width)[start.ravel() >= 0], start.ravel()[start.ravel() >= 0]] = True
    live = row
    while len(live):
        score = np.where(opened[live], -np.inf, sims[live])
        best = np.argpartition(-score, min(OPENED, beam) - 1, axis=1)[:, :OPENED] if beam > OPENED else np.tile(np.arange(beam), (len(live), 1))
        good = np.take_along_axis(score, best, axis=1) > -np.inf
        some = good.any(axis=1)
        live, best, good = live[some], best[some], good[some]
        if not len(live):
            break
        opened[live[:, None], best] = True
        node = np.where(good, ids[live[:, None], best], -1)
        near = np.where(node[:, :, None] >= 0, links[node], -1).reshape(len(live), -1)
        near = -np.sort(-near, axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[live[:, None], near]
        near = np.where(fresh, near, -1)
        seen[np.broadcast_to(live[:, None], near.shape)[fresh], near[fresh]] = True
        sim = np.where(fresh, np.einsum("qkd,qd->qk", vectors[near], queries[live]), -np.inf).astype(np.float32)
        all_ids = np.concatenate([ids[live], near], axis=1)
        all_sims = np.concatenate([sims[live], sim], axis=1)
        all_open = np.concatenate([opened[live], ~fresh], axis=1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[live] = np.take_along_axis(all_ids, top, axis=1)
        sims[live] = np.take_along_axis(all_sims, top, axis=1)
        opened[live] = np.take_along_axis(all_open, top, axis=1) | (sims[live] == -np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)


def _diverse(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Neighbours for each row of candidates (best first): those nearer to the row's vector than to any chosen before.

    Places left over are filled with the best of the others.
    """
    near = np.einsum("qad,qbd->qab", vectors[ids], vectors[ids])
    chosen = np.zeros(ids.shape, bool)
    closest = np.full(ids.shape, -np.inf, np.float32)
    for k in range(ids.shape[1]):
        take = (ids[:, k] >= 0) & (closest[:, k] < sims[:, k]) & (chosen.sum(axis=1) < degree)
        chosen[:, k] = take
        closest = np.where(take[:, None], np.maximum(closest, near[:, :, k]), closest)
    rank = np.where(ids < 0, 3 * ids.shape[1], np.arange(ids.shape[1]) + np.where(chosen, 0, ids.shape[1]))
    return np.take_along_axis(ids, np.argsort(rank, axis=1, kind="stable")[:, :degree], axis=1)


class Graph:
    """Hierarchical navigable small world over unit vectors; built layer by layer, nodes in batches."""

    def __init__(self, vectors: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = len(vectors)
        self.vectors = vectors
        level = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(DEGREE / 2)).astype(int), 6)
        level[:1] = level.max() if n else 0
        # Nodes of higher layers come first everywhere, so a layer is a prefix.
        self.order = np.argsort(-level, kind="stable")
        self.vectors = vectors[self.order]
        counts = [int((level >= k).sum()) for k in range(level.max() + 1)] if n else []
        self.layers: list[np.ndarray] = []
        for k in range(len(counts) - 1, -1, -1):
            self.layers.insert(0, self._build(counts[k], DEGREE if k == 0 else DEGREE // 2))

    @classmethod
    def of(cls, vectors: np.ndarray, order: np.ndarray, layers: list[np.ndarray]) -> Graph:
        """The graph that was built over these vectors, from what was stored of it."""
        graph = cls.__new__(cls)
        graph.vectors, graph.order, graph.layers = vectors[order], order, layers
        return graph

    def entries(self, queries: np.ndarray, layers: list[np.ndarray], width: int = 4) -> np.ndarray:
        """Entry points for the layer below ``layers``, by walking down from the top."""
        entry = np.zeros((len(queries), 1), np.int32)
        for links in reversed(layers):
            entry, _ = search_layer(links, self.vectors[:len(links)], queries, entry, width)
        return entry

    def _build(self, n: int, degree: int) -> np.ndarray:
        links = np.full((n, degree), -1, np.int32)
        vectors, done = self.vectors[:n], 1
        while done < n:
            size = min(n - done, TOGETHER, max(1, done // 2))
            new = np.arange(done, done + size)
            queries = vectors[new]
            entry = self.entries(queries, self.layers)
            entry = np.where(entry < done, entry, 0)
            ids, sims = search_layer(links[:done], vectors[:done], queries, entry, min(BUILD_BEAM, max(done, 1)))
            among = queries @ queries.T
            np.fill_diagonal(among, -np.inf)
            k = min(size, degree)
            mates = np.argsort(-among, axis=1)[:, :k]
            mate_sims = np.take_along_axis(among, mates, axis=1)
            ids = np.concatenate([ids, np.where(mate_sims > -np.inf, new[mates], -1)], axis=1).astype(np.int32)
            sims = np.concatenate([sims, mate_sims], axis=1)
            best = np.argsort(-sims, axis=1, kind="stable")
            ids, sims = np.take_along_axis(ids, best, axis=1), np.take_along_axis(sims, best, axis=1)
            links[new] = _pad(_diverse(vectors, ids, sims, degree // 2 if degree > 12 else degree), degree)
            self._link_back(links, vectors, new, degree)
            done += size
        return links

    @staticmethod
    def _link_back(links: np.ndarray, vectors: np.ndarray, new: np.ndarray, degree: int) -> None:
        """Let the neighbours of new nodes know them; crowded nodes choose anew."""
        source, target = np.repeat(new, degree), links[new].ravel()
        source, target = source[target >= 0].astype(np.int32), target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, begin, count = np.unique(target, return_index=True, return_counts=True)
        # What one node gains in a step is held to a few times its degree, the nearest first.
        most = int(min(count.max(), 3 * degree)) if len(count) else 0
        for low in range(0, len(nodes), 512):
            some, b, c = nodes[low:low + 512], begin[low:low + 512], count[low:low + 512]
            extra = np.full((len(some), most), -1, np.int32)
            for i, (x, y) in enumerate(zip(b, c)):
                mine = source[x:x + y]
                if y > most:
                    mine = mine[np.argsort(-(vectors[mine] @ vectors[some[i]]), kind="stable")[:most]]
                extra[i, :len(mine)] = mine
            ids = np.concatenate([links[some], extra], axis=1)
            ids = -np.sort(-ids, axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.where(ids >= 0, np.einsum("qkd,qd->qk", vectors[ids], vectors[some]), -np.inf).astype(np.float32)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :4 * degree]
            links[some] = _pad(_diverse(vectors, np.take_along_axis(ids, best, axis=1), np.take_along_axis(sims, best, axis=1), degree), degree)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Node places (in the order the graph was given) and similarities of the nearest met, best first."""
        entry = self.entries(queries, self.layers[1:])
        ids, sims = search_layer(self.layers[0], self.vectors, queries, entry, min(beam, len(self.vectors)))
        return np.where(ids >= 0, self.order[ids], -1), sims


def _pad(ids: np.ndarray, degree: int) -> np.ndarray:
    out = np.full((len(ids), degree), -1, np.int32)
    out[:, :min(degree, ids.shape[1])] = ids[:, :degree]
    return out


def probes(exact: np.ndarray, least: float, seed: int = 11) -> np.ndarray:
    """Near copies of vectors spread over the shard, with a cosine just above ``least`` to their source."""
    source = exact[np.unique(np.linspace(0, len(exact) - 1, min(PROBES, len(exact))).astype(np.int64))]
    aside = np.random.default_rng(seed).standard_normal(source.shape)
    aside -= (aside * source).sum(axis=1, keepdims=True) * source
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = least + 0.01 * (1 - least)
    near = cosine * source + np.sqrt(max(0.0, 1 - cosine * cosine)) * aside / np.maximum(length, 1e-12)
    # One dimension has no aside: the copy is the vector itself.
    return np.where(length > 1e-9, near, source)


def _exact(exact: np.ndarray, queries: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """For each query all vectors with a cosine of ``least`` or more."""
    step = max(1, EXACT_CELLS // max(1, len(exact)))
    for low in range(0, len(queries), step):
        for row, query in zip(queries[low:low + step] @ exact.T, queries[low:low + step]):
            near = np.flatnonzero(row >= least - 1e-9)
            yield near[exact[near] @ query >= least]


def _walk(graph: Graph, exact: np.ndarray, queries: np.ndarray, least: float, beam: int) -> list[np.ndarray]:
    """What the graph gives. A query whose beam ends above ``least`` is searched again with twice the beam, at last exactly."""
    n, single = len(exact), queries.astype(np.float32)
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
    todo, width = np.arange(len(queries)), beam
    while len(todo) and width < n:
        again = []
        for low in range(0, len(todo), TOGETHER):
            some = todo[low:low + TOGETHER]
            ids, sims = graph.search(single[some], width)
            for i, q in enumerate(some):
                near = ids[i][(ids[i] >= 0) & (sims[i] >= least - 1e-3)]
                if len(near) >= width:
                    again.append(q)
                elif len(near):
                    found[q] = near[exact[near] @ queries[q] >= least]
        todo, width = np.array(again, np.int64), 2 * width
    for q, near in zip(todo, _exact(exact, queries[todo], least)):
        found[q] = near
    return found


def audit_passes(found: list[np.ndarray], truth: list[np.ndarray]) -> bool:
    """Whether queries with few links, and those with many, each find RECALL of their own links on average.

    Every query counts alike, so a large group hides nothing; without any link there is no evidence.
    """
    shares: dict[bool, list[float]] = {}
    for f, t in zip(found, truth):
        if len(t):
            shares.setdefault(len(t) > BEAM, []).append(len(np.intersect1d(f, t)) / len(t))
    return bool(shares) and all(np.mean(s) >= RECALL for s in shares.values())


def neighbours(graph: Graph, exact: np.ndarray, queries: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each query the graph's vectors whose cosine, in double precision, is ``least`` or more.

    Some queries, and planted near copies of the shard's vectors, are held
    against all vectors of the shard; until both find RECALL of their links,
    the beam is doubled. Where a search would come to cost as much as a full
    comparison, the block is compared with the shard exactly.
    """
    audited = queries[np.arange(0, len(queries), max(1, len(queries) // AUDIT))]
    planted = probes(exact, least)
    true_audited, true_planted = list(_exact(exact, audited, least)), list(_exact(exact, planted, least))
    beam = BEAM
    while beam < len(exact):
        # Queries without a link are no evidence for or against; the planted ones always are.
        fine = audit_passes(_walk(graph, exact, planted, least, beam), true_planted)
        if fine and any(len(t) for t in true_audited):
            fine = audit_passes(_walk(graph, exact, audited, least, beam), true_audited)
        if fine:
            return enumerate(_walk(graph, exact, queries, least, beam))
        beam *= 2
        if beam * DEGREE >= len(exact):
            break
    return enumerate(_exact(exact, queries, least))


def _unit(vectors: np.ndarray) -> np.ndarray:
    exact = vectors.astype(np.float64)
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    return exact


def _matrix(batches: list[pa.RecordBatch]) -> np.ndarray:
    """The vectors of some rows, all of one length, in the precision they are given in."""
    return np.concatenate([b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for b in batches])


def _longs(batches: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([b.column(name).to_numpy() for b in batches])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Each cell of rows that are sorted by ``cell``, with its rows as they come: no more than a batch is held."""
    slices = _slices(batches)
    ahead = next(slices, None)
    while ahead is not None:
        cell = ahead[0]

        def own() -> Iterator[pa.RecordBatch]:
            nonlocal ahead
            while ahead is not None and ahead[0] == cell:
                yield ahead[1]
                ahead = next(slices, None)

        rows = own()
        yield cell, rows
        for _ in rows:
            pass


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        cell = batch.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        for low, high in zip(cuts, cuts[1:]):
            if high > low:
                yield int(cell[low]), batch.slice(low, high - low)


_PIECES = "cell long, part int, piece binary"
_PIECES_ARROW = pa.schema([("cell", pa.int64()), ("part", pa.int32()), ("piece", pa.binary())])
_LINKS = "a long, b long, n long"
_LINKS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


@freed
def _build_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The graphs of shards with their ids, copies and vectors, as pieces of bounded size."""
    for cell, rows in _cells(batches):
        shard = list(rows)
        given = _matrix(shard)
        graph = Graph(_unit(given).astype(np.float32))
        whole = pickle.dumps((_longs(shard, "rep"), _longs(shard, "copies"), given, graph.order, graph.layers), protocol=5)
        del shard, given, graph
        for part, low in enumerate(range(0, len(whole), PIECE_BYTES)):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([cell], [part], [whole[low:low + PIECE_BYTES]]), _PIECES_ARROW)], schema=_PIECES_ARROW)


def _search_cells(least: float):
    """Each cell is the pieces of one graph, in order, and then the queries of a slot; a block of these is held at a time."""

    @freed
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _cells(batches):
            shard, pieces, root, waiting = None, [], {}, []
            for some in rows:
                stored = some.num_rows - some.column("piece").null_count
                pieces += some.column("piece").slice(0, stored).to_pylist()
                if stored == some.num_rows:
                    continue
                if shard is None:
                    # A shard that no vector fell to has no graph.
                    if not pieces:
                        break
                    ids, weight, given, order, layers = pickle.loads(b"".join(pieces))
                    pieces, exact = [], _unit(given)
                    shard = (Graph.of(exact.astype(np.float32), order, layers), exact, ids, weight)
                    del given
                waiting.append(some.slice(stored))
                while sum(b.num_rows for b in waiting) >= BLOCK_ROWS:
                    over = sum(b.num_rows for b in waiting) - BLOCK_ROWS
                    last = waiting.pop()
                    yield _links_of(shard, [*waiting, last.slice(0, last.num_rows - over)], root, least)
                    waiting = [last.slice(last.num_rows - over)] if over else []
            if waiting:
                yield _links_of(shard, waiting, root, least)

    return search


def _links_of(shard: tuple, batches: list[pa.RecordBatch], root: dict[int, int], least: float) -> pa.RecordBatch:
    """``a, a, n`` of every query with ``n`` links, and ``a, b, 0`` where a link joins two parts of the forest in ``root``."""
    graph, exact, ids, weight = shard
    asked = _longs(batches, "rep")

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    rows: list[tuple[int, int, int]] = []
    for q, near in neighbours(graph, exact, _unit(_matrix(batches)), least):
        others = near[ids[near] != asked[q]]
        if len(others):
            rows.append((int(asked[q]), int(asked[q]), int(weight[others].sum())))
            for other in ids[others].tolist():
                one, two = find(int(asked[q])), find(other)
                if one != two:
                    root[max(one, two)] = min(one, two)
                    rows.append((int(asked[q]), other, 0))
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else ([], [], []))], schema=_LINKS_ARROW)


def layout(sizes: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """For each dimension with so many classes: it, its shards and slots, and the numbers of its first shard and its first cell.

    A graph is held by one task and copied once per slot, so shards are bounded in
    rows and bytes, and a slot has about as many queries as a shard has vectors.
    """
    found, shard, cell = [], 0, 0
    for dimension, n in sorted(sizes.items()):
        most = max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * dimension)))
        shards, slots = max(SHARDS, -(-n // most)), max(-(-n // most), min(SLOTS, -(-n // SLOT_ROWS)))
        found.append((dimension, shards, slots, shard, cell))
        shard, cell = shard + shards, cell + shards * slots
    return found


def _dealt(df: DataFrame, cells: int, *order) -> DataFrame:
    """Rows of a cell in one task, sorted; a task has one cell, or few where there are very many."""
    tasks = max(1, min(cells, TASKS))
    return df.repartitionById(tasks, F.pmod("cell", F.lit(tasks)).cast("int")).sortWithinPartitions("cell", *order)


def embedding_duplicates(vectors: DataFrame, least: float = 0.9, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Equal vectors are one class. Classes are dealt to shards by a hash; each
    shard is indexed once by a graph, which is stored in pieces, and every slot of
    classes is searched in every shard. A task reads the pieces of one graph, then its
    queries block by block. It returns per class the number of vectors it found linked in its shard, and a
    spanning forest of these links, never all pairs. Vectors that are null or
    empty, have null or non-finite components or no length are linked with nothing;
    vectors of different lengths never meet. A null id stays alone (null component, kept).
    """
    spark = ready(vectors.sparkSession)
    scratch = Scratch(spark)
    # Floats are moved as they are; every cosine is of doubles.
    given = vectors.schema[embedding].dataType
    kind = "array<float>" if given in (T.ArrayType(T.FloatType(), True), T.ArrayType(T.FloatType(), False)) else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = fine & F.exists("embedding", lambda x: x != 0.0) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("embedding", F.when(F.coalesce(fine, F.lit(False)), F.col("embedding")))
    classes = scratch.store(rows.where("embedding is not null").groupBy("embedding")
                            .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
                            .withColumn("dimension", F.size("embedding")))
    laid = layout({r["dimension"]: r["count"] for r in classes.groupBy("dimension").count().collect()})
    shards, cells = sum(x[1] for x in laid), sum(x[1] * x[2] for x in laid)
    # A row per length of vectors.
    sizes = F.broadcast(small_table(spark, laid, "dimension int, shards long, slots long, first_shard long, first_cell long"))
    hashed = F.xxhash64("rep", "dimension")
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    placed = classes.join(sizes, "dimension").withColumns({"shard": F.pmod(hashed, "shards"), "slot": F.pmod(F.xxhash64(hashed), "slots")})
    built = _dealt(placed.select((F.col("first_shard") + F.col("shard")).alias("cell"), "rep", "copies", "embedding"), shards, "rep")
    graphs = scratch.store(built.mapInArrow(_build_shards, _PIECES))
    cell = F.col("first_cell") + F.col("shard") * F.col("slots") + F.col("slot")
    of_shard = sizes.withColumn("shard", every("shards")).withColumn("_of", F.col("first_shard") + F.col("shard"))
    stores = graphs.withColumnRenamed("cell", "_of").join(F.broadcast(of_shard), "_of").withColumn("slot", every("slots")).select(
        cell.alias("cell"), "part", "piece", F.lit(None).cast("long").alias("rep"), F.lit(None).cast(kind).alias("embedding"))
    asks = placed.drop("shard").withColumn("shard", every("shards")).select(
        cell.alias("cell"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("piece"), "rep", "embedding")
    dealt = _dealt(stores.unionByName(asks), cells, F.col("part").asc_nulls_last(), "rep")
    found = scratch.store(dealt.mapInArrow(_search_cells(least), _LINKS))
    scratch.drop(graphs)
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked"))
    named = connected_components(found.where("a <> b").select("a", "b"), scratch).withColumnRenamed("node", "rep")
    judged = classes.join(counts, "rep", "left").join(named, "rep", "left").select(
        F.col("embedding").alias("_same"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("linked"), F.coalesce("component", "rep").alias("component"))
    joined = rows.join(judged, rows["embedding"] == judged["_same"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return joined.select("vec_id", F.coalesce("linked", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
