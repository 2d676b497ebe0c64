"""Weighted rendezvous sharding, with gapless places inside every shard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows that one ranking group should hold; the number of groups follows the table.
GROUP_ROWS = 50_000


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that depends on the key and the shard alone."""
    word = F.substring(F.md5(F.concat_ws(":", key, F.lit(str(shard))).cast("binary")), 1, 12)
    return (F.conv(word, 16, 10).cast("double") + 0.5) / float(1 << 48)


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard that wins the key: the largest weight / -ln(draw).

    A shard that is added or made heavier takes keys only into itself; one that
    goes gives its keys to the others in proportion to their weights. Equal
    scores go to the smaller shard number. A null key counts as the empty
    string. Shards of weight 0 win nothing.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative, and one must be positive")
    key = F.coalesce(key.cast("string"), F.lit(""))
    bids = [
        F.struct((-F.ln(draw(key, i)) / float(w)).alias("bid"), F.lit(i).alias("shard"))
        for i, w in enumerate(weights) if w > 0
    ]
    return (F.least(*bids) if len(bids) > 1 else bids[0])["shard"]


def with_slots(rows: DataFrame, shard: str = "shard", order: Sequence[str] = (), name: str = "slot") -> DataFrame:
    """Number the rows of every shard from 0 without a gap.

    Rows are ranked inside small hash groups; a running sum over the group
    sizes, which are few rows, puts the groups of a shard one after the other.
    Rows equal in all columns of ``order`` are counted first and opened again
    afterwards, so repeated rows, however many, are never sorted by one task.
    ``order`` names the columns to rank by (all columns by default); the
    numbering depends on the rows alone. An empty table stays empty; nulls sort
    first.
    """
    order = list(order) or [c for c in rows.columns if c != shard]
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(order)]
    names = [f"_k{i}" for i in range(len(order))]
    runs = rows.groupBy(F.col(shard).alias("_shard"), *keys).agg(F.count("*").alias("_n"))
    groups = max(1, -(-rows.select(shard).count() // GROUP_ROWS))
    runs = runs.withColumn("_group", F.pmod(F.xxhash64(*names), F.lit(groups)))
    inside = Window.partitionBy("_shard", "_group").orderBy(*names)
    ranked = runs.withColumn("_first", F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    sizes = runs.groupBy("_shard", "_group").agg(F.sum("_n").alias("_size"))
    along = Window.partitionBy("_shard").orderBy("_group").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.select("_shard", "_group", (F.sum("_size").over(along) - F.col("_size")).alias("_offset"))
    placed = ranked.join(sizes, (ranked["_shard"].eqNullSafe(sizes["_shard"])) & (ranked["_group"] == sizes["_group"]))
    first = F.col("_first") + F.col("_offset")
    opened = placed.select(ranked["_shard"].alias(shard), *[F.col(n).alias(c) for n, c in zip(names, order)],
                           F.explode(F.sequence(first, first + F.col("_n") - 1)).alias(name))
    return opened


def shard_documents(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None,
                    key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, size, text_crc32, shard, slot, grown_shard`` for every row of ``docs``.

    ``size`` is the UTF-8 length of the text (null: 0) plus 1; ``text_crc32`` is
    the unsigned checksum of the same bytes (null: of none). ``grown`` gives the
    weights of a changed set of shards. Only the key and these numbers are
    moved, never the text. Extra columns are ignored.
    """
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    slim = docs.select(
        F.col(key).alias(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
    )
    slim = slim.withColumn("shard", rendezvous_shard(F.col(key), weights))
    placed = with_slots(slim, "shard", [key, "size", "text_crc32"])
    other = rendezvous_shard(F.col(key), grown) if grown else F.lit(None).cast("int")
    return placed.select(key, "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"),
                         other.cast("int").alias("grown_shard"))
