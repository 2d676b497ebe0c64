"""Counting facts below a corner: ``x`` up to one bound and ``y`` up to another.

A window on the start and on the end of other events is a rectangle, and what
lies in it is a sum and difference of four such corners. "Different concepts in
a window" is one too: of the occurrences of a concept in a window exactly the
first has no earlier one inside it, so the concepts are the occurrences whose
previous one lies before the window.

The corner counts of a key are answered together. Its different ``y`` are ranked,
and ranks are grouped in runs of 1, 2, 4, ... that start at multiples of their
length. A fact belongs to one run of every length; the ranks below a bound are a
few whole runs, one for each binary digit of their number. Within a run only
``x`` is left, and that is a running sum over days. A key with ``m`` different
``y`` so costs its facts times log2(m), no pair of point and fact is formed, and
the runs of a hot key are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortry.operators.intervals import scan_days


def count_dominated(points: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts of each point's count: their sums are the facts with ``day`` and ``y`` up to the point's.

    ``facts`` has ``keys``, ``day`` (a date), ``y`` (a long) and ``n`` (how many
    such facts there are); ``points`` has ``keys``, ``day``, ``y`` and any other
    columns but ``n``, ``level`` and ``run``. A point comes back once for every run
    below its ``y``, with that run's count as ``n``; a point above no ``y`` does not
    come back. NULL in ``day`` or ``y`` of a point counts nothing.
    """
    keys = list(keys)
    facts = facts.groupBy(*keys, "day", "y").agg(F.sum("n").alias("n"))
    ranks = ranked(facts, keys)
    runs = runs_of(facts, ranks, keys).groupBy(*keys, "level", "run", "day").agg(F.sum("n").alias("n"))
    asked = runs_below(points.where(F.col("day").isNotNull()), ranks, keys)
    whole = [*keys, "level", "run"]
    return scan_days(asked, runs, whole, {"n": "sum"}, spread=whole).where(F.col("n").isNotNull())


def ranked(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, y, _below, _all``: the different ``y`` of each key, how many are up to each, and how many there are.

    The window sees one row per different ``y`` of a key.
    """
    return (
        facts.select(*keys, "y").distinct()
        .withColumn("_below", F.row_number().over(W.partitionBy(*keys).orderBy("y")))
        .withColumn("_all", F.count("*").over(W.partitionBy(*keys)))
    )


def _longest(number: Column) -> Column:
    """Exponent of the longest run that may lie in so many ranks."""
    return F.length(F.bin(number)) - 1


def _run_of(rank: Column) -> Column:
    return F.call_function("shiftright", rank.cast("long"), F.col("level"))


def runs_of(facts: DataFrame, ranks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each fact once for every run of ranks its ``y`` belongs to, one of each length (``level``)."""
    placed = facts.join(ranks, [*keys, "y"]).withColumn("level", F.explode(F.sequence(F.lit(0), _longest(F.col("_all")))))
    return placed.withColumn("run", _run_of(F.col("_below") - 1)).drop("_below", "_all")


def runs_below(points: DataFrame, ranks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each point once for every run that together are the ranks up to its ``y``: one per binary digit of their number."""
    named = points.withColumnRenamed("day", "_x").withColumn("day", F.col("y")).where(F.col("y").isNotNull())
    seen = scan_days(named, ranks.select(*keys, F.col("y").alias("day"), "_below"), keys, {"_below": "max"}, spread=keys)
    seen = seen.withColumn("_below", F.coalesce("_below", F.lit(0)).cast("long")).drop("day").withColumnRenamed("_x", "day")
    digits = F.filter(
        F.sequence(F.lit(0), _longest(F.col("_below"))),
        lambda k: F.col("_below").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k)) != 0,
    )
    asked = seen.where("_below > 0").withColumn("level", F.explode(digits))
    return asked.withColumn("run", _run_of(F.col("_below")) - 1).drop("_below")


def with_previous(occurrences: DataFrame, keys: Sequence[str], before: int) -> DataFrame:
    """``keys, day, y, n`` of occurrences ``keys, concept, day``: ``y`` is the day before which no occurrence of the concept is closer.

    It is the day number of the concept's previous occurrence, ``before`` for its
    first one; ``n`` counts the concepts alike in both days.
    """
    keys = list(keys)
    days = occurrences.select(*keys, "concept", "day").distinct()
    previous = F.lag("day").over(W.partitionBy(*keys, "concept").orderBy("day"))
    linked = days.withColumn("y", F.coalesce(F.unix_date(previous).cast("long"), F.lit(before)))
    return linked.groupBy(*keys, "day", "y").agg(F.count("*").alias("n"))
