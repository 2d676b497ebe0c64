"""Interval operators that stay safe when one person holds a large share of all rows.

Two ideas are used throughout:

* Clinical dates are whole days. Once rows are reduced to one per (key, day) a
  key can hold no more rows than its record has days, so a window over that key
  is bounded whatever the number of raw rows was. The reduction is a plain
  aggregation and starts on the map side.
* "How many / the latest / the next within a date range" is read off running
  aggregates over the days of a key instead of joining all pairs of the key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortry.functions.expressions import day_number
from cohortry.session import broadcast_if_small, cut_lineage


def collapse_eras(df: DataFrame, keys: Sequence[str] = ("person_id",), pad: int | Column = 0,
                  start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Merge intervals of a key that overlap, touch, or lie at most ``pad`` days apart.

    Intervals with the same start always end up in one era, so only the longest
    of them is kept before the window runs.
    """
    keys = list(keys)
    longest = df.groupBy(*keys, start).agg(F.max(end).alias(end))
    ordered = W.partitionBy(*keys).orderBy(start)
    reach = F.max(end).over(ordered.rowsBetween(W.unboundedPreceding, -1))
    opens = F.coalesce(F.col(start) > F.date_add(reach, pad), F.lit(True)).cast("int")
    era = F.sum("_opens").over(ordered.rowsBetween(W.unboundedPreceding, 0))
    return (
        longest.withColumn("_opens", opens)
        .withColumn("_era", era)
        .groupBy(*keys, "_era")
        .agg(F.min(start).alias(start), F.max(end).alias(end))
        .drop("_era")
    )


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Earliest row of every key.

    The filter on the row number lets Spark cut each map task down to one row per
    key before the shuffle.
    """
    position = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_position", position).where("_position = 1").drop("_position")


def scan_days(points: DataFrame, facts: DataFrame, keys: Sequence[str],
              values: Mapping[str, str], forward: bool = False, spread: Sequence[str] = ()) -> DataFrame:
    """Add to each point an aggregate over the facts up to (or from) its day.

    ``facts`` has ``keys``, ``day`` and the columns of ``values`` (column name ->
    ``sum``, ``max`` or ``min``), at most one row per key and day. ``points`` has
    ``keys``, ``day`` and any other columns. Facts on the point's own day count.
    With ``forward`` the facts on and after the day are used. Rows are brought
    together by the first key alone, so that later steps on it need no shuffle;
    ``spread`` names other keys, where the first one may be hot.
    """
    keys = list(keys)
    rows = facts.select(*keys, "day", *values, F.lit(False).alias("_is_point")).unionByName(
        points.withColumn("_is_point", F.lit(True)), allowMissingColumns=True
    ).repartition(*(spread or keys[:1]))
    day = F.col("day").desc() if forward else F.col("day").asc()
    up_to = W.partitionBy(*keys).orderBy(day, F.col("_is_point").asc()).rowsBetween(W.unboundedPreceding, 0)
    seen = {name: getattr(F, how)(name).over(up_to) for name, how in values.items()}
    return rows.withColumns(seen).where("_is_point").drop("_is_point")


# Slices of the longest spans are this many times wider than those of the next shorter ones.
WIDER = 8

# Levels of slices: 366 days times 8^5 are more than all days a date can name.
LEVELS = 6


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str],
                 right_span: tuple[str, str], width: int = 366, clip: bool | DataFrame = False) -> DataFrame:
    """Pairs with equal ``keys`` whose closed date spans share at least one day.

    Both sides are cut into slices and joined on key and slice, so a long record
    is spread over many tasks and distant pairs never meet. Slices come in levels,
    each WIDER times as wide as the one below. A span of ``right`` goes to the
    first level whose slices are as long as it is and so lies in at most two of
    them, however many years it lasts; ``left``, better the shorter spans, is cut
    on every level. A pair is kept only in the slice in which its overlap begins:
    nothing is emitted twice. Span columns need different names on the two sides.
    A span without a day (NULL, or its end before its start) touches nothing; give
    bounds that a condition really needs.

    With ``clip``, which reads ``left`` once more, spans of ``right`` are sliced for the days from the
    first to the last of all of ``left`` alone, and ``left`` is cut on the few levels this takes. Where
    ``left`` takes long to find, ``clip`` may be a frame that is read in its place and has the same spans.
    """
    keys = list(keys)
    begin = F.greatest(F.col(left_span[0]), F.col(right_span[0]))
    if clip is not False:
        cut, own = _within_reach(left, left if clip is True else clip, right, left_span, right_span, width)
    else:
        cut, own = on_all_levels(left, left_span, width), on_own_level(right, right_span, width)
    return (
        cut.join(own, [*keys, "_level", "_slice"])
        .where(F.col(left_span[0]) <= F.col(right_span[1]))
        .where(F.col(right_span[0]) <= F.col(left_span[1]))
        .where(F.floor(day_number(begin) / _slice_width(width)) == F.col("_slice"))
        .drop("_level", "_slice")
    )


def _slice_width(width: int) -> Column:
    """Days in a slice of the row's level."""
    return F.element_at(F.array(*[F.lit(width * WIDER**i) for i in range(LEVELS)]), F.col("_level") + 1)


def _sliced(df: DataFrame, span: tuple[str, str], width: int, level: Column) -> DataFrame:
    first, last = (F.floor(day_number(F.col(c)) / _slice_width(width)).cast("int") for c in span)
    proper = df.where(F.col(span[0]) <= F.col(span[1])).withColumn("_level", level)
    return proper.withColumn("_slice", F.explode(F.sequence(first, last)))


def on_all_levels(df: DataFrame, span: tuple[str, str], width: int = 366) -> DataFrame:
    """A row per slice that its span touches, on every level."""
    return _sliced(df, span, width, F.explode(F.array(*map(F.lit, range(LEVELS)))))


def on_own_level(df: DataFrame, span: tuple[str, str], width: int = 366) -> DataFrame:
    """A row per slice that its span touches on the first level with slices as long: at most two."""
    return _sliced(df, span, width, _level_of(*map(F.col, span), width))


def _level_of(first: Column, last: Column, width: int) -> Column:
    """First level with slices as long as a span."""
    days = day_number(last) - day_number(first) + 1
    level = F.lit(LEVELS - 1)
    for i in range(LEVELS - 2, -1, -1):
        level = F.when(days <= width * WIDER**i, F.lit(i)).otherwise(level)
    return level


def _within_reach(left: DataFrame, days: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str],
                  width: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join in slices; what ``right`` has before or after all of ``left`` (and of ``days``) has none."""
    proper = F.col(left_span[0]) <= F.col(left_span[1])
    reach = days.where(proper).agg(F.min(left_span[0]).alias("_first"), F.max(left_span[1]).alias("_last"))
    ends = {name: reach.select(name).scalar() for name in ("_first", "_last")}
    levels = F.explode(F.sequence(F.lit(0), _level_of(F.col("_first"), F.col("_last"), width)))
    cut = _sliced(left.where(proper).withColumns(ends), left_span, width, levels).drop("_first", "_last")
    kept = right.where(F.col(right_span[0]) <= F.col(right_span[1])).withColumns(ends).withColumns({
        "_first": F.greatest(right_span[0], "_first"), "_last": F.least(right_span[1], "_last"),
    })
    return cut, on_own_level(kept, ("_first", "_last"), width).drop("_first", "_last")


def in_observation(events: DataFrame, observation_period: DataFrame, prior: int = 0, post: int = 0) -> DataFrame:
    """Attach the observation period that holds the event's start date.

    Also asks for ``prior`` days of observation before and ``post`` days after
    it. Few periods per person meet many events, so a hot person is a skewed
    join that AQE splits on the event side.
    """
    period = observation_period.select(
        "person_id",
        F.col("observation_period_start_date").alias("op_start_date"),
        F.col("observation_period_end_date").alias("op_end_date"),
    )
    return (
        events.join(period, "person_id")
        .where(F.date_add("op_start_date", prior) <= F.col("start_date"))
        .where(F.date_add("start_date", post) <= F.col("op_end_date"))
    )


# Rows of one person and day from which on they are ordered in ranges.
HOT_DAY = 1_000_000


def number_events(df: DataFrame, key: str = "person_id", day: str = "sort_date",
                  ties: Sequence[str] = ("event_id",), name: str = "ordinal", hot_day: int = HOT_DAY) -> DataFrame:
    """Exact running number of each event of a person by date.

    A number is the count of the person's events on earlier days plus the place
    within the day; only day counts of a person ever meet in one task. A day with
    more than ``hot_day`` rows is cut into ranges of its ``ties``; a place in it is
    the rows of the ranges before and the place within its own.
    """
    per_day = df.groupBy(key, day).agg(F.count("*").alias("_n"))
    hot = per_day.where(F.col("_n") > hot_day).select(key, day)
    if hot.isEmpty():
        placed = df.withColumn("_place", F.row_number().over(W.partitionBy(key, day).orderBy(*ties)))
    else:
        # At most as many such days as the table has rows by hot_day.
        hot = broadcast_if_small(hot)
        rest = df.join(hot, [key, day], "left_anti")
        rest = rest.withColumn("_place", F.row_number().over(W.partitionBy(key, day).orderBy(*ties)))
        placed = rest.unionByName(_places_by_range(df.join(hot, [key, day], "left_semi"), [key, day], ties).select(*rest.columns))
    earlier = F.sum("_n").over(W.partitionBy(key).orderBy(day).rowsBetween(W.unboundedPreceding, -1))
    offsets = per_day.select(key, day, F.coalesce(earlier, F.lit(0)).alias("_offset"))
    return (
        placed.join(offsets, [key, day])
        .withColumn(name, (F.col("_offset") + F.col("_place")).cast("long"))
        .drop("_offset", "_place")
    )


def _places_by_range(df: DataFrame, keys: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Add ``_place``, the row's number within its ``keys`` by ``ties``, of which no task sees all.

    Rows are dealt by ranges of the whole order, which split a large group; the
    ranges are kept (a checkpoint), since counts and places must see the same ones.
    """
    dealt = cut_lineage(df.repartitionByRange(*keys, *ties).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_rows"))
    earlier = F.sum("_rows").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    before = sizes.select(*keys, "_range", F.coalesce(earlier, F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*ties))
    return dealt.withColumn("_within", within).join(F.broadcast(before), [*keys, "_range"]).withColumn("_place", F.col("_before") + F.col("_within"))


def all_of(conditions: Sequence[Column]) -> Column:
    """Conjunction of a list of conditions; true for an empty list."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
