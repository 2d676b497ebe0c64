"""Criteria: does an index event have the right other events around it?

All criteria of all groups of a definition are answered in one pass. The other
events are reduced to counts per person, criterion and day; every index event
adds the first and last day of its window as points; running counts then give
"events up to the last day" minus "events before the first day". Windows that
bound the end of the other event, and counts of different concepts, are counts
of corners (``dominance``), again for all criteria at once. No pair of index
event and other event is formed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.expressions import age_at
from cohortry.operators.dominance import count_dominated, with_previous
from cohortry.operators.intervals import in_observation, overlap_join, scan_days
from cohortry.operators.vocabulary import Codesets
from cohortry.sources.cdm import Cdm

# Number of the last day a date can hold: no event lies beyond it.
LAST_DAY = 2**31 - 1

# Columns that make an index event. Rows that agree in these get the same answer.
SHAPE = ("person_id", "start_date", "end_date", "op_start_date", "op_end_date")


@dataclass(frozen=True)
class Edge:
    """A day relative to the index event: ``days`` after its start or end."""

    days: int
    anchor: str = "start"


def day(days: int, anchor: str = "start") -> Edge:
    return Edge(days, anchor)


@dataclass(frozen=True)
class Window:
    """Where the other event must lie; ``None`` means no bound of its own.

    Unless ``ignore_observation`` is set, the other event must also start within
    the observation period of the index event. ``ends_in_observation`` asks that
    it end there as well.
    """

    starts_from: Edge | None = None
    starts_to: Edge | None = None
    ends_from: Edge | None = None
    ends_to: Edge | None = None
    ends_in_observation: bool = False
    ignore_observation: bool = False

    @property
    def looks_at_end(self) -> bool:
        return self.ends_from is not None or self.ends_to is not None or self.ends_in_observation


@dataclass(frozen=True)
class Criterion:
    """At least (or exactly) so many other events in a window.

    With ``distinct`` the different concepts are counted instead of the events.
    """

    events: object
    window: Window = Window()
    at_least: int | None = 1
    exactly: int | None = None
    distinct: bool = False

    def satisfied(self, hits: Column) -> Column:
        return hits == self.exactly if self.exactly is not None else hits >= self.at_least

    @property
    def satisfied_by_none(self) -> bool:
        """True if an index event without any such other event passes."""
        return self.exactly == 0 if self.exactly is not None else self.at_least <= 0

    @property
    def by_reach(self) -> bool:
        """True if the answer follows from the latest end among earlier starts.

        That needs a question of existence, a start window without a lower bound
        and an end window without an upper one (but for the observation period).
        """
        w = self.window
        existence = self.exactly == 0 or (self.exactly is None and self.at_least == 1)
        return (
            w.ends_from is not None and w.ends_to is None and w.starts_from is None
            and not w.ignore_observation and existence and not self.distinct
        )

    @property
    def by_corners(self) -> bool:
        """True if start and end of the event (or concept and previous occurrence) must be looked at together."""
        return self.distinct != self.window.looks_at_end and not self.by_reach

    @property
    def by_pairs(self) -> bool:
        """Different concepts among events whose end is bounded too: three bounds at a time."""
        return self.distinct and self.window.looks_at_end


@dataclass(frozen=True)
class Demographic:
    """A condition on the person and the dates of the index event itself."""

    starts_between: tuple[dt.date, dt.date] | None = None
    ends_after: dt.date | None = None
    genders: tuple[int, ...] = ()
    min_age: int | None = None
    below_age: int | None = None

    @property
    def needs_person(self) -> bool:
        return bool(self.genders) or self.min_age is not None or self.below_age is not None

    def satisfied(self) -> Column:
        found = F.lit(True)
        if self.starts_between is not None:
            found &= F.col("start_date").between(*map(F.lit, self.starts_between))
        if self.ends_after is not None:
            found &= F.col("end_date") > F.lit(self.ends_after)
        if self.genders:
            found &= F.col("gender_concept_id").isin(*self.genders)
        age = age_at(F.col("start_date"), F.col("year_of_birth"))
        if self.min_age is not None:
            found &= age >= self.min_age
        if self.below_age is not None:
            found &= age < self.below_age
        return F.coalesce(found, F.lit(False))


@dataclass(frozen=True)
class Group:
    """Members of which all, any, at least or at most ``n`` must hold."""

    mode: str
    members: tuple[Criterion | Demographic | Group, ...]
    n: int | None = None

    def satisfied(self, answer) -> Column:
        held = [answer(member).cast("int") for member in self.members]
        total = held[0]
        for one in held[1:]:
            total = total + one
        return {
            "all": lambda: total == len(held),
            "any": lambda: total > 0,
            "at_least": lambda: total >= self.n,
            "at_most": lambda: total <= self.n,
        }[self.mode]()


def all_in(*members) -> Group:
    return Group("all", members)


def any_in(*members) -> Group:
    return Group("any", members)


def at_least_in(n: int, *members) -> Group:
    return Group("at_least", members, n)


def shapes(events: DataFrame) -> DataFrame:
    """Distinct index events with the tie-breakers of the earliest source row."""
    return (
        events.groupBy("person_id", "start_date", "end_date")
        .agg(F.min(F.struct("rank", "event_id")).alias("_first"))
        .select("person_id", "start_date", "end_date", "_first.rank", "_first.event_id")
    )


def evaluate(cdm: Cdm, codes: Codesets | None, index: DataFrame, groups: Sequence[Group],
             names: Sequence[str]) -> DataFrame:
    """Add one boolean column per group to the index events.

    ``index`` has the columns of ``SHAPE`` (no two rows alike) and any others.
    """
    found = list(dict.fromkeys(leaf for group in groups for leaf in leaves(group)))
    criteria = [leaf for leaf in found if isinstance(leaf, Criterion)]
    columns = index.columns
    index = count_hits(cdm, codes, index, criteria)
    if any(isinstance(leaf, Demographic) and leaf.needs_person for leaf in found):
        person = cdm["person"].select("person_id", "year_of_birth", "gender_concept_id")
        index = index.join(person, "person_id", "left")

    def answer(member) -> Column:
        if isinstance(member, Group):
            return member.satisfied(answer)
        if isinstance(member, Demographic):
            return member.satisfied()
        return member.satisfied(F.col(f"_hits_{criteria.index(member)}"))

    flags = [group.satisfied(answer).alias(name) for group, name in zip(groups, names)]
    return index.select(*columns, *flags)


def leaves(group: Group):
    """Criteria and demographic conditions of a group and of those in it."""
    for member in group.members:
        if isinstance(member, Group):
            yield from leaves(member)
        else:
            yield member


def where_group(cdm: Cdm, codes: Codesets | None, events: DataFrame, group: Group) -> DataFrame:
    """Events that satisfy a group, each seen within its own observation period."""
    alike = events.select("person_id", "start_date", "end_date").distinct()
    judged = evaluate(cdm, codes, in_observation(alike, cdm["observation_period"]), [group], ["_kept"])
    kept = judged.where("_kept").select(
        F.col("person_id").alias("_person"), F.col("start_date").alias("_start"), F.col("end_date").alias("_end")
    )
    same = (
        (F.col("person_id") == F.col("_person"))
        & (F.col("start_date") == F.col("_start"))
        & F.col("end_date").eqNullSafe(F.col("_end"))
    )
    return events.join(kept, same, "left_semi")


def count_hits(cdm: Cdm, codes: Codesets | None, index: DataFrame, criteria: Sequence[Criterion]) -> DataFrame:
    """Add ``_hits_<i>``: how many events (or concepts) criterion ``i`` finds.

    The criteria that one running value answers are read off one scan, those that
    bound the end of the other event or count concepts off one count of corners;
    each takes all its criteria at once, so the index events are read a fixed
    number of times however many criteria there are.
    """
    if not criteria:
        return index
    numbered = list(enumerate(criteria))
    scanned = [(i, c) for i, c in numbered if not c.by_corners and not c.by_pairs]
    cornered = [(i, c) for i, c in numbered if c.by_corners]
    row = index.columns
    found = []
    if scanned:
        found.append(_count_by_scan(cdm, codes, index, scanned))
    else:
        found.append(index.withColumns({"criterion": F.lit(-1), "hits": F.lit(0).cast("long")}))
    if cornered:
        found.append(_count_by_corners(cdm, codes, index, cornered))
    together = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    hits = [
        F.sum(F.when(F.col("criterion") == i, F.col("hits")).otherwise(0)).alias(f"_hits_{i}")
        for i, _ in [*scanned, *cornered]
    ]
    index = together.groupBy(*row).agg(*hits) if hits else index
    for i, criterion in numbered:
        if criterion.by_pairs:
            index = count_by_pairs(cdm, codes, index, criterion, f"_hits_{i}")
    return index


def _edge(edge: Edge | None) -> Column | None:
    return None if edge is None else F.date_add(f"{edge.anchor}_date", edge.days)


def _later(*days: Column | None) -> Column:
    """Latest of the given days; NULL if any of them is NULL (``greatest`` skips NULLs)."""
    known = [d for d in days if d is not None]
    return known[0] if len(known) == 1 else F.when(_all_known(known), F.greatest(*known))


def _earlier(*days: Column | None) -> Column:
    known = [d for d in days if d is not None]
    return known[0] if len(known) == 1 else F.when(_all_known(known), F.least(*known))


def _all_known(days: Sequence[Column]) -> Column:
    found = F.lit(True)
    for one in days:
        found &= one.isNotNull()
    return found


def start_window(window: Window) -> tuple[Column | None, Column | None]:
    """First and last day on which the other event may start; None where nothing bounds it."""
    low, high = _edge(window.starts_from), _edge(window.starts_to)
    if window.ignore_observation:
        return low, high
    return _later(low, F.col("op_start_date")), _earlier(high, F.col("op_end_date"))


def _count_by_scan(cdm, codes, index, numbered) -> DataFrame:
    """``criterion, hits`` per index event, from running counts and running latest ends."""
    facts = _facts(cdm, codes, numbered)
    keys = ["person_id", "criterion", "op_start", "op_end"]
    seen = scan_days(_points(index, numbered), facts, keys, {"n": "sum", "reach": "max"})
    reached = [i for i, c in numbered if c.by_reach]
    counted = seen.groupBy(*index.columns, "criterion").agg(
        F.sum(F.col("sign") * F.coalesce("n", F.lit(0))).alias("n"),
        F.bool_or(F.coalesce(F.col("reach") >= F.col("need"), F.lit(False))).alias("reached"),
    )
    hits = F.when(F.col("criterion").isin(*reached), F.col("reached").cast("long")).otherwise(F.col("n"))
    return counted.select(*index.columns, "criterion", hits.alias("hits"))


def _facts(cdm, codes, numbered) -> DataFrame:
    """Counts (and latest ends) of the other events per criterion and day."""
    none = F.lit(None)
    parts = []
    for i, criterion in numbered:
        found = criterion.events.frame(cdm, codes).where(F.col("target_concept_id").isNotNull())
        if criterion.by_reach:
            found = in_observation(found.select("person_id", "start_date", "end_date"), cdm["observation_period"])
            if criterion.window.ends_in_observation:
                found = found.where(F.col("end_date") <= F.col("op_end_date"))
        part = found.select(
            "person_id",
            F.lit(i).alias("criterion"),
            (F.col("op_start_date") if criterion.by_reach else none).cast("date").alias("op_start"),
            (F.col("op_end_date") if criterion.by_reach else none).cast("date").alias("op_end"),
            F.col("start_date").alias("day"),
            "end_date",
        )
        parts.append(part)
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return together.groupBy("person_id", "criterion", "op_start", "op_end", "day").agg(
        F.count("*").alias("n"), F.max("end_date").alias("reach")
    )


def _points(index: DataFrame, numbered) -> DataFrame:
    """The days of each index event at which the running values are read."""
    asked = [point for i, c in numbered for point in scan_points(i, c)]
    return index.withColumn("_ask", F.explode(F.array(*asked))).select(*index.columns, "_ask.*")


def scan_points(i: int, criterion: Criterion, **more: Column) -> list[Column]:
    """Where a criterion reads the running values of an index event; ``more`` columns go along."""
    no_day = F.lit(None).cast("date")
    start = F.col("start_date")

    def point(at: Column, sign, op_start: Column = no_day, op_end: Column = no_day, need: Column = no_day) -> Column:
        sign = sign if isinstance(sign, Column) else F.lit(sign)
        return F.struct(
            F.lit(i).alias("criterion"), at.alias("day"), sign.cast("long").alias("sign"),
            op_start.alias("op_start"), op_end.alias("op_end"), need.alias("need"), *[c.alias(n) for n, c in more.items()],
        )

    low, high = start_window(criterion.window)
    if criterion.by_reach:
        need = F.when(high.isNotNull(), _edge(criterion.window.ends_from))
        return [point(F.coalesce(high, start), 0, F.col("op_start_date"), F.col("op_end_date"), need)]
    # An empty window reads both points with weight 0; without a first day nothing is taken off.
    bounds = [b for b in (low, high) if b is not None]
    weight = F.when(low <= high if len(bounds) == 2 else _all_known(bounds), 1).otherwise(0)
    until = F.date_from_unix_date(F.lit(LAST_DAY)) if high is None else F.coalesce(high, start)
    found = [point(until, weight)]
    if low is not None:
        found.append(point(F.coalesce(F.date_sub(low, 1), start), -weight))
    return found


# Day numbers below and above those of all dates.
BEFORE_ALL, AFTER_ALL = -(2**40), 2**40


def _count_by_corners(cdm, codes, index, numbered) -> DataFrame:
    """``criterion, hits`` per index event: signed counts of the corners of each criterion's rectangle."""
    facts = None
    for i, criterion in numbered:
        found = criterion.events.frame(cdm, codes).where(F.col("target_concept_id").isNotNull())
        if criterion.distinct:
            days = found.select("person_id", F.col("target_concept_id").alias("concept"), F.col("start_date").alias("day"))
            part = with_previous(days, ["person_id"], BEFORE_ALL)
        else:
            part = (
                found.where(F.col("end_date").isNotNull())
                .groupBy("person_id", F.col("start_date").alias("day"), F.unix_date("end_date").cast("long").alias("y"))
                .agg(F.count("*").alias("n"))
            )
        part = part.select("person_id", F.lit(i).alias("criterion"), "day", "y", "n")
        facts = part if facts is None else facts.unionByName(part)
    spread = index.withColumn("_ask", F.explode(F.flatten(F.array(*[corners(i, c) for i, c in numbered]))))
    points = spread.select(*index.columns, "_ask.*")
    parts = count_dominated(points, facts, ["person_id", "criterion"])
    return parts.groupBy(*index.columns, "criterion").agg(F.sum(F.col("sign") * F.col("n")).alias("hits"))


def corners(i: int, criterion: Criterion, **more: Column) -> Column:
    """Array of the corners of a criterion for an index event; empty where a bound is NULL or the window is. ``more`` columns go along."""
    window = criterion.window
    low, high = start_window(window)
    last = F.date_from_unix_date(F.lit(LAST_DAY))
    number = lambda date: F.unix_date(date).cast("long")
    below, above = F.lit(BEFORE_ALL), F.lit(AFTER_ALL)
    if criterion.distinct:
        ends = [(below if low is None else number(low) - 1, 1)]
        bounds = [b for b in (low, high) if b is not None]
        held = low <= high if len(bounds) == 2 else _all_known(bounds)
    else:
        ends_to = [d for d in (_edge(window.ends_to), F.col("op_end_date") if window.ends_in_observation else None) if d is not None]
        first, final = _edge(window.ends_from), _earlier(*ends_to) if ends_to else None
        ends = [(above if final is None else number(final), 1)]
        if first is not None:
            ends.append((number(first) - 1, -1))
        held = F.lit(True)
        for a, b in ((low, high), (first, final)):
            known = [d for d in (a, b) if d is not None]
            held &= a <= b if len(known) == 2 else _all_known(known)
    starts = [(last if high is None else high, 1)]
    if low is not None:
        starts.append((F.date_sub(low, 1), -1))
    signed = F.array(*[
        F.struct(F.lit(i).alias("criterion"), x.alias("day"), y.alias("y"), F.lit(s * t).cast("long").alias("sign"),
                 *[c.alias(n) for n, c in more.items()])
        for x, s in starts for y, t in ends
    ])
    return F.when(held, signed).otherwise(F.filter(signed, lambda _: F.lit(False)))


def count_by_pairs(cdm, codes, index, criterion: Criterion, name: str) -> DataFrame:
    """Different concepts in a window on start and end of the other event.

    Other events are first reduced to one of each (start, end, concept); the join
    then runs slice by slice.
    """
    window = criterion.window
    low, high = start_window(window)
    found = criterion.events.frame(cdm, codes).where(F.col("target_concept_id").isNotNull())
    other = found.select(
        "person_id", F.col("start_date").alias("_day"), F.col("end_date").alias("_end"),
        F.col("target_concept_id").alias("_concept"),
    ).distinct().withColumn("_same_day", F.col("_day"))
    ends = other.agg(F.min("_day").alias("low"), F.max("_day").alias("high"))
    spans = index.withColumns({
        "_low": ends.select("low").scalar() if low is None else low,
        "_high": ends.select("high").scalar() if high is None else high,
    })
    pairs = overlap_join(spans, other, ["person_id"], ("_low", "_high"), ("_day", "_same_day"))
    if window.ends_from is not None:
        pairs = pairs.where(F.col("_end") >= _edge(window.ends_from))
    if window.ends_to is not None:
        pairs = pairs.where(F.col("_end") <= _edge(window.ends_to))
    if window.ends_in_observation:
        pairs = pairs.where(F.col("_end") <= F.col("op_end_date"))
    row = index.columns
    counted = pairs.groupBy(*row).agg(F.count_distinct("_concept").alias(name))
    missing = index.withColumn(name, F.lit(0).cast("long"))
    return missing.unionByName(counted).groupBy(*row).agg(F.max(name).alias(name))
