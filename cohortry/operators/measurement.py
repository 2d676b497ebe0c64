"""Rises of a measured value within a few days."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortry.functions.expressions import day_number
from cohortry.operators.dominance import ranked, runs_below, runs_of
from cohortry.operators.events import FrameEvents
from cohortry.operators.vocabulary import Codesets
from cohortry.sources.cdm import Cdm


@dataclass(frozen=True)
class Change:
    """One rule for a rise: within ``days`` by more than ``diff`` or by a factor above ``ratio``.

    With ``units`` both values must carry the same one of these units.
    ``report_earlier`` names the earlier of the two measurements as the event, once for every pair.
    """

    codeset: int
    days: int
    diff: float | None = None
    ratio: float | None = None
    units: tuple[int, ...] = ()
    report_earlier: bool = False


def _measured(cdm: Cdm, codes: Codesets | None, change: Change) -> tuple[DataFrame, list[str]]:
    """Positive values that a rule looks at, and what two of them must share."""
    found = cdm["measurement"].where(F.col("value_as_number") > 0)
    if change.codeset is not None:
        codeset = codes[change.codeset]
        found = found.join(codeset, found["measurement_concept_id"] == codeset["concept_id"], "left_semi")
    keys = ["person_id"]
    if change.units:
        found = found.where(F.col("unit_concept_id").isin(*change.units))
        keys.append("unit_concept_id")
    return found, keys


def _rose(change: Change, low: Column) -> Column:
    value, rose = F.col("value_as_number"), F.lit(False)
    if change.diff is not None:
        rose |= (value - low) > change.diff
    if change.ratio is not None:
        rose |= (value / low) > change.ratio
    return rose


def _as_events(rows: DataFrame, event: Column) -> DataFrame:
    date = F.col("measurement_date")
    return rows.select(
        "person_id",
        event.alias("event_id"),
        date.alias("start_date"),
        F.date_add(date, 1).alias("end_date"),
        F.col("measurement_concept_id").alias("target_concept_id"),
        "visit_occurrence_id",
        date.alias("sort_date"),
    )


def measurement_change(cdm: Cdm, codes: Codesets | None, change: Change) -> DataFrame:
    """Measurements that rose against one of up to ``days`` days before.

    A value rose against some earlier value exactly if it rose against the
    lowest one, so the lowest value per day and a running minimum over days take
    the place of a self join, and each later measurement is reported once. Where
    the earlier one is the event, every partner is reported: see
    ``measurement_rises``.
    """
    if change.report_earlier:
        return _as_events(measurement_rises(cdm, codes, change), F.col("earlier_id"))
    found, keys = _measured(cdm, codes, change)
    lowest = found.groupBy(*keys, "measurement_date").agg(F.min("value_as_number").alias("low"))
    before = W.partitionBy(*keys).orderBy(day_number(F.col("measurement_date"))).rangeBetween(-change.days, 0)
    lowest = lowest.withColumn("low", F.min("low").over(before))
    risen = found.join(lowest, [*keys, "measurement_date"]).where(_rose(change, F.col("low")))
    return _as_events(risen, F.col("measurement_id"))


def measurement_rises(cdm: Cdm, codes: Codesets | None, change: Change) -> DataFrame:
    """Every later measurement with every earlier one (``earlier_id``) it rose against.

    Days are the slices: a later value asks each of the ``days`` days up to its
    own. The values of a person's day are ranked, and those low enough are the
    ranks up to a bound: a few whole runs, which the later value is joined with.
    So the work follows the pairs that are reported and not those that could be.
    """
    found, keys = _measured(cdm, codes, change)
    low = F.col("value_as_number")
    slim = found.select(*keys, F.col("measurement_date").alias("day"), low.alias("y"), F.col("measurement_id").alias("earlier_id"))
    slice_keys = [*keys, "day"]
    ranks = ranked(slim, slice_keys)
    # The bound is a little too high, so that rounding loses no pair; the rule itself decides.
    bounds = []
    if change.diff is not None:
        bounds.append(low - change.diff + F.abs(low) * 1e-9 + abs(change.diff) * 1e-9)
    if change.ratio is not None:
        bounds.append(low / change.ratio * (1 + 1e-9))
    bound = bounds[0] if len(bounds) == 1 else F.greatest(*bounds)
    back = F.explode(F.sequence(F.lit(0), F.lit(change.days)))
    asked = found.withColumn("y", bound).withColumn("_back", back).withColumn("day", F.date_sub("measurement_date", F.col("_back"))).drop("_back")
    # ``runs_below`` keeps another column "day" apart from the one it ranks by; here the day is a key.
    named = asked.withColumnRenamed("day", "_day")
    runs = runs_below(named.withColumn("day", F.col("measurement_date")), ranks.withColumnRenamed("day", "_day"), [*keys, "_day"]).drop("day", "y")
    members = runs_of(slim, ranks, slice_keys).withColumnRenamed("day", "_day").withColumnRenamed("y", "_low")
    pairs = runs.join(members, [*keys, "_day", "level", "run"])
    return pairs.where(_rose(change, F.col("_low"))).drop("_day", "_low", "level", "run")


def measurement_changes(cdm: Cdm, codes: Codesets | None, changes: Sequence[Change], first: bool = False) -> FrameEvents:
    """Union of several rules as events of a cohort definition."""
    together = measurement_change(cdm, codes, changes[0])
    for change in changes[1:]:
        together = together.unionByName(measurement_change(cdm, codes, change))
    return FrameEvents(together, first)


