"""When a person leaves a cohort."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators.intervals import collapse_eras, scan_days
from cohortry.operators.vocabulary import Codesets
from cohortry.sources.cdm import Cdm


@dataclass(frozen=True)
class ObservationEnd:
    """Stay until the observation period ends."""

    def ends(self, cdm: Cdm, codes: Codesets | None, index: DataFrame) -> DataFrame:
        return index.withColumn("exit_date", F.col("op_end_date"))


@dataclass(frozen=True)
class DateOffset:
    """Stay a fixed number of days from the event's start or end, not less than to its start.

    The observation period does not cut this short; an event without an end
    leaves on its start day.
    """

    field: str
    days: int

    def ends(self, cdm: Cdm, codes: Codesets | None, index: DataFrame) -> DataFrame:
        moved = F.date_add(f"{self.field}_date", self.days)
        return index.withColumn("exit_date", F.greatest(moved, F.col("start_date")))


@dataclass(frozen=True)
class DrugEra:
    """Stay while a drug is taken without a gap of more than ``gap`` days."""

    codeset: int
    gap: int = 30
    offset: int = 0

    def ends(self, cdm: Cdm, codes: Codesets | None, index: DataFrame) -> DataFrame:
        eras = drug_eras(cdm, codes[self.codeset], index.select("person_id").distinct(), self.gap, self.offset)
        facts = eras.select(
            "person_id", F.col("end_date").alias("day"), F.col("start_date").alias("_era_start"),
            F.col("end_date").alias("_era_end"),
        )
        points = index.withColumn("day", F.col("start_date"))
        # Eras do not overlap: the first one to end on or after the index day is the only candidate.
        seen = scan_days(points, facts, ["person_id"], {"_era_start": "min", "_era_end": "min"}, forward=True)
        in_era = F.when(F.col("_era_start") <= F.col("start_date"), F.col("_era_end"))
        return seen.withColumn("exit_date", F.least(in_era, F.col("op_end_date"))).select(*index.columns, "exit_date")


def drug_eras(cdm: Cdm, codeset: DataFrame, persons: DataFrame | None = None, gap: int = 30,
              offset: int = 0) -> DataFrame:
    """Periods of continuous exposure to a codeset by standard or source concept.

    The table is scanned once: each row asks for its concepts, and the codeset
    comes before anything is shuffled.
    """
    exposure = cdm["drug_exposure"]
    start = F.col("drug_exposure_start_date")
    end = F.coalesce("drug_exposure_end_date", F.date_add(start, F.col("days_supply")), F.date_add(start, 1))
    asked = exposure.select(
        "person_id", start.alias("start_date"), end.alias("end_date"),
        F.explode(F.array_distinct(F.array("drug_concept_id", "drug_source_concept_id"))).alias("concept_id"),
    )
    taken = asked.join(codeset, "concept_id", "left_semi").drop("concept_id")
    if persons is not None:
        taken = taken.join(persons, "person_id", "left_semi")
    eras = collapse_eras(taken, ["person_id"], gap)
    return eras.withColumn("end_date", F.date_add("end_date", offset))


def censor_dates(cdm: Cdm, codes: Codesets | None, index: DataFrame, events: Sequence) -> DataFrame:
    """Add ``censor_date``: the first censoring event from the index day to the end of observation."""
    found = events[0].frame(cdm, codes).select("person_id", "start_date")
    for one in events[1:]:
        found = found.unionByName(one.frame(cdm, codes).select("person_id", "start_date"))
    facts = found.distinct().select("person_id", F.col("start_date").alias("day"), F.col("start_date").alias("_next"))
    points = index.withColumn("day", F.col("start_date"))
    seen = scan_days(points, facts, ["person_id"], {"_next": "min"}, forward=True)
    censor = F.when(F.col("_next") <= F.col("op_end_date"), F.col("_next"))
    return seen.withColumn("censor_date", censor).select(*index.columns, "censor_date")
