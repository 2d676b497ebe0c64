"""Clinical events of every domain in one shape, and the filters on them."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.expressions import age_at
from cohortry.operators.intervals import all_of, first_per
from cohortry.operators.vocabulary import Codesets
from cohortry.schemas import EVENT
from cohortry.sources.cdm import Cdm

# How the end date of a domain's events is found.
STORED, NEXT_DAY, STORED_OR_NEXT_DAY = "stored", "next day", "stored or next day"


@dataclass(frozen=True)
class Domain:
    """Where a domain keeps its columns."""

    table: str
    event_id: str
    start: str
    concept: str
    end: str | None = None
    end_rule: str = STORED
    source_concept: str | None = None
    type_concept: str | None = None
    visit: bool = True


DOMAINS = {
    "condition": Domain("condition_occurrence", "condition_occurrence_id", "condition_start_date",
                        "condition_concept_id", "condition_end_date", STORED_OR_NEXT_DAY,
                        "condition_source_concept_id", "condition_type_concept_id"),
    "observation": Domain("observation", "observation_id", "observation_date", "observation_concept_id",
                          end_rule=NEXT_DAY),
    "measurement": Domain("measurement", "measurement_id", "measurement_date", "measurement_concept_id",
                          end_rule=NEXT_DAY),
    "procedure": Domain("procedure_occurrence", "procedure_occurrence_id", "procedure_date",
                        "procedure_concept_id", end_rule=NEXT_DAY),
    "drug": Domain("drug_exposure", "drug_exposure_id", "drug_exposure_start_date", "drug_concept_id",
                   "drug_exposure_end_date", STORED_OR_NEXT_DAY, "drug_source_concept_id"),
    "device": Domain("device_exposure", "device_exposure_id", "device_exposure_start_date", "device_concept_id",
                     "device_exposure_end_date"),
    "visit": Domain("visit_occurrence", "visit_occurrence_id", "visit_start_date", "visit_concept_id",
                    "visit_end_date"),
    "death": Domain("death", "person_id", "death_date", "cause_concept_id", end_rule=NEXT_DAY, visit=False),
    "observation_period": Domain("observation_period", "observation_period_id", "observation_period_start_date",
                                 "period_type_concept_id", "observation_period_end_date", visit=False),
    "drug_era": Domain("drug_era", "drug_era_id", "drug_era_start_date", "drug_concept_id", "drug_era_end_date",
                       visit=False),
}


@dataclass(frozen=True)
class Events:
    """Which events of a domain to take.

    ``first`` keeps a person's earliest event of the codeset *before* the other
    filters look at it. ``group`` keeps the events that themselves satisfy a
    criteria group.
    """

    domain: str
    codeset: int | None = None
    source: bool = False
    anchor: str = "start"
    first: bool = False
    after: dt.date | None = None
    between: tuple[dt.date, dt.date] | None = None
    value_between: tuple[float, float] | None = None
    units: tuple[int, ...] = ()
    value_concepts: tuple[int, ...] = ()
    type_concepts: tuple[int, ...] = ()
    genders: tuple[int, ...] = ()
    min_age: int | None = None
    below_age: int | None = None
    group: object | None = field(default=None)

    def frame(self, cdm: Cdm, codes: Codesets | None = None) -> DataFrame:
        return events(cdm, self, codes)


@dataclass(frozen=True)
class FrameEvents:
    """Events computed elsewhere (for example measurement changes), used like ``Events``."""

    df: DataFrame
    first: bool = False

    def frame(self, cdm: Cdm, codes: Codesets | None = None) -> DataFrame:
        df = self.df.select(*EVENT)
        return first_per(df, ["person_id"], ["start_date", "event_id"]) if self.first else df


def events(cdm: Cdm, query: Events, codes: Codesets | None = None) -> DataFrame:
    """Scan one domain into the normalised event columns."""
    domain = DOMAINS[query.domain]
    raw = cdm[domain.table]
    if query.codeset is not None:
        key = domain.source_concept if query.source else domain.concept
        chosen = codes[query.codeset]
        raw = raw.join(chosen, raw[key] == chosen["concept_id"], "left_semi")
    start = F.col(domain.end if query.anchor == "end" else domain.start)
    if query.first:
        raw = first_per(raw, ["person_id"], [domain.start, domain.event_id])
    found = raw.where(all_of(_conditions(query, domain, start))).select(
        "person_id",
        F.col(domain.event_id).cast("long").alias("event_id"),
        start.alias("start_date"),
        _end_date(domain, start, query.anchor).alias("end_date"),
        _concept(query, domain).alias("target_concept_id"),
        (F.col("visit_occurrence_id") if domain.visit else F.lit(None)).cast("long").alias("visit_occurrence_id"),
        start.alias("sort_date"),
    )
    found = with_person(cdm, found, query.genders, query.min_age, query.below_age)
    if query.group is not None:
        from cohortry.operators.criteria import where_group

        found = where_group(cdm, codes, found, query.group)
    return found


def _conditions(query: Events, domain: Domain, start: Column) -> list[Column]:
    found = []
    if query.after is not None:
        found.append(start > F.lit(query.after))
    if query.between is not None:
        found.append(start.between(*map(F.lit, query.between)))
    if query.value_between is not None:
        found.append(F.col("value_as_number").between(*query.value_between))
    if query.units:
        found.append(F.col("unit_concept_id").isin(*query.units))
    if query.value_concepts:
        found.append(F.col("value_as_concept_id").isin(*query.value_concepts))
    if query.type_concepts:
        found.append(F.col(domain.type_concept).isin(*query.type_concepts))
    return found


def _end_date(domain: Domain, start: Column, anchor: str) -> Column:
    if anchor == "end":
        return start
    if domain.end_rule == NEXT_DAY:
        return F.date_add(start, 1)
    if domain.end_rule == STORED_OR_NEXT_DAY:
        return F.coalesce(F.col(domain.end), F.date_add(start, 1))
    return F.col(domain.end)


def _concept(query: Events, domain: Domain) -> Column:
    concept = F.col(domain.concept).cast("long")
    return F.coalesce(concept, F.lit(0)) if query.domain == "death" else concept


def with_person(cdm: Cdm, events: DataFrame, genders: tuple[int, ...] = (), min_age: int | None = None,
                below_age: int | None = None) -> DataFrame:
    """Keep events of persons of given genders and of a given age at the start date."""
    if not genders and min_age is None and below_age is None:
        return events
    person = cdm["person"]
    if genders:
        person = person.where(F.col("gender_concept_id").isin(*genders))
    if min_age is None and below_age is None:
        return events.join(person.select("person_id"), "person_id", "left_semi")
    age = age_at(F.col("start_date"), F.col("year_of_birth"))
    joined = events.join(person.select("person_id", "year_of_birth"), "person_id")
    if min_age is not None:
        joined = joined.where(age >= min_age)
    if below_age is not None:
        joined = joined.where(age < below_age)
    return joined.drop("year_of_birth")
