"""Concept sets, event scans and event filters."""

from __future__ import annotations

import datetime as dt

from cohortry.operators.criteria import Demographic, all_in
from cohortry.operators.events import Events, events
from cohortry.operators.vocabulary import (
    CLINICAL_FINDING,
    GENERAL_NAMES,
    HIGH_LEVEL_GROUPS,
    Codesets,
    codesets,
    concept_set,
    concepts,
    condition_groups,
    drug_groups,
    without,
)
from contract.registry import query
from contract.views import PART

URGENT, HIGH, MEDIUM, LOW = 5000001, 5000002, 5000003, 5000005
BRAND, TYPE = 3000000, 4000000

# Event scans as SQL, by domain.
EVENT_SQL = {
    "condition": """select person_id, condition_occurrence_id as event_id, condition_start_date as start_date,
        coalesce(condition_end_date, condition_start_date + 1) as end_date, condition_concept_id as target_concept_id,
        visit_occurrence_id, condition_start_date as sort_date from condition_occurrence""",
    "observation": """select person_id, observation_id as event_id, observation_date as start_date,
        observation_date + 1 as end_date, observation_concept_id as target_concept_id, visit_occurrence_id,
        observation_date as sort_date from observation""",
    "measurement": """select person_id, measurement_id as event_id, measurement_date as start_date,
        measurement_date + 1 as end_date, measurement_concept_id as target_concept_id, visit_occurrence_id,
        measurement_date as sort_date from measurement""",
    "procedure": """select person_id, procedure_occurrence_id as event_id, procedure_date as start_date,
        procedure_date + 1 as end_date, procedure_concept_id as target_concept_id, visit_occurrence_id,
        procedure_date as sort_date from procedure_occurrence""",
    "drug": """select person_id, drug_exposure_id as event_id, drug_exposure_start_date as start_date,
        coalesce(drug_exposure_end_date, drug_exposure_start_date + 1) as end_date,
        drug_concept_id as target_concept_id, visit_occurrence_id, drug_exposure_start_date as sort_date
        from drug_exposure""",
    "device": """select person_id, device_exposure_id as event_id, device_exposure_start_date as start_date,
        device_exposure_end_date as end_date, device_concept_id as target_concept_id, visit_occurrence_id,
        device_exposure_start_date as sort_date from device_exposure""",
    "visit": """select person_id, visit_occurrence_id as event_id, visit_start_date as start_date,
        visit_end_date as end_date, visit_concept_id as target_concept_id, visit_occurrence_id,
        visit_start_date as sort_date from visit_occurrence""",
    "discharge": """select person_id, visit_occurrence_id as event_id, visit_end_date as start_date,
        visit_end_date as end_date, visit_concept_id as target_concept_id, visit_occurrence_id,
        visit_end_date as sort_date from visit_occurrence""",
    "death": """select person_id, person_id as event_id, death_date as start_date, death_date + 1 as end_date,
        coalesce(cause_concept_id, 0) as target_concept_id, cast(null as bigint) as visit_occurrence_id,
        death_date as sort_date from death""",
    "observation_period": """select person_id, observation_period_id as event_id,
        observation_period_start_date as start_date, observation_period_end_date as end_date,
        period_type_concept_id as target_concept_id, cast(null as bigint) as visit_occurrence_id,
        observation_period_start_date as sort_date from observation_period""",
    "drug_era": """select person_id, drug_era_id as event_id, drug_era_start_date as start_date,
        drug_era_end_date as end_date, drug_concept_id as target_concept_id,
        cast(null as bigint) as visit_occurrence_id, drug_era_start_date as sort_date from drug_era""",
}

# Concept sets as SQL: everything below a concept that is valid, and the concept itself.
def below(*ids: int) -> str:
    listed = ", ".join(map(str, ids))
    return f"""(select concept_id from concept where concept_id in ({listed}) union
        select c.concept_id from concept c join concept_ancestor a on c.concept_id = a.descendant_concept_id
        where a.ancestor_concept_id in ({listed}) and c.invalid_reason is null)"""


def only(*ids: int) -> str:
    return f"(select concept_id from concept where concept_id in ({', '.join(map(str, ids))}))"


@query("v1_concept_set_listed", f"select concept_id from concept where concept_id in ({PART}, {PART + 1}, {PART + 50}, 7)")
def _(s):
    return concept_set(s.cdm, concepts(PART, PART + 1, PART + 50, 7, descendants=False))


@query("v2_concept_set_descendants",
       f"select concept_id from {below(BRAND + 1, BRAND + 2, PART + 50)} union select concept_id from {only(TYPE + 1)}")
def _(s):
    return concept_set(s.cdm, concepts(BRAND + 1, BRAND + 2, PART + 50), concepts(TYPE + 1, descendants=False))


@query("v3_concept_set_excluded", f"""
    select concept_id from {below(TYPE + 1, TYPE + 2)} i where not exists
        (select 1 from {below(BRAND + 1, BRAND + 2, BRAND + 3)} e where e.concept_id = i.concept_id)""")
def _(s):
    return concept_set(s.cdm, concepts(TYPE + 1, TYPE + 2), without(BRAND + 1, BRAND + 2, BRAND + 3))


@query("v4_codesets", f"""
    select 0 as codeset_id, concept_id from {below(BRAND + 4)} union all
    select 1, concept_id from {only(URGENT, HIGH)} union all
    select 2, concept_id from {below(6000002)}""")
def _(s):
    return codesets(s.cdm, {
        0: [concepts(BRAND + 4)], 1: [concepts(URGENT, HIGH, descendants=False)], 2: [concepts(6000002)],
    })


DRUG_GROUPS_SQL = """
    select distinct descendant_concept_id, ancestor_concept_id from concept_ancestor
    join concept on ancestor_concept_id = concept_id
    where ((vocabulary_id = 'ATC' and length(rtrim(concept_code)) in (1, 3, 4, 5))
        or (standard_concept = 'S' and concept_class_id = 'Ingredient' and domain_id = 'Drug')) and concept_id <> 0"""

_TOO_GENERAL = " or ".join(f"concept_name like '{pattern}'" for pattern in GENERAL_NAMES)
CONDITION_GROUPS_SQL = f"""
    with below_root as (select descendant_concept_id as id, min_levels_of_separation as level from concept_ancestor
        where ancestor_concept_id = {CLINICAL_FINDING}),
    named as (select concept_id from concept where domain_id = 'Condition' and not ({_TOO_GENERAL}))
    select distinct descendant_concept_id, ancestor_concept_id from concept_ancestor
    where ancestor_concept_id in (select concept_id from named)
      and ancestor_concept_id in (select id from below_root where level > 2 or id in {HIGH_LEVEL_GROUPS})"""

query("v5_drug_groups", DRUG_GROUPS_SQL)(lambda s: drug_groups(s.cdm))
query("v6_condition_groups", CONDITION_GROUPS_SQL)(lambda s: condition_groups(s.cdm))


def scan(name: str, spec: Events, definition=(), where: str = "true", sql: str | None = None, measured: bool = False):
    """Register an event scan; ``where`` is put on the domain's SQL."""
    oracle = f"select * from ({sql or EVENT_SQL[spec.domain]}) e where {where}"

    def plan(s):
        bundle = s.measured if measured else s.cdm
        return events(bundle, spec, Codesets(bundle, {0: list(definition)}) if definition else None)

    query(name, oracle)(plan)


in_set = "target_concept_id in "
scan("d1_condition_events", Events("condition", 0), [concepts(URGENT, MEDIUM)], in_set + only(URGENT, MEDIUM))
scan("d2_observation_events", Events("observation", 0), [concepts(PART + 21, PART + 22)],
     in_set + only(PART + 21, PART + 22))
scan("d3_measurement_events", Events("measurement", 0), [concepts(PART + 31, PART + 34)],
     in_set + only(PART + 31, PART + 34))
scan("d4_procedure_events", Events("procedure", 0), [concepts(PART + 2, PART + 3)], in_set + only(PART + 2, PART + 3))
scan("d5_drug_events", Events("drug", 0), [concepts(BRAND + 1, BRAND + 2)], in_set + below(BRAND + 1, BRAND + 2))
scan("d6_device_events", Events("device", 0), [concepts(PART + 11, PART + 12)], in_set + only(PART + 11, PART + 12))
scan("d7_visit_events", Events("visit", 0), [concepts(PART + 51)], in_set + only(PART + 51))
scan("d8_visit_end_events", Events("visit", 0, anchor="end"), [concepts(PART + 51)], in_set + only(PART + 51),
     EVENT_SQL["discharge"])
scan("d9_death_events", Events("death"))
scan("d10_observation_period_events", Events("observation_period"))
scan("d11_drug_era_events", Events("drug_era", 0), [concepts(BRAND + 5)], in_set + below(BRAND + 5))
scan("d12_source_concept_events", Events("condition", 0, source=True), [concepts(PART + 3, PART + 5)],
     f"event_id in (select condition_occurrence_id from condition_occurrence "
     f"where condition_source_concept_id in ({PART + 3}, {PART + 5}))")

scan("p1_start_after", Events("procedure", after=dt.date(1999, 6, 1)), where="start_date > date '1999-06-01'")
scan("p2_start_between", Events("condition", between=(dt.date(1997, 9, 1), dt.date(1998, 4, 1))),
     where="start_date between date '1997-09-01' and date '1998-04-01'")
scan("p3_value_between", Events("measurement", value_between=(50.0, 120.5)),
     where="event_id in (select measurement_id from measurement where value_as_number between 50.0 and 120.5)")
scan("p4_unit_in", Events("measurement", units=(1, 7)),
     where="event_id in (select measurement_id from measurement where unit_concept_id in (1, 7))")
scan("p5_value_concept_in", Events("observation", value_concepts=(1, 2)),
     where="event_id in (select observation_id from observation where value_as_concept_id in (1, 2))")
scan("p6_type_concept_in", Events("condition", type_concepts=(2, 3)),
     where="event_id in (select condition_occurrence_id from condition_occurrence "
           "where condition_type_concept_id in (2, 3))")
scan("p7_gender_in", Events("condition", genders=(8532,)),
     where="person_id in (select person_id from person where gender_concept_id = 8532)")
scan("p8_age_at_event", Events("condition", min_age=18, below_age=65),
     where="(select year(e.start_date) - p.year_of_birth from person p where p.person_id = e.person_id) "
           "between 18 and 64")
# The first event of the codeset is chosen before the date filter looks at it.
query("p9_first_event", f"""
    select person_id, event_id, start_date, end_date, target_concept_id, visit_occurrence_id, sort_date from (
        select *, row_number() over (partition by person_id order by start_date, event_id) as n
        from ({EVENT_SQL['condition']}) c where target_concept_id in ({HIGH}, {MEDIUM})) f
    where n = 1 and start_date > date '1996-01-01'""")(
    lambda s: events(s.cdm, Events("condition", 0, first=True, after=dt.date(1996, 1, 1)),
                     Codesets(s.cdm, {0: [concepts(HIGH, MEDIUM)]})))


@query("p10_demographic_dates", f"""
    select e.* from ({EVENT_SQL['condition']}) e join observation_period op on op.person_id = e.person_id
        and e.start_date between op.observation_period_start_date and op.observation_period_end_date
    where e.start_date between date '1996-09-01' and date '1999-12-31' and e.end_date > date '1997-01-01'""")
def _(s):
    dates = Demographic(starts_between=(dt.date(1996, 9, 1), dt.date(1999, 12, 31)), ends_after=dt.date(1997, 1, 1))
    return events(s.cdm, Events("condition", group=all_in(dates)))
