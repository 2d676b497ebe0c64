"""Index events, criteria, inclusion rules, exits and whole cohorts."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import functions as F

from cohortry.operators.criteria import (
    Criterion,
    Demographic,
    Window,
    all_in,
    any_in,
    at_least_in,
    day,
    evaluate,
)
from cohortry.operators.events import Events, events
from cohortry.operators.exits import DateOffset, DrugEra, ObservationEnd, censor_dates, drug_eras
from cohortry.operators.intervals import collapse_eras, in_observation, number_events
from cohortry.operators.measurement import Change, measurement_change, measurement_changes
from cohortry.operators.vocabulary import Codesets, concepts
from cohortry.operators.censor import cohort_counts
from cohortry.operators.strata import GENDER, Stratum
from cohortry.plans.batch import build_cohorts
from cohortry.plans.cohort import (
    CohortSpec,
    build_cohort,
    cohort_rows,
    included_events,
    inclusion_mask,
    inclusion_result,
    primary_events,
    qualified_events,
)
from cohortry.plans.study import Study, update_study
from cohortry.sources.sinks import read_cohorts
from cohortry.sources.steps import Steps
from contract.events_queries import BRAND, EVENT_SQL, HIGH, LOW, MEDIUM, TYPE, URGENT, below
from contract.registry import query
from contract.views import PART, collapse_sql, stored_eras

INDEX = ("person_id", "start_date", "end_date", "op_start_date", "op_end_date")

# Concept sets of the definitions below.
SETS = {
    0: [concepts(URGENT, descendants=False)],
    1: [concepts(HIGH, MEDIUM, descendants=False)],
    2: [concepts(PART + 1, PART + 2, PART + 3, descendants=False)],
    3: [concepts(BRAND + 1, BRAND + 2, BRAND + 3)],
    4: [concepts(PART + 51, descendants=False)],
    5: [concepts(TYPE + 1)],
    6: [concepts(LOW, descendants=False)],
    7: [concepts(PART + 11, descendants=False)],
}
SET_SQL = {
    0: f"({URGENT})", 1: f"({HIGH}, {MEDIUM})", 2: f"({PART + 1}, {PART + 2}, {PART + 3})",
    3: below(BRAND + 1, BRAND + 2, BRAND + 3), 4: f"({PART + 51})", 5: below(TYPE + 1), 6: f"({LOW})",
    7: f"({PART + 11})",
}


def chosen(domain: str, codeset: int | None, where: str = "true") -> str:
    """Events of a domain and codeset as SQL."""
    in_set = f"target_concept_id in {SET_SQL[codeset]}" if codeset is not None else "true"
    return f"(select * from ({EVENT_SQL[domain]}) x where {in_set} and {where})"


def union_primary(*parts: str) -> str:
    ranked = [f"select *, {rank} as rank from {part} x" for rank, part in enumerate(parts)]
    return "(" + " union all ".join(ranked) + ")"


def index_sql(primary: str, prior: int = 0, post: int = 0) -> str:
    """Distinct index events with their observation period, and their first source row."""
    return f"""(select e.person_id, e.start_date, e.end_date, op.observation_period_start_date as op_start_date,
            op.observation_period_end_date as op_end_date, min(e.rank * 1000000000000000000 + e.event_id) as tie
        from {primary} e join observation_period op on op.person_id = e.person_id
            and op.observation_period_start_date + {prior} <= e.start_date
            and e.start_date + {post} <= op.observation_period_end_date
        group by all)"""


def first_sql(index: str) -> str:
    """A person's earliest row of an index."""
    return f"""(select * exclude (n) from (select *, row_number() over (partition by person_id
        order by start_date, tie, end_date, op_start_date) as n from {index} i) r where n = 1)"""


def hits(events: str, condition: str, what: str = "count(a.target_concept_id)") -> str:
    """Number of other events ``a`` around index event ``p``."""
    return f"(select {what} from {events} a where a.person_id = p.person_id and {condition})"


OBSERVED = "a.start_date between p.op_start_date and p.op_end_date"
ALL_INDEX = index_sql(union_primary(chosen("condition", 0)))
PRIMARY = (Events("condition", 0),)


def spec(**parts) -> CohortSpec:
    return CohortSpec(**{"cohort_id": 1, "primary": PRIMARY, "codesets": SETS, **parts})


def codes_for(cdm, definition: CohortSpec) -> Codesets:
    return Codesets(cdm, definition.codesets)


def kept_index(name: str, group, condition: str, index: str = ALL_INDEX, **parts):
    """Register: index events that satisfy a criteria group."""
    definition = spec(additional=group, **parts)

    def plan(s):
        return qualified_events(s.cdm, codes_for(s.cdm, definition), definition).select(*INDEX)

    query(name, f"select {', '.join(INDEX)} from {index} p where {condition}")(plan)


# --- Index events -----------------------------------------------------------------------------

UNION = (Events("condition", 0), Events("procedure", 2), Events("device", 7))
UNION_SQL = union_primary(chosen("condition", 0), chosen("procedure", 2), chosen("device", 7))


@query("b1_primary_events", f"select person_id, event_id, start_date, end_date, target_concept_id, rank from {UNION_SQL} u")
def _(s):
    found = primary_events(s.cdm, Codesets(s.cdm, SETS), UNION)
    return found.select("person_id", "event_id", "start_date", "end_date", "target_concept_id", "rank")


@query("b2_in_observation", f"""
    select e.person_id, e.event_id, e.start_date, op.observation_period_start_date as op_start_date,
           op.observation_period_end_date as op_end_date
    from {chosen("drug", 3)} e join observation_period op on op.person_id = e.person_id
        and op.observation_period_start_date + 365 <= e.start_date
        and e.start_date + 30 <= op.observation_period_end_date""")
def _(s):
    found = events(s.cdm, Events("drug", 3), Codesets(s.cdm, SETS))
    observed = in_observation(found, s.cdm["observation_period"], prior=365, post=30)
    return observed.select("person_id", "event_id", "start_date", "op_start_date", "op_end_date")


@query("b3_event_ordinals", f"""
    select person_id, event_id, rank, row_number() over (partition by person_id order by sort_date, rank, event_id)
        as ordinal from {UNION_SQL} u""")
def _(s):
    found = primary_events(s.cdm, Codesets(s.cdm, SETS), UNION)
    return number_events(found, ties=("rank", "event_id")).select("person_id", "event_id", "rank", "ordinal")


@query("b4_primary_limit_first", f"select {', '.join(INDEX)} from {first_sql(index_sql(UNION_SQL, 30))} p")
def _(s):
    definition = spec(primary=UNION, primary_limit="first", prior_days=30)
    return qualified_events(s.cdm, codes_for(s.cdm, definition), definition).select(*INDEX)


# --- Criteria ---------------------------------------------------------------------------------

AROUND = Window(starts_from=day(-30), starts_to=day(30))
NEAR_DRUG = Criterion(Events("drug", 3), Window(starts_from=day(-180), starts_to=day(180)))
kept_index("b5_at_least_two", all_in(Criterion(Events("procedure", 2), Window(starts_from=day(-365)), at_least=2)),
           hits(chosen("procedure", 2), f"{OBSERVED} and a.start_date >= p.start_date - 365") + " >= 2")
kept_index("b6_exactly_zero", all_in(Criterion(Events("drug", 5), AROUND, exactly=0)),
           hits(chosen("drug", 5), f"{OBSERVED} and a.start_date between p.start_date - 30 and p.start_date + 30")
           + " = 0")
# Deaths without a cause have concept 0, observation periods may have none: NULL concepts do not count.
kept_index("b7_distinct_concepts",
           all_in(Criterion(Events("drug", 5), Window(starts_from=day(0)), at_least=3, distinct=True)),
           hits(chosen("drug", 5), f"{OBSERVED} and a.start_date >= p.start_date",
                "count(distinct a.target_concept_id)") + " >= 3")

WITH_VISIT = Criterion(Events("visit", 4), Window(starts_from=day(-60), starts_to=day(0)))
WITH_LOW = Criterion(Events("condition", 6), Window(starts_from=day(1), starts_to=day(365)))
VISIT_SQL = hits(chosen("visit", 4), f"{OBSERVED} and a.start_date between p.start_date - 60 and p.start_date") + " >= 1"
LOW_SQL = hits(chosen("condition", 6), f"{OBSERVED} and a.start_date between p.start_date + 1 and p.start_date + 365") + " >= 1"
DRUG_SQL = hits(chosen("drug", 3), f"{OBSERVED} and a.start_date between p.start_date - 180 and p.start_date + 180") + " >= 1"
kept_index("b8_group_all", all_in(WITH_VISIT, WITH_LOW), f"{VISIT_SQL} and {LOW_SQL}")
kept_index("b8_group_any", any_in(WITH_VISIT, WITH_LOW, NEAR_DRUG), f"({VISIT_SQL} or {LOW_SQL} or {DRUG_SQL})")
kept_index("b8_group_at_least", at_least_in(2, WITH_VISIT, WITH_LOW, NEAR_DRUG),
           f"cast({VISIT_SQL} as int) + cast({LOW_SQL} as int) + cast({DRUG_SQL} as int) >= 2")

# A visit that holds the index date and has a procedure or a drug of its own near it.
TESTED = any_in(
    Criterion(Events("procedure", 2), Window(starts_from=day(-21), starts_to=day(0, "end"))),
    Criterion(Events("drug", 3), Window(starts_from=day(-21), starts_to=day(0, "end"))),
)
TESTED_VISIT = Criterion(
    Events("visit", 4, group=TESTED),
    Window(starts_to=day(0), ends_from=day(0), ends_in_observation=True),
)
TESTED_VISIT_SQL = f"""(select v.* from {chosen("visit", 4)} v join observation_period o on o.person_id = v.person_id
    and v.start_date between o.observation_period_start_date and o.observation_period_end_date
    where exists (select 1 from (select * from {chosen("procedure", 2)} union all select * from {chosen("drug", 3)}) t
        where t.person_id = v.person_id
          and t.start_date between o.observation_period_start_date and o.observation_period_end_date
          and t.start_date >= v.start_date - 21 and t.start_date <= v.end_date))"""
HOLDS_INDEX = "a.start_date <= p.start_date and a.end_date >= p.start_date and a.end_date <= p.op_end_date"
kept_index("b9_nested_group", all_in(TESTED_VISIT),
           hits(TESTED_VISIT_SQL, f"{OBSERVED} and {HOLDS_INDEX}") + " >= 1",
           index=index_sql(union_primary(chosen("condition", 1))), primary=(Events("condition", 1),))
kept_index("b10_demographic_in_group",
           all_in(NEAR_DRUG, Demographic(starts_between=(dt.date(1996, 9, 1), dt.date(2000, 12, 31)),
                                         genders=(8532,), min_age=30)),
           f"""{DRUG_SQL} and p.start_date between date '1996-09-01' and date '2000-12-31'
               and exists (select 1 from person q where q.person_id = p.person_id and q.gender_concept_id = 8532
                           and year(p.start_date) - q.year_of_birth >= 30)""")
kept_index("b11_additional_before_limit", all_in(WITH_VISIT), VISIT_SQL)
# The first event that passed, which need not be a person's first event.
kept_index("b12_qualified_limit_first", all_in(WITH_VISIT), "true", qualified_limit="first",
           index=first_sql(f"(select * from {ALL_INDEX} p where {VISIT_SQL})"))

WINDOWS = {
    "wn1_days_around": (Window(starts_from=day(-90), starts_to=day(7)),
                        f"{OBSERVED} and a.start_date between p.start_date - 90 and p.start_date + 7"),
    "wn2_all_time_prior": (Window(starts_to=day(-30)), f"{OBSERVED} and a.start_date <= p.start_date - 30"),
    "wn3_all_time_after": (Window(starts_from=day(1)), f"{OBSERVED} and a.start_date >= p.start_date + 1"),
    "wn4_against_index_end": (Window(starts_from=day(-21), starts_to=day(0, "end")),
                              f"{OBSERVED} and a.start_date >= p.start_date - 21 and a.start_date <= p.end_date"),
    "wn7_ignore_observation": (Window(starts_from=day(180), starts_to=day(365), ignore_observation=True),
                               "a.start_date between p.start_date + 180 and p.start_date + 365"),
}
for _name, (_window, _condition) in WINDOWS.items():
    kept_index(_name, all_in(Criterion(Events("procedure", 2), _window)),
               hits(chosen("procedure", 2), _condition) + " >= 1")

kept_index("wn5_event_end_after_index",
           all_in(Criterion(Events("visit", 4), Window(starts_to=day(0), ends_from=day(0), ends_in_observation=True))),
           hits(chosen("visit", 4), f"{OBSERVED} and {HOLDS_INDEX}") + " >= 1",
           index=index_sql(union_primary(chosen("condition", 1))), primary=(Events("condition", 1),))
kept_index("wn6_observed_year_before",
           all_in(Criterion(Events("observation_period"),
                            Window(starts_to=day(-365), ends_from=day(0, "end"), ends_in_observation=True))),
           hits(chosen("observation_period", None),
                f"{OBSERVED} and a.start_date <= p.start_date - 365 and a.end_date >= p.end_date "
                "and a.end_date <= p.op_end_date") + " >= 1")
kept_index("wn5_end_bounded_both_sides",
           all_in(Criterion(Events("visit", 4), Window(starts_to=day(0), ends_from=day(0), ends_to=day(6)))),
           hits(chosen("visit", 4), f"{OBSERVED} and a.start_date <= p.start_date and a.end_date >= p.start_date "
                                    "and a.end_date <= p.start_date + 6") + " >= 1",
           index=index_sql(union_primary(chosen("condition", 1))), primary=(Events("condition", 1),))

# Many windows on the end of the visit, counted and not only asked for, in one group.
END_WINDOWS = [
    (Criterion(Events("visit", 4), Window(starts_to=day(0), ends_from=day(-days), ends_to=day(days)), at_least=k),
     hits(chosen("visit", 4), f"{OBSERVED} and a.start_date <= p.start_date and a.end_date between p.start_date - {days} and p.start_date + {days}") + f" >= {k}")
    for days, k in ((6, 1), (120, 2), (400, 3))
] + [
    (Criterion(Events("visit", 4), Window(starts_from=day(-days), starts_to=day(days, "end"), ends_from=day(1), ends_in_observation=True), at_least=2),
     hits(chosen("visit", 4), f"{OBSERVED} and a.start_date between p.start_date - {days} and p.end_date + {days} "
                              "and a.end_date >= p.start_date + 1 and a.end_date <= p.op_end_date") + " >= 2")
    for days in (90, 365)
] + [
    (Criterion(Events("device", 7), Window(ends_to=day(0), ignore_observation=True), exactly=1),
     hits(chosen("device", 7), "a.end_date <= p.start_date") + " = 1"),
]
kept_index("b5_many_end_windows", at_least_in(2, *[c for c, _ in END_WINDOWS]),
           " + ".join(f"cast({condition} as int)" for _, condition in END_WINDOWS) + " >= 2",
           index=index_sql(union_primary(chosen("condition", 1))), primary=(Events("condition", 1),))

# Every part is in the codeset, so there are as many concepts as parts.
WIDE = {**SETS, 8: [concepts(*[TYPE + i for i in range(1, 7)])]}
WIDE_SQL = f"(select * from ({EVENT_SQL['drug']}) x where target_concept_id in {below(*[TYPE + i for i in range(1, 7)])})"
kept_index("b7_distinct_wide_codeset",
           any_in(Criterion(Events("drug", 8), Window(starts_from=day(-30), starts_to=day(180)), at_least=6, distinct=True),
                  Criterion(Events("drug", 8), Window(starts_to=day(-1), ignore_observation=True), at_least=30, distinct=True)),
           hits(WIDE_SQL, f"{OBSERVED} and a.start_date between p.start_date - 30 and p.start_date + 180", "count(distinct a.target_concept_id)")
           + " >= 6 or " + hits(WIDE_SQL, "a.start_date <= p.start_date - 1", "count(distinct a.target_concept_id)") + " >= 30", codesets=WIDE)

# --- Inclusion rules --------------------------------------------------------------------------

RULES = (all_in(NEAR_DRUG), all_in(Criterion(Events("drug", 5), AROUND, exactly=0)), any_in(WITH_VISIT, WITH_LOW))
RULE_SQL = (
    DRUG_SQL,
    hits(chosen("drug", 5), f"{OBSERVED} and a.start_date between p.start_date - 30 and p.start_date + 30") + " = 0",
    f"({VISIT_SQL} or {LOW_SQL})",
)
MASK_SQL = " + ".join(f"cast({rule} as bigint) * {2 ** i}" for i, rule in enumerate(RULE_SQL))


@query("b13_inclusion_rules", " union all ".join(
    f"select cast({i} as int) as inclusion_rule_id, person_id, start_date from {ALL_INDEX} p where {rule}"
    for i, rule in enumerate(RULE_SQL)))
def _(s):
    definition = spec()
    codes = codes_for(s.cdm, definition)
    names = [f"rule_{i}" for i in range(len(RULES))]
    judged = evaluate(s.cdm, codes, qualified_events(s.cdm, codes, definition), RULES, names)
    held = F.array_compact(F.array(*[F.when(F.col(name), i) for i, name in enumerate(names)]))
    return judged.select(F.explode(held).alias("inclusion_rule_id"), "person_id", "start_date")


@query("b14_inclusion_mask", f"select {', '.join(INDEX)}, {MASK_SQL} as inclusion_rule_mask from {ALL_INDEX} p")
def _(s):
    definition = spec()
    codes = codes_for(s.cdm, definition)
    masked = inclusion_mask(s.cdm, codes, qualified_events(s.cdm, codes, definition), RULES)
    return masked.select(*INDEX, "inclusion_rule_mask")


INCLUDED_SQL = f"(select * from {ALL_INDEX} p where {' and '.join(RULE_SQL)})"


@query("b15_expression_limit_first", f"select {', '.join(INDEX)} from {first_sql(INCLUDED_SQL)} p")
def _(s):
    definition = spec(inclusion_rules=RULES, expression_limit="first")
    codes = codes_for(s.cdm, definition)
    index = qualified_events(s.cdm, codes, definition)
    return included_events(s.cdm, codes, index, definition).select(*INDEX)


@query("r7_inclusion_result", f"""
    with masked as (select *, {MASK_SQL} as mask from {ALL_INDEX} p),
    best as (select *, row_number() over (partition by person_id order by bit_count(mask) desc, start_date, tie,
             end_date, op_start_date) as n from masked)
    select cast(1 as bigint) as cohort_definition_id, mask as inclusion_rule_mask,
           count(distinct person_id) as person_count, 1 as mode_id from masked group by mask
    union all
    select 1, mask, count(distinct person_id), 0 from best where n = 1 group by mask""")
def _(s):
    return inclusion_result(s.cdm, spec(inclusion_rules=RULES))


# --- Exits and eras ---------------------------------------------------------------------------

def exit_rows(name: str, definition: CohortSpec, exit_sql: str, index: str = ALL_INDEX):
    """Register: cohort intervals before eras are collapsed."""

    def plan(s):
        codes = codes_for(s.cdm, definition)
        index = qualified_events(s.cdm, codes, definition)
        rows = cohort_rows(s.cdm, codes, included_events(s.cdm, codes, index, definition), definition)
        return rows.distinct()

    query(name, f"""select distinct person_id, start_date, end_date from
        (select person_id, start_date, {exit_sql} as end_date from {index} p) z where end_date >= start_date""")(plan)


exit_rows("b16_exit_observation_end", spec(exit=ObservationEnd()), "op_end_date")
exit_rows("b17_exit_offset_from_start", spec(exit=DateOffset("start", 270)), "start_date + 270")
exit_rows("b17_exit_offset_from_end", spec(exit=DateOffset("end", 3), primary=UNION),
          "coalesce(greatest(end_date + 3, start_date), start_date)", index_sql(UNION_SQL))

EXPOSED = f"""(select person_id, drug_exposure_start_date as start_date,
        coalesce(drug_exposure_end_date, drug_exposure_start_date + coalesce(days_supply, 1)) as end_date
    from drug_exposure where drug_concept_id in {SET_SQL[3]} or drug_source_concept_id in {SET_SQL[3]})"""
DRUG_ERAS_SQL = f"({collapse_sql(EXPOSED, 'person_id', 30)})"
DRUG_INDEX = index_sql(union_primary(chosen("drug", 3)))
DRUG_EXIT = spec(primary=(Events("drug", 3),), exit=DrugEra(3, 30))
IN_ERA = f"""least(op_end_date, (select min(e.end_date) from {DRUG_ERAS_SQL} e where e.person_id = p.person_id
    and p.start_date between e.start_date and e.end_date))"""


@query("b18_drug_eras", f"select * from {DRUG_ERAS_SQL} e")
def _(s):
    return drug_eras(s.cdm, Codesets(s.cdm, SETS)[3], gap=30)


exit_rows("b18_exit_drug_era", DRUG_EXIT, IN_ERA, DRUG_INDEX)

CENSORS = (Events("condition", 6), Events("device", 7))
NEXT_CENSOR = f"""(select min(c.start_date) from (select person_id, start_date from {chosen("condition", 6)} x
        union all select person_id, start_date from {chosen("device", 7)} y) c
    where c.person_id = p.person_id and c.start_date >= p.start_date and c.start_date <= p.op_end_date)"""


@query("b19_censor_dates", f"select {', '.join(INDEX)}, {NEXT_CENSOR} as censor_date from {ALL_INDEX} p")
def _(s):
    definition = spec()
    codes = codes_for(s.cdm, definition)
    index = qualified_events(s.cdm, codes, definition)
    return censor_dates(s.cdm, codes, index, CENSORS).select(*INDEX, "censor_date")


exit_rows("b20_earliest_exit", spec(primary=(Events("drug", 3),), exit=DrugEra(3, 30), censors=CENSORS),
          f"least({IN_ERA}, {NEXT_CENSOR})", DRUG_INDEX)


def collapsed(name: str, pad: int):
    """Register: collapse of the visits and conditions of each person."""
    source = f"(select person_id, start_date, end_date from ({EVENT_SQL['condition']}) c)"

    @query(name, f"select * from ({collapse_sql(source, 'person_id', pad)}) e")
    def _(s):
        return collapse_eras(events(s.cdm, Events("condition")), ["person_id"], pad)


for _pad in (0, 30, 180):
    collapsed(f"e1_collapse_eras_{_pad}", _pad)


def cohort_sql(rows: str, pad: int, cohort_id: int = 1) -> str:
    return f"""select cast({cohort_id} as bigint) as cohort_definition_id, person_id as subject_id,
        start_date as cohort_start_date, end_date as cohort_end_date from ({collapse_sql(rows, 'person_id', pad)}) z"""


# Urgent conditions with a near drug, none of another, left at the next low condition or after 60 days.
WHOLE = spec(inclusion_rules=RULES, exit=DateOffset("start", 60), censors=CENSORS, era_pad=30)
WHOLE_ROWS = f"""(select person_id, start_date, least(start_date + 60, coalesce({NEXT_CENSOR}, start_date + 60)) as end_date
    from {INCLUDED_SQL} p)"""
query("b21_build_cohort", cohort_sql(WHOLE_ROWS, 30))(lambda s: build_cohort(s.cdm, WHOLE))

# The three shapes of definitions the study is made of.
SIMPLE = spec(cohort_id=100, primary=(Events("condition", 1), Events("observation", 2)), primary_limit="first",
              codesets={**SETS, 2: [concepts(PART + 21)]}, expression_limit="first")
SIMPLE_SQL = first_sql(index_sql(union_primary(
    chosen("condition", 1), f"(select * from ({EVENT_SQL['observation']}) x where target_concept_id = {PART + 21})")))
query("cohort_simple", cohort_sql(f"(select person_id, start_date, op_end_date as end_date from {SIMPLE_SQL} i)", 0, 100))(
    lambda s: build_cohort(s.cdm, SIMPLE))

YEAR_BEFORE = Criterion(Events("observation_period"),
                        Window(starts_to=day(-365), ends_from=day(0), ends_in_observation=True))
NESTED = spec(cohort_id=140, primary=(Events("condition", 1, after=dt.date(1996, 1, 1)),),
              additional=all_in(TESTED_VISIT), qualified_limit="first", inclusion_rules=(all_in(YEAR_BEFORE),),
              expression_limit="first")
NESTED_INDEX = index_sql(union_primary(chosen("condition", 1, "start_date > date '1996-01-01'")))
NESTED_FIRST = first_sql(
    f"(select * from {NESTED_INDEX} p where {hits(TESTED_VISIT_SQL, f'{OBSERVED} and {HOLDS_INDEX}')} >= 1)")
query("cohort_nested", cohort_sql(f"""(select person_id, start_date, op_end_date as end_date from {NESTED_FIRST} p
    where op_start_date <= start_date - 365)""", 0, 140))(lambda s: build_cohort(s.cdm, NESTED))

TREATED = spec(cohort_id=122, primary=(Events("drug", 3),), exit=DrugEra(3, 30), censors=CENSORS, era_pad=30,
               inclusion_rules=(all_in(Criterion(Events("condition", 6), AROUND, exactly=0),
                                       Criterion(Events("device", 7), AROUND, exactly=0)),))
TREATED_SQL = f"""(select person_id, start_date, least({IN_ERA}, coalesce({NEXT_CENSOR}, op_end_date)) as end_date
    from {DRUG_INDEX} p where {" and ".join(hits(chosen(d, c), f"{OBSERVED} and a.start_date between p.start_date - 30 and p.start_date + 30") + " = 0" for d, c in (("condition", 6), ("device", 7)))})"""
query("cohort_drug_era_censored", cohort_sql(TREATED_SQL, 30, 122))(lambda s: build_cohort(s.cdm, TREATED))

# A study's definitions side by side: every kind of limit, criterion and exit, from one reading of each table.
WIDE_GROUP = any_in(Criterion(Events("drug", 8), Window(starts_from=day(-30), starts_to=day(180)), at_least=6, distinct=True))
WIDE_HITS = hits(WIDE_SQL, f"{OBSERVED} and a.start_date between p.start_date - 30 and p.start_date + 180", "count(distinct a.target_concept_id)") + " >= 6"
FEMALE = Demographic(starts_between=(dt.date(1996, 9, 1), dt.date(2000, 12, 31)), genders=(8532,), min_age=30)
FEMALE_SQL = """p.start_date between date '1996-09-01' and date '2000-12-31' and exists (select 1 from person q
    where q.person_id = p.person_id and q.gender_concept_id = 8532 and year(p.start_date) - q.year_of_birth >= 30)"""


def stays(index: str, until: str = "op_end_date", where: str = "true") -> str:
    return f"(select * from (select person_id, start_date, {until} as end_date from {index} p where {where}) z where end_date >= start_date)"


STUDY = [
    (WHOLE, WHOLE_ROWS), (SIMPLE, stays(SIMPLE_SQL)), (NESTED, stays(NESTED_FIRST, where="op_start_date <= start_date - 365")), (TREATED, TREATED_SQL),
    (spec(cohort_id=2, primary=UNION, primary_limit="first", prior_days=30), stays(first_sql(index_sql(UNION_SQL, 30)))),
    (spec(cohort_id=3, primary=UNION, exit=DateOffset("end", 3), era_pad=60), stays(index_sql(UNION_SQL), "coalesce(greatest(end_date + 3, start_date), start_date)")),
    (spec(cohort_id=4, additional=all_in(WITH_VISIT), qualified_limit="first", exit=DateOffset("start", 30)),
     stays(first_sql(f"(select * from {ALL_INDEX} p where {VISIT_SQL})"), "start_date + 30")),
    (spec(cohort_id=5, primary=(Events("condition", 1),), additional=at_least_in(2, *[c for c, _ in END_WINDOWS]), exit=DateOffset("start", 7), era_pad=180),
     stays(index_sql(union_primary(chosen("condition", 1))), "start_date + 7", " + ".join(f"cast({c} as int)" for _, c in END_WINDOWS) + " >= 2")),
    (spec(cohort_id=6, codesets=WIDE, inclusion_rules=(WIDE_GROUP, all_in(NEAR_DRUG)), expression_limit="first"),
     stays(first_sql(f"(select * from {ALL_INDEX} p where {WIDE_HITS} and {DRUG_SQL})"))),
    (spec(cohort_id=7, additional=all_in(NEAR_DRUG, FEMALE), exit=DateOffset("end", 0)), stays(ALL_INDEX, "end_date", f"{DRUG_SQL} and {FEMALE_SQL}")),
    (spec(cohort_id=8, primary=(Events("drug", 3),), exit=DrugEra(3, 30)), stays(DRUG_INDEX, IN_ERA)),
    (spec(cohort_id=9, additional=at_least_in(2, WITH_VISIT, WITH_LOW, NEAR_DRUG), censors=CENSORS, era_pad=90),
     stays(ALL_INDEX, f"least(op_end_date, coalesce({NEXT_CENSOR}, op_end_date))", f"cast({VISIT_SQL} as int) + cast({LOW_SQL} as int) + cast({DRUG_SQL} as int) >= 2")),
]
STUDY_SPECS = [s for s, _ in STUDY]


def in_folder(s, folder: str):
    """Store tables under a folder and read them back."""
    return Steps(s.spark, folder)


@query("study_cohorts", " union all ".join(f"select * from ({cohort_sql(text, s.era_pad, s.cohort_id)}) c{s.cohort_id}" for s, text in STUDY))
def _(s):
    return build_cohorts(s.cdm, STUDY_SPECS, in_folder(s, s.scratch()))


# A study that runs, has one definition changed, and runs again: only that one is built anew.
def followed(cohort_id: int, concept: int, days: int) -> CohortSpec:
    return CohortSpec(cohort_id, (Events("condition", 0),), {0: [concepts(concept, descendants=False)]}, exit=DateOffset("start", days), era_pad=30)


def followed_sql(cohort_id: int, concept: int, days: int) -> str:
    events = f"(select * from ({EVENT_SQL['condition']}) x where target_concept_id = {concept})"
    return f"select * from ({cohort_sql(stays(index_sql(union_primary(events)), f'start_date + {days}'), 30, cohort_id)}) c{cohort_id}"


@query("study_second_run_skips", f"""
    select cohort_definition_id as cohort_id, count(*) as cohort_entries, count(distinct subject_id) as cohort_subjects,
           cohort_definition_id = 101 as built_again
    from ({" union all ".join(followed_sql(*d) for d in ((101, URGENT, 60), (102, HIGH, 30), (201, MEDIUM, 365), (301, LOW, 5)))}) c
    group by cohort_definition_id""")
def _(s):
    folder = s.scratch()
    study = Study(targets=[followed(101, URGENT, 30), followed(102, HIGH, 30)], strata_cohorts=[followed(201, MEDIUM, 365)], features=[followed(301, LOW, 5)],
                  bulk_strata=[Stratum(3, "Sex = Female", GENDER, (("=", 8532),))], names={101: "urgent", 102: "high", 201: "medium", 301: "low"})
    cdm = stored_eras(s.cdm, f"{folder}/eras")
    update_study(cdm, study, folder, "given")
    second = update_study(cdm, replace(study, targets=[followed(101, URGENT, 60), study.targets[1]]), folder, "given")
    built = [i for i, kind in second.ran if kind == "cohort"]
    counts = cohort_counts(read_cohorts(s.spark, f"{folder}/cohort_staging"), [101, 102, 201, 301])
    return counts.withColumn("built_again", F.col("cohort_id").isin(*built))


# --- Measurement change -----------------------------------------------------------------------

CHANGES = (
    Change(0, 2, diff=40.0, units=(1,)),
    Change(0, 2, diff=90.0, units=(0,)),
    Change(1, 2, diff=60.0),
    Change(0, 7, ratio=3.0, units=(0, 1)),
    Change(1, 7, ratio=5.0),
)
MEASURED = {0: [concepts(PART + 31, PART + 32, descendants=False)], 1: [concepts(PART + 34, descendants=False)]}
MEASURED_SQL = {0: f"({PART + 31}, {PART + 32})", 1: f"({PART + 34})"}


def change_sql(change: Change) -> str:
    units = ", ".join(map(str, change.units))
    same = f"and m.unit_concept_id in ({units}) and n.unit_concept_id = m.unit_concept_id" if units else ""
    rose = (f"n.value_as_number - m.value_as_number > {change.diff}" if change.diff is not None
            else f"n.value_as_number / m.value_as_number > {change.ratio}")
    listed = MEASURED_SQL[change.codeset]
    return f"""select distinct n.person_id, n.measurement_id as event_id, n.measurement_date as start_date,
            n.measurement_date + 1 as end_date, n.measurement_concept_id as target_concept_id,
            n.visit_occurrence_id, n.measurement_date as sort_date
        from measurement m join measurement n on n.person_id = m.person_id
            and n.measurement_date between m.measurement_date and m.measurement_date + {change.days}
        where m.measurement_concept_id in {listed} and n.measurement_concept_id in {listed}
          and m.value_as_number > 0 and n.value_as_number > 0 and {rose} {same}"""


@query("b22_measurement_change", " union all ".join(map(change_sql, CHANGES)))
def _(s):
    return measurement_changes(s.measured, Codesets(s.measured, MEASURED), CHANGES).df


@query("b22_report_earlier", f"""
        select n.person_id, n.measurement_date as start_date, m.measurement_id as event_id
        from measurement m join measurement n on n.person_id = m.person_id
            and n.measurement_date between m.measurement_date and m.measurement_date + 2
        where m.measurement_concept_id in {MEASURED_SQL[0]} and n.measurement_concept_id in {MEASURED_SQL[0]}
          and m.value_as_number > 0 and n.value_as_number > 0 and m.unit_concept_id = 1 and n.unit_concept_id = 1
          and n.value_as_number - m.value_as_number > 40""")
def _(s):
    change = Change(0, 2, diff=40.0, units=(1,), report_earlier=True)
    return measurement_change(s.measured, Codesets(s.measured, MEASURED), change).select(
        "person_id", "start_date", "event_id")


@query("b22_cohort_of_changes", f"""
    with found as (select *, row_number() over (partition by person_id order by start_date, event_id) as n
                   from ({" union all ".join(map(change_sql, CHANGES))}) c),
    kept as (select f.person_id, f.start_date, o.observation_period_end_date as end_date from found f
             join measurement_period o on o.person_id = f.person_id
                and f.start_date between o.observation_period_start_date and o.observation_period_end_date where n = 1)
    {cohort_sql("kept", 90, 201)}""")
def _(s):
    codes = Codesets(s.measured, MEASURED)
    changes = measurement_changes(s.measured, codes, CHANGES, first=True)
    return build_cohort(s.measured, CohortSpec(201, (changes,), primary_limit="first", era_pad=90))
