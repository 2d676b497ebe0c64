"""Criteria, limits, exits and whole definitions on hand-made tables."""

from __future__ import annotations

import random

import pytest

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
from cohortry.operators.events import Events
from cohortry.operators.exits import DateOffset, DrugEra
from cohortry.operators.vocabulary import Codesets, concepts
from cohortry.plans.cohort import CohortSpec, build_cohort, inclusion_result, qualified_events
from tests.conftest import rows
from tests.test_intervals import day as at
from tests.test_vocabulary_events import concept

OBSERVED = [(p, p, at(-1000), at(1000), 1) for p in (1, 2, 3)]
VOCABULARY = [concept(i) for i in range(1, 10)]
PRIMARY = (Events("condition", 1),)
SETS = {i: [concepts(i, descendants=False)] for i in range(1, 10)}


def condition(event, person, concept_id, start, end=None):
    return (event, person, concept_id, 0, 0, start, end, None)


def cohort(cdm, **parts):
    spec = CohortSpec(**{"cohort_id": 9, "primary": PRIMARY, "codesets": SETS, **parts})
    return rows(build_cohort(cdm, spec), "subject_id", "cohort_start_date", "cohort_end_date")


def starts(cdm, **parts):
    return [row[:2] for row in cohort(cdm, exit=DateOffset("start", 0), **parts)]


@pytest.mark.parametrize("group, expected", [
    (lambda a, b, c: all_in(a, b), []),
    (lambda a, b, c: all_in(a, c), [(1, at(0))]),
    (lambda a, b, c: any_in(b, c), [(1, at(0))]),
    (lambda a, b, c: any_in(b), []),
    (lambda a, b, c: at_least_in(2, a, b, c), [(1, at(0))]),
    (lambda a, b, c: at_least_in(3, a, b, c), []),
])
def test_groups_with_one_failing_member(bundle, group, expected):
    cdm = bundle(concept=VOCABULARY, observation_period=OBSERVED, condition_occurrence=[
        condition(1, 1, 1, at(0)), condition(2, 1, 2, at(5)), condition(3, 1, 4, at(-3))])
    near = Window(starts_from=day(-7), starts_to=day(7))
    a, b, c = (Criterion(Events("condition", i), near) for i in (2, 3, 4))
    assert starts(cdm, additional=group(a, b, c)) == expected


def test_null_concepts_do_not_count(bundle):
    periods = [(1, 1, at(-1000), at(1000), None), (2, 2, at(-1000), at(1000), 5)]
    cdm = bundle(concept=VOCABULARY, observation_period=periods,
                 condition_occurrence=[condition(1, 1, 1, at(0)), condition(2, 2, 1, at(0))])
    year = Window(starts_to=day(-365), ends_from=day(0), ends_in_observation=True)
    assert starts(cdm, additional=all_in(Criterion(Events("observation_period"), year))) == [(2, at(0))]
    assert starts(cdm, additional=all_in(Criterion(Events("observation_period"), year, exactly=0))) == [(1, at(0))]


def test_order_of_limits(bundle):
    """Primary limit before the criteria, qualified limit after them, expression limit after the rules."""
    cdm = bundle(concept=VOCABULARY, observation_period=OBSERVED, condition_occurrence=[
        condition(1, 1, 1, at(0)), condition(2, 1, 1, at(50)), condition(3, 1, 1, at(100)), condition(4, 1, 1, at(150)),
        condition(5, 1, 2, at(51)), condition(6, 1, 2, at(101)), condition(7, 1, 2, at(151)), condition(8, 1, 3, at(102)),
        condition(9, 1, 3, at(152))])
    after = Window(starts_from=day(0), starts_to=day(5))
    second, third = (all_in(Criterion(Events("condition", i), after)) for i in (2, 3))
    assert starts(cdm, additional=second, primary_limit="first") == []
    assert starts(cdm, additional=second, qualified_limit="first") == [(1, at(50))]
    assert starts(cdm, additional=second, qualified_limit="first", inclusion_rules=(third,)) == []
    assert starts(cdm, additional=second, inclusion_rules=(third,), expression_limit="first") == [(1, at(100))]
    assert starts(cdm, additional=second, inclusion_rules=(third,)) == [(1, at(100)), (1, at(150))]


def test_ties_go_to_the_earlier_query_and_smaller_id(bundle):
    cdm = bundle(concept=VOCABULARY, observation_period=OBSERVED,
                 condition_occurrence=[condition(5, 1, 1, at(0), at(9)), condition(4, 1, 1, at(0), at(3))],
                 visit_occurrence=[(1, 1, 2, at(0), at(20))])
    primary = (Events("condition", 1), Events("visit", 2))
    assert cohort(cdm, primary=primary, primary_limit="first", exit=DateOffset("end", 0)) == [(1, at(0), at(3))]


def test_nested_visit_with_test(bundle):
    cdm = bundle(
        concept=VOCABULARY, observation_period=OBSERVED,
        condition_occurrence=[condition(1, 1, 1, at(0)), condition(2, 2, 1, at(0))],
        visit_occurrence=[(1, 1, 2, at(-2), at(3)), (2, 2, 2, at(-2), at(3))],
        measurement=[(1, 1, 3, 1.0, 0, 0, at(-1), None), (2, 2, 3, 1.0, 0, 0, at(9), None)],
    )
    tested = any_in(Criterion(Events("measurement", 3), Window(starts_from=day(-21), starts_to=day(0, "end"))))
    holds = Window(starts_to=day(0), ends_from=day(0), ends_in_observation=True)
    assert starts(cdm, additional=all_in(Criterion(Events("visit", 2, group=tested), holds))) == [(1, at(0))]


def test_distinct_concepts_against_events(bundle):
    cdm = bundle(concept=VOCABULARY, concept_ancestor=[(9, i, 1) for i in (2, 3, 4)], observation_period=OBSERVED,
                 condition_occurrence=[condition(1, 1, 1, at(0)), condition(2, 2, 1, at(0))]
                 + [condition(10 + i, 1, 2, at(i)) for i in range(3)]
                 + [condition(20 + i, 2, 2 + i, at(i)) for i in range(3)])
    after = Window(starts_from=day(0))
    sets = {**SETS, 9: [concepts(9)]}
    assert starts(cdm, codesets=sets, additional=all_in(
        Criterion(Events("condition", 9), after, at_least=3, distinct=True))) == [(2, at(0))]
    assert starts(cdm, codesets=sets, additional=all_in(
        Criterion(Events("condition", 9), after, at_least=3))) == [(1, at(0)), (2, at(0))]


def test_demographic_member(bundle):
    cdm = bundle(concept=VOCABULARY, observation_period=OBSERVED,
                 person=[(1, 1990, 8532, 0), (2, 2010, 8532, 0), (3, 1990, 8507, 0)],
                 condition_occurrence=[condition(p, p, 1, at(0)) for p in (1, 2, 3)])
    assert starts(cdm, additional=all_in(Demographic(genders=(8532,), min_age=18))) == [(1, at(0))]
    assert starts(cdm, additional=all_in(Demographic(below_age=18))) == [(2, at(0))]


def test_inclusion_masks(bundle):
    cdm = bundle(concept=VOCABULARY, observation_period=OBSERVED,
                 condition_occurrence=[condition(p, p, 1, at(0)) for p in (1, 2, 3)]
                 + [condition(11, 1, 2, at(0)), condition(12, 2, 2, at(0)), condition(13, 2, 3, at(0))])
    rules = tuple(all_in(Criterion(Events("condition", i), Window(starts_from=day(0)))) for i in (2, 3))
    spec = CohortSpec(9, PRIMARY, SETS, inclusion_rules=rules)
    assert rows(inclusion_result(cdm, spec), "inclusion_rule_mask", "person_count", "mode_id") == [
        (0, 1, 0), (0, 1, 1), (1, 1, 0), (1, 1, 1), (3, 1, 0), (3, 1, 1)]
    assert starts(cdm, inclusion_rules=rules) == [(2, at(0))]


def test_offset_exit_may_pass_the_observation_end(bundle):
    cdm = bundle(concept=VOCABULARY, observation_period=[(1, 1, at(-10), at(10), 1)],
                 condition_occurrence=[condition(1, 1, 1, at(0))])
    assert cohort(cdm, exit=DateOffset("start", 30)) == [(1, at(0), at(30))]
    assert cohort(cdm) == [(1, at(0), at(10))]


def test_offset_of_a_missing_end_is_the_start(bundle):
    cdm = bundle(concept=VOCABULARY, observation_period=OBSERVED, device_exposure=[(1, 1, 1, at(0), None, None)])
    assert cohort(cdm, primary=(Events("device", 1),), exit=DateOffset("end", 7)) == [(1, at(0), at(0))]


def test_drug_era_exit_by_days_supply_and_source_concept(bundle):
    exposures = [
        (1, 1, 1, 0, at(0), None, 10, None),     # to day 10, by days of supply
        (2, 1, 8, 1, at(40), at(45), None, None),  # 30 days later, by source concept only
        (3, 1, 1, 0, at(76), None, None, None),  # 31 days after that: a new era of one day
    ]
    cdm = bundle(concept=VOCABULARY, observation_period=OBSERVED, drug_exposure=exposures)
    assert cohort(cdm, primary=(Events("drug", 1),), exit=DrugEra(1, 30)) == [
        (1, at(0), at(45)), (1, at(76), at(77))]


def test_index_outside_an_era_stays_to_the_observation_end(bundle):
    cdm = bundle(concept=VOCABULARY, observation_period=OBSERVED, condition_occurrence=[condition(1, 1, 1, at(-5))],
                 drug_exposure=[(1, 1, 2, 0, at(0), at(9), None, None)])
    assert cohort(cdm, exit=DrugEra(2, 30)) == [(1, at(-5), at(1000))]


def test_censoring_on_the_index_day(bundle):
    cdm = bundle(concept=VOCABULARY, observation_period=OBSERVED, condition_occurrence=[
        condition(1, 1, 1, at(0)), condition(2, 1, 2, at(0)), condition(3, 2, 1, at(0)), condition(4, 2, 2, at(-1))])
    assert cohort(cdm, censors=(Events("condition", 2),)) == [(1, at(0), at(0)), (2, at(0), at(1000))]


@pytest.mark.parametrize("window, inside", [
    (Window(starts_from=day(-30), starts_to=day(10)), lambda p, a: p[1] - 30 <= a[1] <= p[1] + 10),
    (Window(starts_to=day(-5)), lambda p, a: a[1] <= p[1] - 5),
    (Window(starts_from=day(1)), lambda p, a: a[1] >= p[1] + 1),
    (Window(starts_from=day(5), starts_to=day(-5)), lambda p, a: False),
    (Window(starts_from=day(-9), starts_to=day(2, "end")), lambda p, a: p[1] - 9 <= a[1] <= p[2] + 2),
    (Window(starts_to=day(0), ends_from=day(0), ends_in_observation=True),
     lambda p, a: a[1] <= p[1] <= a[2]),
    (Window(starts_to=day(3), ends_from=day(0), ends_to=day(4)), lambda p, a: a[1] <= p[1] + 3 and p[1] <= a[2] <= p[1] + 4),
])
def test_windows_match_brute_force_with_a_hot_person(bundle, window, inside):
    draw = random.Random(11)

    def some(n):
        out = []
        for i in range(n):
            start = draw.randrange(200)
            out.append((1 if i % 3 == 0 else draw.randrange(2, 4), start, start + draw.randrange(15)))
        return out

    index, other = some(60), some(60)
    cdm = bundle(concept=VOCABULARY, observation_period=OBSERVED,
                 visit_occurrence=[(i, p, 1, at(s), at(e)) for i, (p, s, e) in enumerate(index)]
                 + [(100 + i, p, 2, at(s), at(e)) for i, (p, s, e) in enumerate(other)])
    spec = CohortSpec(9, (Events("visit", 1),), SETS)
    codes = Codesets(cdm, SETS)
    groups = [all_in(Criterion(Events("visit", 2), window, **many))
              for many in ({"at_least": 1}, {"at_least": 2}, {"exactly": 0})]
    judged = evaluate(cdm, codes, qualified_events(cdm, codes, spec), groups, ["one", "two", "none"])
    found = rows(judged, "person_id", "start_date", "end_date", "one", "two", "none")
    wanted = set()
    for p in index:
        hits = sum(a[0] == p[0] and inside(p, a) for a in other)
        wanted.add((p[0], at(p[1]), at(p[2]), hits >= 1, hits >= 2, hits == 0))
    assert sorted(found) == sorted(wanted)
