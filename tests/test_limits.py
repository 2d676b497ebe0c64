"""Bounds that once cut rows off: rules of a mask, missing window bounds, open and backwards intervals, zero rates."""

from __future__ import annotations

import pytest
from tests.conftest import d, rows

from cohortry.operators.criteria import Criterion, Window, all_in, day, evaluate
from cohortry.operators.diagnostics import incidence_rate
from cohortry.operators.events import FrameEvents
from cohortry.operators.features import WINDOWS, feature_counts
from cohortry.operators.results import attrition, check_primary_key
from cohortry.operators.strata import AGE, FOLLOW_UP, Stratum, stratify
from cohortry.plans.cohort import inclusion_mask, rule_stats, summary_stats
from cohortry.schemas import TABLES

INDEX = "person_id long, start_date date, end_date date, op_start_date date, op_end_date date"


def test_all_63_rules_count(frame):
    every = (1 << 63) - 1
    result = frame("cohort_definition_id long, inclusion_rule_mask long, person_count long, mode_id int",
                   (1, every, 9, 0), (1, every ^ (1 << 62), 4, 0), (1, 1, 2, 0), (1, 0, 5, 0))
    rules = frame("cohort_definition_id long, rule_sequence int, name string", *[(1, k, f"rule {k}") for k in range(63)])
    stats = rule_stats(result, 63)
    found = {r["rule_sequence_id"]: r for r in attrition(rules, stats, result).collect()}
    assert [found[k]["remain_subjects"] for k in (0, 1, 61, 62)] == [15, 13, 13, 9]
    assert found[62]["gain_subjects"] == 4 and found[62]["meet_subjects"] == 9 and found[0]["total_subjects"] == 20
    assert rows(summary_stats(result, 63), "base_count", "final_count") == [(20, 9)]


def test_more_rules_than_bits_are_refused(bundle, frame):
    with pytest.raises(ValueError, match="63"):
        inclusion_mask(bundle(), None, frame(INDEX), [all_in()] * 64)


def test_no_bound_reaches_placeholder_dates(bundle, frame):
    index = frame(INDEX, (1, d("2000-01-01"), d("2000-01-02"), d("1999-01-01"), d("2001-01-01")))
    seen = "person_id long, event_id long, start_date date, end_date date, target_concept_id long, visit_occurrence_id long, sort_date date"
    others = frame(seen, *[(1, i, d(x), d(x), 7, None, d(x)) for i, x in enumerate(("0001-01-01", "1999-12-31", "9999-12-31"))])
    for window, n in ((Window(ignore_observation=True), 3), (Window(starts_to=day(0), ignore_observation=True), 2),
                      (Window(starts_from=day(0), ignore_observation=True), 1), (Window(ends_to=day(0), ignore_observation=True), 2)):
        for k in (n, n + 1):
            group = all_in(Criterion(FrameEvents(others), window, at_least=k))
            assert rows(evaluate(bundle(), None, index, [group], ["kept"]), "kept") == [(k == n,)]


def test_features_without_end_and_backwards(frame):
    cohort = frame(TABLES["cohort"], (101, 1, d("2000-06-01"), d("2000-07-01")), (101, 2, d("2000-06-01"), d("2000-07-01")))
    features = frame(TABLES["cohort"], (7, 1, d("2000-06-10"), None), (8, 1, d("2000-05-20"), d("2000-04-01")), (8, 2, d("1950-01-01"), d("9999-12-31")),
                     (9, 2, d("2000-05-30"), None))
    found = rows(feature_counts(cohort, features, WINDOWS, [7, 8, 9]), "feature_cohort_definition_id", "window_id", "feature_count")
    assert found == [(7, 4, 1), (8, 1, 2), (8, 2, 1)]


def test_only_follow_up_repeats_a_row_per_period(bundle, frame):
    cdm = bundle(person=[(1, 1960, 8532, 0)], observation_period=[(1, 1, d("2000-01-01"), d("2001-01-01"), 1), (2, 1, d("2000-03-01"), d("2000-12-01"), 1)])
    cohort = frame(TABLES["cohort"], (101, 1, d("2000-06-01"), d("2000-07-01")))
    xref = frame("target_id long, strata_id long, cohort_id long, cohort_type string, name string", (101, 5, 1015, "TwS", "a"), (101, 6, 1016, "TwS", "b"))
    strata = [Stratum(5, "adults", AGE, ((">=", 18), ("<", 99))), Stratum(6, "followed", FOLLOW_UP, ((">=", 0), ("<", 999)))]
    assert rows(stratify(cdm, cohort, xref, strata), "cohort_definition_id") == [(1015,), (1016,), (1016,)]
    assert rows(stratify(cdm, cohort, xref, strata[:1]), "cohort_definition_id") == [(1015,)]


def test_groups_without_a_case_have_rate_zero(bundle, frame):
    cdm = bundle(person=[(1, 1960, 8532, 0), (2, 1990, 8507, 0)],
                 observation_period=[(1, 1, d("2000-01-01"), d("2000-12-31"), 1), (2, 2, d("2000-01-01"), d("2000-12-31"), 1)])
    cohort = frame(TABLES["cohort"], (101, 1, d("2000-06-01"), d("2000-07-01")))
    found = rows(incidence_rate(cdm, cohort), "cohort_definition_id", "gender_concept_id", "cohort_count")
    assert found == [(101, 8507, 0), (101, 8532, 1)]


def test_merged_covariates_need_one_name_per_id(frame):
    two = frame("covariate_id long, covariate_name string", (1, "a"), (1, "b"))
    check_primary_key(two, "covariate")
    with pytest.raises(ValueError, match="duplicate"):
        check_primary_key(two, "covariate", merged=True)
