"""Strata, censoring, features, covariates and results on hand-made tables."""

from __future__ import annotations

import math

import pytest

from cohortry.operators.censor import censor_cohorts
from cohortry.operators.compare import compare_cohorts
from cohortry.operators.covariates import (
    age_group_covariates,
    analysis_results,
    covariate_counts,
    covariate_ref,
    gender_covariates,
)
from cohortry.operators.features import WINDOWS, feature_counts, feature_proportions
from cohortry.operators.results import (
    attrition,
    check_primary_key,
    covariate_list,
    covariate_values,
    enforce_min_cell,
    fix_covariate_names,
)
from cohortry.operators.strata import check_unique_ids, strata_from_settings, stratify, stratify_by_cohorts
from cohortry.sources.merge import merge_sites
from cohortry.sources.sinks import read_cohorts, write_cohort, write_cohorts
from tests.conftest import d, rows
from tests.test_intervals import day as at
from tests.test_vocabulary_events import concept


def members(cohort_id, persons, start=at(0), end=at(10)):
    return [(cohort_id, p, start, end) for p in persons]


def test_pair_is_dropped_when_one_side_is_too_small(frame):
    xref = frame("target_strata_xref", (1, 50, 1501, "TwS", "a"), (1, 50, 1502, "TwoS", "b"), (1, 60, 1601, "TwS", "c"),
                 (1, 70, 1701, "TwS", "e"), (1, 70, 1702, "TwoS", "f"))
    staging = frame("cohort", *members(1, range(11)), *members(1501, range(6)), *members(1502, range(6, 11)),
                    *members(1601, [1]), *members(1701, range(6)), *members(1702, range(6)), *members(2, range(9)))
    kept = censor_cohorts(staging, xref, 5)
    assert sorted({r.cohort_definition_id for r in kept.collect()}) == [1, 1601, 1701, 1702]


def test_with_and_without_make_up_the_target(frame):
    xref = frame("target_strata_xref", (1, 2, 21, "TwS", "a"), (1, 2, 22, "TwoS", "b"))
    staging = frame("cohort", *members(1, [1], at(0)), *members(1, [2], at(5)), *members(1, [3], at(9)),
                    *members(2, [1], at(-3), at(0)), *members(2, [2], at(6), at(8)),
                    *members(2, [3], at(8), at(9)), *members(2, [3], at(9), at(20)))
    found = stratify_by_cohorts(staging, xref)
    assert rows(found, "cohort_definition_id", "subject_id") == [(21, 1), (21, 3), (21, 3), (22, 2)]


def test_strata_from_settings_rows(bundle, frame):
    columns = ("generation_script", "lb_operator", "lb_strata_value", "ub_operator", "ub_strata_value", "name", "cohort_id")
    strata = strata_from_settings([
        dict(zip(columns, ("strata/StratifyByAge.sql", ">=", "18", "<", "99999", "adult", 5))),
        dict(zip(columns, ("strata/StratifyByGender.sql", "=", "8532", None, None, "female", 3))),
        dict(zip(columns, ("strata/StratifyByIndex.sql", ">=", "DATEFROMPARTS(2020, 01, 01)", "<",
                           "DATEFROMPARTS(2020, 02, 01)", "January", 11)))])
    cdm = bundle(person=[(1, 1990, 8532, 0), (2, 2010, 8507, 0)])
    xref = frame("target_strata_xref", (1, 5, 1051, "TwS", ""), (1, 3, 1031, "TwS", ""), (1, 11, 1111, "TwS", ""))
    cohort = frame("cohort", (1, 1, d("2020-01-31"), at(90)), (1, 2, d("2020-02-01"), at(90)), (2, 1, at(0), at(1)))
    assert rows(stratify(cdm, cohort, xref, strata), "cohort_definition_id", "subject_id") == [
        (1031, 1), (1051, 1), (1111, 1)]


def test_ids_must_be_unique(frame):
    one = frame("name string, cohort_id long", ("a", 1), ("b", 2))
    check_unique_ids(one)
    with pytest.raises(ValueError, match="2"):
        check_unique_ids(one, frame("name string, cohort_id long", ("c", 2)))


def test_feature_windows(frame):
    cohort = frame("cohort", (1, 1, at(0), at(9)), (1, 2, at(0), at(9)))
    staging = frame("cohort", (7, 1, at(-400), at(-365)), (7, 2, at(-500), at(-366)), (8, 1, at(-5), at(3)),
                    (8, 2, at(0), at(0)), (8, 2, at(30), at(31)), (9, 1, at(0), at(1)))
    counted = feature_counts(cohort, staging, WINDOWS, [7, 8])
    assert rows(counted, "feature_cohort_definition_id", "window_id", "feature_count") == [
        (7, 1, 1), (8, 1, 1), (8, 2, 1), (8, 3, 1), (8, 4, 1)]
    whole = feature_proportions(cohort, counted).where("feature_cohort_definition_id = 7").collect()[0]
    assert whole["mean"] == 0.5 and math.isclose(whole["sd"], math.sqrt(0.5))


def test_single_person_cohort_has_no_deviation(bundle, frame):
    cdm = bundle(person=[(1, 1919, 8532, 0)], concept=[concept(8532, "FEMALE", "Gender")])
    cohort = frame("cohort", (1, 1, at(0), at(1)))
    counts = age_group_covariates(cdm, cohort).unionByName(gender_covariates(cdm, cohort))
    assert rows(analysis_results(cohort, counts), "covariate_id", "mean", "sd") == [
        (200031, 1.0, None), (85320011, 1.0, None)]
    names = covariate_ref(cdm, covariate_counts(cdm, cohort, WINDOWS), WINDOWS)
    assert rows(names, "covariate_id", "covariate_name") == [(200031, "age group: 00-04"), (85320011, "gender = FEMALE")]
    fixed = fix_covariate_names(names)
    assert ("age group: 100-104",) in rows(fixed, "covariate_name")
    assert feature_proportions(cohort, frame("feature_summary", (1, 7, 1, 1))).isEmpty()


def test_min_cell_keeps_zero_and_null(frame):
    df = frame("cohort_id long, n long", (1, 0), (2, 3), (3, None), (4, 5))
    assert rows(enforce_min_cell(df, "n", 5)) == [(1, 0), (2, -5), (3, None), (4, 5)]


def test_values_are_rounded_half_even_and_censored(frame):
    results = frame("cohort_id long, covariate_id long, covariate_name string, analysis_id int, mean double, sd double",
                    (1, 1, "a", 3, 0.0625, 0.0015), (1, 2, "b", 3, 0.0605, 0.0005), (1, 3, "c", 3, 0.001, 0.5),
                    (1, 4, "d", 3, 0.00004, 0.5), (2, 1, "a", 3, 0.5, 0.5), (1, 5, "e", 3, 0.0, 0.0))
    counts = frame("cohort_count", (1, 100, 90, "x"))
    assert rows(covariate_values(results, counts, 5, "x"), "covariate_id", "mean", "sd") == [
        (1, 0.062, 0.002), (2, 0.06, 0.0), (3, -0.05, None), (4, -0.05, None), (5, 0.0, 0.0)]
    assert rows(covariate_list(results), "covariate_id") == [(1,), (2,), (3,)]


def test_attrition(frame):
    inclusion = frame("cohort_inclusion", (1, 0, "first", None), (1, 1, "second", None))
    stats = frame("cohort_inclusion_stats", (1, 0, 7, 2, 12, 0), (1, 1, 6, 1, 12, 0), (1, 0, 99, 9, 99, 1))
    result = frame("cohort_inclusion_result", (1, 0, 3, 0), (1, 1, 4, 0), (1, 2, 3, 0), (1, 3, 2, 0), (1, 3, 50, 1))
    assert rows(attrition(inclusion, stats, result), "rule_sequence_id", "remain_subjects") == [(0, 6), (1, 2)]


def test_covariate_of_one_cohort_has_no_difference(frame):
    values = frame("covariate_value", (1, 10, 0.2, 0.3, "x"), (1, 11, 0.1, 0.1, "x"), (2, 10, 0.6, 0.4, "x"))
    covariates = frame("covariate_id long, covariate_name string", (10, "a"), (11, "b"))
    found = compare_cohorts(values, covariates, 1, 2, "x").collect()
    assert [(r.covariate_id, r.std_diff and round(r.std_diff, 9)) for r in found] == [(10, 0.8), (11, None)]


def test_strict_merge_refuses_other_columns(frame):
    one = frame("cohort_id long, n long", (1, 1))
    with pytest.raises(ValueError, match="columns differ"):
        merge_sites([one, frame("cohort_id long, m long", (1, 1))])
    lenient = merge_sites([one, frame("cohort_id string, m long", ("2", 1))], strict=False)
    assert rows(lenient, "cohort_id", "n") == [(1, 1), (2, None)]


def test_primary_keys(frame):
    check_primary_key(frame("cohort_count", (1, 1, 1, "x"), (1, 1, 1, "y")), "cohort_count")
    with pytest.raises(ValueError, match="duplicate"):
        check_primary_key(frame("cohort_count", (1, 1, 1, "x"), (1, 2, 1, "x")), "cohort_count")


def test_empty_result_clears_a_cohort(frame, spark, tmp_path):
    path = str(tmp_path / "cohort")
    write_cohorts(frame("cohort", *members(1, [1]), *members(2, [2]), *members(3, [3])), path, [1, 2])
    write_cohort(frame("cohort", *members(1, [4, 5])), path, 1)
    write_cohort(frame("cohort"), path, 2)
    write_cohort(frame("cohort"), path, 7)
    assert rows(read_cohorts(spark, path), "cohort_definition_id", "subject_id") == [(1, 4), (1, 5)]
