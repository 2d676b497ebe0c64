"""A whole study on the smallest given tables, and its parts under a hot person."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from cohortry.operators.events import Events
from cohortry.operators.exits import DateOffset
from cohortry.operators.covariates import drug_group_covariates
from cohortry.operators.features import WINDOWS, FeatureWindow, facts_in_windows, feature_counts
from cohortry.operators.strata import AGE, GENDER, Stratum
from cohortry.operators.vocabulary import concepts
from cohortry.plans.cohort import CohortSpec
from cohortry.plans.study import Study, run_study
from contract import views
from tests.conftest import rows
from tests.test_intervals import day as at
from tests.test_intervals import intervals

SF_DIR = "/root/testdata/sf0.001"


def definition(cohort_id: int, digit: int, days: int) -> CohortSpec:
    return CohortSpec(cohort_id, (Events("condition", 0),), {0: [concepts(5000000 + digit, descendants=False)]},
                      exit=DateOffset("start", days), era_pad=30)


def test_run_study(spark, tmp_path):
    study = Study(
        targets=[definition(101, 1, 30), definition(102, 2, 30)],
        strata_cohorts=[definition(201, 3, 365)],
        features=[definition(301, 4, 5)],
        bulk_strata=[Stratum(3, "Sex = Female", GENDER, (("=", 8532),)), Stratum(6, "Age < 18", AGE, ((">=", 0), ("<", 18)))],
        names={101: "urgent", 102: "high", 201: "medium", 301: "low"},
        min_subjects=20,
        exclude_from_export=(102,),
    )
    cdm = views.cdm(spark, SF_DIR)
    first = {n: rows(t) for n, t in run_study(cdm, study, str(tmp_path / "study"), "given").items()}
    counts = {r[0]: r[1:] for r in first["cohort_count"]}
    assert 102 not in counts and {101, 101000031, 101002011, 101002012} <= set(counts)
    # Every target subject is either with or without the stratum at each of its index dates.
    assert counts[101002011][0] + counts[101002012][0] == counts[101][0]
    values = first["covariate_value"]
    assert values and all(r[0] != 102 for r in values)
    assert {r[1] for r in values} >= {301001, 85320011}
    assert not [r for r in values if 0 < r[2] < 5 / max(1, counts[r[0]][0])]
    listed = {r[0] for r in first["covariate"]}
    assert {r[1] for r in values if r[2] > 0.001} <= listed
    # Running again over the stored cohorts gives the same results.
    again = {n: rows(t) for n, t in run_study(cdm, study, str(tmp_path / "study"), "given").items()}
    assert again == first


def test_features_of_a_hot_person(frame):
    index = [(1, p, s, e) for p, s, e in intervals(5, 4, 150, 500, hot=True)]
    facts = [(p, i % 4, s, e) for i, (p, s, e) in enumerate(intervals(6, 4, 150, 500, hot=True))]
    cohort = frame("cohort", *index)
    found = facts_in_windows(cohort, frame("subject_id long, fact_id long, fact_start date, fact_end date", *facts), WINDOWS)
    wanted = set()
    for _, p, start, _ in index:
        for q, fact, s, e in facts:
            for w in WINDOWS:
                low, high = start + dt.timedelta(days=w.start), start + dt.timedelta(days=w.end)
                if p == q and s <= high and (s if w.kind == "start" else e) >= low:
                    wanted.add((p, start, w.window_id, fact))
    assert set(rows(found, "subject_id", "cohort_start_date", "window_id", "fact_id")) == wanted


def test_facts_are_shuffled_to_their_index_date_once(frame):
    cohort = frame("cohort", (1, 7, at(0), at(9)), (2, 7, at(0), at(5)), (1, 8, at(400), at(401)), (1, 8, at(400), at(409)))
    facts = frame("cohort", (5, 7, at(-3), at(-2)), (5, 7, at(-9), at(0)), (6, 7, at(0), at(0)), (6, 8, at(420), None), (5, 9, at(0), at(0)))
    # More windows than one long has bits.
    windows = [*WINDOWS, *[FeatureWindow(k, -k, -k, "overlap") for k in range(10, 80)]]
    wanted = {(1, 5, w.window_id, 1) for w in windows if w.kind == "overlap" and w.start <= 0 and w.end >= -9} | {
        (1, 6, 3, 1), (1, 6, 4, 2)}
    wanted |= {(2, *r[1:3], 1) for r in wanted}
    assert set(rows(feature_counts(cohort, facts, windows, [5, 6]))) == wanted
    plan = feature_counts(cohort, facts, WINDOWS, [5, 6])._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(subject_id" in line and "met" not in line]
    assert not any("cohort_start_date" in line and "fact_id" in line for line in dealt)


def test_cohorts_that_share_an_index_date_share_its_matches(frame):
    # More cohorts than one long has bits for, one of them without an id; subject 8 is in the even ones only.
    ids = [None, *range(100, 140)]
    cohort = frame("cohort", *[(c, 7, at(k % 2), at(9)) for k, c in enumerate(ids)], *[(c, 7, at(0), at(9)) for c in ids],
                   *[(c, 8, at(0), at(9)) for c in ids[1::2]], (100, None, at(0), at(9)))
    facts = frame("cohort", (5, 7, at(-3), at(-2)), (5, 7, at(1), at(1)), (5, 8, at(0), at(0)), (6, 8, at(-400), at(0)), (6, None, at(0), at(0)))
    wanted = {(c, 5, w, n) for k, c in enumerate(ids) for w, n in ((1, 1), (2, 1), (4, 1 + k % 2))}
    wanted |= {(c, 5, 3, k % 2 + k % 2) for k, c in enumerate(ids) if k % 2} | {(c, 6, w, 1) for c in ids[1::2] for w in (1, 2)}
    wanted |= {(c, 5, 1, 1) for c in ids}
    counted = feature_counts(cohort, facts, WINDOWS, [5, 6])
    assert set(rows(counted)) == wanted and counted.count() == len(wanted)
    # Matches go to their subject and fact; no row goes to a cohort before subjects are counted.
    plan = counted._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert not any("cohort_definition_id" in line and "subject_id" in line for line in dealt)


def test_stored_eras_are_built_once(spark, bundle, tmp_path):
    given = bundle(drug_exposure=[(1, 7, 10, 10, at(0), at(5), 5, None), (2, 7, 10, 10, at(20), None, 5, None), (3, 8, 10, 10, at(90), None, 5, None)])
    built = []
    cdm = given.with_tables(drug_era=lambda: built.append(1) or views.era_view(given, "drug_era"))
    stored = views.stored_eras(cdm, str(tmp_path / "eras"))
    assert not built and rows(stored["drug_era"]) == rows(views.era_view(given, "drug_era")) and len(rows(stored["drug_era"])) == 2
    assert "Window" not in stored["drug_era"]._jdf.queryExecution().executedPlan().toString() and built == [1]


def test_groups_that_are_not_broadcast_count_the_same(bundle, frame, monkeypatch):
    cdm = bundle(
        concept=[(i, f"c{i}", "Drug", "ATC", "ATC 2nd", "C", code, None) for i, code in ((1, "A01"), (2, "B01"))],
        concept_ancestor=[(1, 10, 1), (2, 10, 1), (1, 11, 1)],
        drug_era=[(1, 7, 10, at(-5), at(-2)), (2, 7, 11, at(-400), at(-20)), (3, 8, 10, at(1), at(2))],
    )
    cohort = frame("cohort", (1, 7, at(0), at(9)), (2, 7, at(0), at(9)), (1, 8, at(0), at(9)))
    joined = rows(drug_group_covariates(cdm, cohort, WINDOWS))
    assert joined == sorted([(c, w, g, 1) for c in (1, 2) for w in (1, 2) for g in (1412, 2412)] + [(1, 4, g, 1) for g in (1412, 2412)],
                            key=lambda r: [(False, str(v)) for v in r])
    monkeypatch.setattr("cohortry.operators.covariates.BROADCAST_ROWS", 0)
    assert rows(drug_group_covariates(cdm, cohort, WINDOWS)) == joined


def test_eras_are_shuffled_once(spark):
    plan = views.era_view(views.cdm(spark, SF_DIR), "drug_era")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(person_id") == 1


def test_hot_person_is_bounded_by_days_before_any_window(frame):
    """However many rows a person has, the window of the era collapse sees one per day."""
    from cohortry.operators.intervals import collapse_eras

    hot = [(1, at(i % 10), at(i % 10 + i % 3)) for i in range(3000)]
    eras = collapse_eras(frame("person_id long, start_date date, end_date date", *hot, (2, at(0), at(1))))
    plan = eras._jdf.queryExecution().executedPlan().toString()
    # Printed from the top: the reduction, with its map side, lies below the last window.
    assert plan.rindex("Window") < plan.rindex("partial_max(end_date")
    assert rows(eras, "person_id", "start_date", "end_date") == [(1, at(0), at(11)), (2, at(0), at(1))]


def test_checksum_and_cut_lineage(spark, frame):
    from cohortry.session import cut_lineage
    from cohortry.sources.sinks import checksum

    df = cut_lineage(frame("a long", (1,)).withColumn("c", checksum("x")))
    assert rows(df) == [(1, "9dd4e461268c8034f5c8564e155c67a6")]
    assert df.select(F.col("a")).count() == 1
