"""Second runs of a study, the ledger, and tables that are replaced key by key."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cohortry.operators.strata import GENDER, Stratum
from cohortry.plans.incremental import COHORT, COVARIATES, FEATURES, RESULTS, STRATA, WHOLE, Ledger, study_tasks
from cohortry.plans.study import Study, run_study, update_study
from cohortry.schemas import TABLES
from cohortry.sources.snapshots import KEPT, Snapshots
from contract import views
from tests.conftest import rows
from tests.test_study import definition

SF_DIR = "/root/testdata/sf0.001"
STUDY = Study(
    targets=[definition(101, 1, 30), definition(102, 2, 30)], strata_cohorts=[definition(201, 3, 365)], features=[definition(301, 4, 5)],
    bulk_strata=[Stratum(3, "Sex = Female", GENDER, (("=", 8532),))], names={101: "urgent", 102: "high", 201: "medium", 301: "low"}, min_subjects=20,
)


def changed(before: Study, after: Study) -> set:
    old, new = study_tasks(before, "x"), study_tasks(after, "x")
    return {t for t in new if old.get(t) != new[t]}


def test_a_change_reaches_what_depends_on_it():
    all_targets = lambda kind: {(101, kind), (102, kind)}
    one_target = replace(STUDY, targets=[definition(101, 1, 60), STUDY.targets[1]])
    assert changed(STUDY, one_target) == {(101, COHORT), (101, STRATA), (101, FEATURES), (101, COVARIATES), (WHOLE, RESULTS)}
    assert changed(STUDY, replace(STUDY, features=[definition(301, 4, 6)])) == {(301, COHORT), *all_targets(FEATURES), (WHOLE, RESULTS)}
    assert changed(STUDY, replace(STUDY, strata_cohorts=[definition(201, 3, 1)])) == {
        (201, COHORT), *all_targets(STRATA), *all_targets(FEATURES), *all_targets(COVARIATES), (WHOLE, RESULTS)}
    assert changed(STUDY, replace(STUDY, exclude_from_export=(102,))) == {(WHOLE, RESULTS)}
    assert changed(STUDY, replace(STUDY, data_version="2")) == set(study_tasks(STUDY, "x"))
    assert changed(STUDY, STUDY) == set()


def test_second_run_skips_and_a_changed_one_agrees_with_a_fresh_one(spark, tmp_path):
    # Strata by cohort and their order are in the contract query of the same name.
    small = replace(STUDY, strata_cohorts=[])
    cdm = views.cdm(spark, SF_DIR)
    first = update_study(cdm, small, str(tmp_path / "a"), "given")
    assert set(first.ran) == set(study_tasks(small, "given"))
    again = update_study(cdm, small, str(tmp_path / "a"), "given")
    assert again.ran == () and {n: rows(t) for n, t in again.tables.items()} == {n: rows(t) for n, t in first.tables.items()}
    other = replace(small, targets=[definition(101, 1, 60), small.targets[1]])
    third = update_study(cdm, other, str(tmp_path / "a"), "given")
    assert {t for t in third.ran if t[1] == COHORT} == {(101, COHORT)} and (102, STRATA) not in third.ran
    fresh = run_study(cdm, other, str(tmp_path / "b"), "given")
    assert {n: rows(t) for n, t in third.tables.items()} == {n: rows(t) for n, t in fresh.items()}


def test_a_broken_run_goes_on_where_it_stopped(spark, tmp_path):
    ledger, tasks = Ledger(spark, str(tmp_path)), {(1, COHORT): "a", (1, STRATA): "b", (WHOLE, RESULTS): "c"}
    assert ledger.pending(tasks) == set(tasks)
    ledger.record(tasks, [(1, COHORT)])
    assert ledger.pending(tasks) == {(1, STRATA), (WHOLE, RESULTS)}
    ledger.record(tasks, [(1, STRATA)])
    assert ledger.pending({**tasks, (1, COHORT): "changed"}) == {(1, COHORT), (WHOLE, RESULTS)}
    ledger.record(tasks, [])
    assert ledger.read().count() == 2


def test_doubled_keys_stop_the_run(spark, frame, tmp_path):
    with pytest.raises(ValueError, match="defined more than once"):
        study_tasks(replace(STUDY, features=[definition(101, 4, 5)]), "x")
    table = Snapshots(spark, f"{tmp_path}/ledger", "cohort_id", TABLES["ledger"])
    table.overwrite(frame("cohort_id long, task string, checksum string", (1, "cohort", "a"), (1, "cohort", "b")).withColumn("time_stamp", F.current_timestamp()))
    with pytest.raises(ValueError, match="more than once"):
        Ledger(spark, str(tmp_path)).pending({(1, COHORT): "a"})


def test_snapshots_replace_whole_keys(spark, frame, tmp_path):
    ddl = "k long, v string"
    table = Snapshots(spark, str(tmp_path / "t"), "k", ddl)
    assert table.read().collect() == [] and table.versions() == []
    table.replace(frame(ddl, (1, "a"), (1, "b"), (2, "c"), (9, "not asked for")), [1, 2, 3])
    assert rows(table.read()) == [(1, "a"), (1, "b"), (2, "c")]
    reader = table.read()
    table.replace(frame(ddl, (1, "d")), [1])
    table.replace(frame(ddl), [2])
    assert rows(table.read()) == [(1, "d")]
    # A reader that began before goes on with the table as it was then.
    assert rows(reader) == [(1, "a"), (1, "b"), (2, "c")]
    for _ in range(KEPT + 1):
        table.overwrite(frame(ddl, (5, "e")))
    assert rows(table.read()) == [(5, "e")] and len(table.versions()) == KEPT + 1
    assert len(list((tmp_path / "t" / "data").iterdir())) == KEPT + 1


def test_an_unfinished_write_is_never_seen(spark, frame, tmp_path):
    ddl = "k long, v string"
    table = Snapshots(spark, str(tmp_path / "t"), "k", ddl)
    table.replace(frame(ddl, (1, "a")), [1])
    # New rows are there, their manifest is not complete.
    frame(ddl, (1, "half")).withColumn("_k", F.col("k")).write.partitionBy("_k").parquet(str(tmp_path / "t/data/_write=0123"))
    (tmp_path / "t/manifest/2").mkdir()
    assert rows(table.read()) == [(1, "a")]


def test_many_keys_need_no_listing_each(spark, frame, tmp_path):
    table, asked = Snapshots(spark, str(tmp_path / "t"), "k", "k long, v string"), []
    plain = table._storage
    table._storage = lambda path: asked.append(path) or plain(path)
    df = frame("k long, v string", *[(i % 500, "x") for i in range(1000)])
    table.replace(df, range(1672))
    assert len(asked) <= 3 and table.read().count() == 1000
    assert table.manifest().count() == 1672
