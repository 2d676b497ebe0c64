"""Many definitions in one plan give the rows of each by itself, from one reading of each clinical table."""

from __future__ import annotations

import datetime as dt
import re

import pytest

from cohortry.operators.criteria import Criterion, Demographic, Window, all_in, any_in, day
from cohortry.operators.event_store import EventStore, queries_of, share_codesets
from cohortry.operators.events import Events
from cohortry.operators.exits import DateOffset, DrugEra
from cohortry.operators.vocabulary import concepts
from cohortry.plans import batch
from cohortry.plans.batch import Batch, build_cohorts
from cohortry.plans.cohort import CohortSpec, build_cohort, inclusion_result
from cohortry.sources.steps import Steps
from contract import cohort_queries as known
from contract import views
from tests.conftest import rows

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def keep(spark, tmp_path):
    def store(name, df):
        df.write.parquet(str(tmp_path / name))
        return spark.read.schema(df.schema).parquet(str(tmp_path / name))

    return store


def definitions() -> list[CohortSpec]:
    visit_end = Events("visit", 4, anchor="end")
    return [
        *known.STUDY_SPECS,
        known.spec(cohort_id=301, primary=(Events("drug", 3, source=True, first=True, genders=(8532,)), visit_end), prior_days=10, post_days=5, exit=DateOffset("end", 3)),
        known.spec(cohort_id=302, primary=(Events("condition", 1, first=True, min_age=30), Events("death"), Events("observation_period")),
                   additional=any_in(Demographic(genders=(8507,)), Demographic(ends_after=dt.date(1999, 1, 1))), era_pad=7),
        known.spec(cohort_id=303, additional=all_in(Criterion(Events("drug", 5), Window(starts_from=day(-90), ends_to=day(90)), at_least=2, distinct=True)), exit=DrugEra(5, 10, 2)),
    ]


def test_each_definition_as_by_itself(spark, keep):
    cdm = views.cdm(spark, SF_DIR)
    # The others are compared with DuckDB: study_cohorts.
    specs = definitions()[-3:] + [known.NESTED]
    together = rows(build_cohorts(cdm, specs, keep))
    assert {r[0] for r in together} == {s.cohort_id for s in specs}
    for one in specs:
        assert [r for r in together if r[0] == one.cohort_id] == rows(build_cohort(cdm, one)), one.cohort_id


def test_inclusion_results_of_all_definitions(spark, keep):
    cdm = views.cdm(spark, SF_DIR)
    specs = [known.WHOLE, known.TREATED]
    found = rows(Batch(EventStore(cdm, specs, keep)).inclusion())
    assert found == sorted((r for s in specs for r in rows(inclusion_result(cdm, s))), key=lambda r: [(v is None, str(v)) for v in r])


def test_one_scan_per_clinical_table(spark, keep, tmp_path, bundle):
    cdm = views.cdm(spark, SF_DIR)
    for name in ("condition_occurrence", "drug_exposure", "visit_occurrence", "device_exposure", "procedure_occurrence", "observation", "observation_period", "person"):
        cdm = cdm.with_tables(**{name: keep(f"clinical/{name}", cdm[name])})
    kept = {}

    def watched(name, df):
        kept[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return keep(name, df)

    store = EventStore(cdm, definitions(), watched)
    found = Batch(store).cohorts()
    for domain, table in (("condition", "condition_occurrence_id"), ("drug", "drug_exposure_id"), ("visit", "visit_start_date"), ("device", "device_exposure_id"), ("procedure", "procedure_occurrence_id")):
        assert len(re.findall(rf"Relation \[[^\]]*{table}", kept[f"events/{domain}"])) == 1, domain
    # No later step goes back to an event table.
    later = [found._jdf.queryExecution().optimizedPlan().toString(), *[plan for name, plan in kept.items() if not name.startswith("events/")]]
    for plan in later:
        assert not re.search("condition_occurrence_id|drug_exposure_id|device_exposure_id|procedure_occurrence_id", plan)
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_equal_codesets_and_queries_are_shared():
    one = CohortSpec(1, (Events("drug", 7),), {7: [concepts(5)]})
    two = CohortSpec(2, (Events("drug", 0), Events("drug", 1)), {0: [concepts(5)], 1: [concepts(6)]})
    shared, sets = share_codesets([one, two])
    assert sets == {0: (concepts(5),), 1: (concepts(6),)} and len(queries_of(shared)) == 2


def test_no_definitions_and_equal_numbers(spark, keep, bundle):
    assert build_cohorts(bundle(), [], keep).collect() == []
    with pytest.raises(ValueError, match="share"):
        build_cohorts(bundle(), [CohortSpec(1, (Events("drug"),)), CohortSpec(1, (Events("visit"),))], keep)


def test_hot_person_and_no_events(spark, keep, bundle):
    d = lambda n: dt.date(2000, 1, 1) + dt.timedelta(days=n)
    cdm = bundle(
        condition_occurrence=[(i, 1 if i % 3 else 2, 7 + i % 2, 0, 0, d(i % 50), None, None) for i in range(300)],
        observation_period=[(1, 1, d(-10), d(400), 1), (2, 2, d(0), d(400), 1)],
        concept=[(7, "a", "Condition", "v", "c", "S", "1", None), (8, "b", "Condition", "v", "c", "S", "2", None)],
    )
    specs = [CohortSpec(i, (Events("condition", 0),), {0: [concepts(7 + i % 2, descendants=False)]}, inclusion_rules=(all_in(Criterion(Events("condition", 0), Window(starts_to=day(-1)), at_least=i)),),
                        exit=DateOffset("start", i)) for i in range(1, 4)] + [CohortSpec(9, (Events("device", 0),), {0: [concepts(99)]})]
    found = rows(build_cohorts(cdm, specs, keep))
    assert found == sorted((r for s in specs for r in rows(build_cohort(cdm, s))), key=lambda r: [(v is None, str(v)) for v in r])
    assert {r[0] for r in found} == {1, 2, 3}


def test_facts_of_corners_are_found_once_and_answers_need_no_sets(spark, keep):
    stored = {}

    def seen(name, df):
        stored[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return keep(name, df)

    cdm = views.cdm(spark, SF_DIR)
    specs = [known.spec(cohort_id=5, primary=(Events("condition", 1),), additional=any_in(*[c for c, _ in known.END_WINDOWS], known.TESTED_VISIT))]
    assert rows(build_cohorts(cdm, specs, seen)) == rows(build_cohort(cdm, specs[0]))
    assert "criteria/additional-corners" in stored and "criteria/nested/2" not in stored
    assert "collect_set" not in stored["index/passed"]


def test_more_criteria_than_a_word_has_bits(spark, keep):
    cdm = views.cdm(spark, SF_DIR)
    never = [Criterion(Events("device", 7), Window(ends_to=day(-5000 - i), ignore_observation=True)) for i in range(70)]
    held = [Criterion(Events("device", 7), Window(ends_to=day(400), ignore_observation=True)), Criterion(Events("drug", 5), Window(starts_to=day(0)), exactly=0, distinct=True)]
    specs = [known.spec(cohort_id=1, additional=any_in(*never, *held)), known.spec(cohort_id=2, additional=any_in(*never))]
    found = rows(build_cohorts(cdm, specs, keep))
    assert found and found == rows(build_cohort(cdm, known.spec(cohort_id=1, additional=any_in(*held))))


def test_definitions_without_criteria_and_limits_are_stored_once(spark, keep):
    stored = []

    def seen(name, df):
        stored.append(name)
        return keep(name, df)

    specs = [CohortSpec(i, (Events("condition", 0),), {0: [concepts(5000000 + i, descendants=False)]}, exit=DateOffset("start", 30)) for i in (1, 2)]
    assert rows(build_cohorts(views.cdm(spark, SF_DIR), specs, seen))
    assert [name for name in stored if name.startswith("index/")] == ["index/qualified"]


def test_persons_are_taken_in_rounds(spark, tmp_path, monkeypatch):
    cdm, specs = views.cdm(spark, SF_DIR), [known.WHOLE, known.NESTED, *definitions()[-3:]]
    wanted = rows(build_cohorts(cdm, specs, Steps(spark, str(tmp_path / "whole"))))
    stored, steps = {}, Steps(spark, str(tmp_path / "rounds"))

    class Watched(Steps):
        def __call__(self, name, df):
            found = super().__call__(name, df)
            if re.search("index/qualified$", name):
                stored[name] = {r[0] for r in found.select("person_id").distinct().collect()}
            return found

    monkeypatch.setattr(batch, "ROUND_BYTES", -(-sum(batch.scanned_bytes(cdm[batch.DOMAINS[d].table]) for d in batch.domains_of(specs)) // 3))
    found = rows(build_cohorts(cdm, specs, Watched(spark, steps.folder)))
    assert wanted and found == wanted
    # No person is in two rounds, and what a round stored is gone.
    assert len(stored) == 3 and all(stored.values()) and sum(map(len, stored.values())) == len(set.union(*stored.values()))
    assert sorted(p.name for p in (tmp_path / "rounds").iterdir() if not p.name.startswith(".")) == ["cohorts", "concept_tags"]


def test_persons_without_a_number_and_hot_ones_in_rounds(spark, bundle, tmp_path, monkeypatch):
    d = lambda n: dt.date(2000, 1, 1) + dt.timedelta(days=n)
    events = [(i, [1, None, 2, 3, 4][i % 5] if i % 3 else 2, 7, 0, 0, d(i % 50), None, None) for i in range(200)]
    cdm = bundle(
        condition_occurrence=events + events[:20],
        observation_period=[(i, i, d(-10), d(400), 1) for i in (1, 2, 3, 4)] + [(9, None, d(-10), d(400), 1)],
        concept=[(7, "a", "Condition", "v", "c", "S", "1", None)],
    )
    specs = [CohortSpec(i, (Events("condition", 0),), {0: [concepts(7, descendants=False)]}, exit=DateOffset("start", i),
                        inclusion_rules=(all_in(Criterion(Events("condition", 0), Window(starts_to=day(-1)), at_least=i)),)) for i in (1, 2)]
    wanted = rows(build_cohorts(cdm, specs, Steps(spark, str(tmp_path / "whole"))))
    monkeypatch.setattr(batch, "_rounds", lambda *_: 5)
    assert wanted and rows(build_cohorts(cdm, specs, Steps(spark, str(tmp_path / "rounds")))) == wanted


def test_stored_steps_leave_no_shuffles(spark, tmp_path):
    known_shuffles = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    source = type("Source", (), {"spark": spark})
    keep, before = known.in_folder(source, str(tmp_path / "steps")), known_shuffles()
    stored = keep("counts", spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count())
    assert known_shuffles() <= before and rows(stored) == [(k, 143 if k < 6 else 142) for k in range(7)]
