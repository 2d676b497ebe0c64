"""Many sites with broken deliveries, settings folders, and terms in names."""

from __future__ import annotations

import random

import pytest

from cohortry.operators.diagnostics import names_with_terms
from cohortry.plans.cohort import CohortSpec
from cohortry.plans.settings import study_from_settings
from cohortry.schemas import TABLES
from cohortry.sources.network import merge_chain
from tests.conftest import rows


@pytest.fixture
def site(frame):
    def build(name, **other):
        return {
            "database": frame(TABLES["database"], (name, name, "", "v1", 0)), "cohort_count": frame(TABLES["cohort_count"], (1, 9, 8, name)),
            "covariate": frame(TABLES["covariate"], (200031, "Age group: 00-04", 3), (7, "B" if name == "a" else "a", 1)),
            "covariate_value": frame(TABLES["covariate_value"], (1, 7, 0.5, 0.1, name)), **other,
        }

    return build


def test_good_sites_are_merged_and_named(spark, site):
    merged = merge_chain(spark, {"a": site("a"), "b": site("deid_LITE")})
    assert merged["quarantine"].collect() == []
    assert rows(merged["covariate_value"], "database_id") == [("STARR-OMOP",), ("a",)]
    assert rows(merged["covariate"], "covariate_id", "covariate_name") == [(200031, "age group: 100-104"), (7, "a")]


def test_bad_sites_are_left_out_as_a_whole(spark, frame, site):
    twice = frame(TABLES["covariate_value"], (1, 7, 0.5, 0.1, "b"), (1, 7, 0.6, 0.1, "b"))
    lacking = site("c", cohort_count=frame("cohort_id long", (1,)))
    del lacking["covariate"]
    merged = merge_chain(spark, {"a": site("a"), "b": site("b", covariate_value=twice), "c": lacking})
    assert rows(merged["quarantine"], "site", "table_name") == [("b", "covariate_value"), ("c", "cohort_count"), ("c", "covariate")]
    for name in ("database", "cohort_count", "covariate_value"):
        assert rows(merged[name], "database_id") == [("a",)]
    assert merge_chain(spark, {})["covariate"].collect() == []


def test_settings_folder(spark, tmp_path):
    (tmp_path / "CohortGroups.csv").write_text("cohortGroup,fileName,userCanSelect\ncovid,settings/T.csv,TRUE\nflu,settings/U.csv,TRUE\nstrata,settings/S.csv,FALSE\nfeature,settings/F.csv,FALSE\n")
    for file, rows_ in {"T": [("one", 1), ("two", 2)], "U": [("flu", 3)], "S": [("s", 4)], "F": [("f", 5)]}.items():
        (tmp_path / f"{file}.csv").write_text("name,atlasName,atlasId,cohortId\n" + "".join(f'"{n}, full",x,1,{i}\n' for n, i in rows_))
    (tmp_path / "BulkStrata.csv").write_text("generationScript,name,lbOperator,lbStrataValue,ubOperator,ubStrataValue,cohortId\nstrata/StratifyByAge.sql,young,>=,0,<,18,9\n")
    (tmp_path / "featureTimeWindows.csv").write_text("windowId,windowStart,windowEnd,windowType\n3,0,0,start\n")
    known = {i: CohortSpec(i, ()) for i in range(1, 6)}
    study = study_from_settings(spark, str(tmp_path), known, exclude={2}, exclude_from_export={1}, min_cell=7)
    assert [s.cohort_id for s in study.targets] == [1, 3] and [s.cohort_id for s in (*study.strata_cohorts, *study.features)] == [4, 5]
    assert study.names[1] == "one, full" and study.windows[0].kind == "start" and study.bulk_strata[0].bounds == ((">=", 0), ("<", 18)) and study.min_cell == 7
    assert [s.cohort_id for s in study_from_settings(spark, str(tmp_path), known, groups={"flu"}).targets] == [3]
    with pytest.raises(ValueError, match=r"without a definition: \[5\]"):
        study_from_settings(spark, str(tmp_path), {i: s for i, s in known.items() if i < 5})
    with pytest.raises(ValueError, match="no cohort groups"):
        study_from_settings(spark, str(tmp_path), known, groups={"other"})


def test_thousands_of_terms_as_plain_search(frame):
    rng = random.Random(3)
    letters = "abcdéA ß%_"
    names = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))) for i in range(300)] + [(999, None)]
    terms = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(3000)][::2]
    table = frame("concept_id long, concept_name string", *names)
    for some in (terms[:40], terms, ["bß"], ["zz"], ["z", "a"], []):
        wanted = sorted((str(i),) for i, n in names if n is not None and any(t.lower() in n.lower() for t in some))
        assert sorted((str(r["concept_id"]),) for r in names_with_terms(table, some).collect()) == wanted
    assert names_with_terms(table, [""]).count() == 300
