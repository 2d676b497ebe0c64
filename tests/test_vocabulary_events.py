"""Concept sets and event scans on hand-made tables."""

from __future__ import annotations

import pytest

from cohortry.operators.events import Events, events
from cohortry.operators.vocabulary import Codesets, concept_set, concepts, drug_groups, without
from tests.conftest import d, rows


def concept(concept_id, name="c", domain="Drug", vocabulary="V", kind="K", standard="S", code="X", invalid=None):
    return (concept_id, name, domain, vocabulary, kind, standard, code, invalid)


VOCABULARY = {
    "concept": [concept(1, invalid="D"), concept(2), concept(3, invalid="U"), concept(4), concept(5)],
    "concept_ancestor": [(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2), (4, 4, 0), (4, 5, 1), (1, 5, 3)],
}


def test_listed_invalid_concept_stays_and_invalid_descendant_drops(bundle):
    cdm = bundle(**VOCABULARY)
    assert rows(concept_set(cdm, concepts(1, 99))) == [(1,), (2,), (4,), (5,)]
    assert rows(concept_set(cdm, concepts(1, 3, descendants=False))) == [(1,), (3,)]


def test_excluded_concepts(bundle):
    cdm = bundle(**VOCABULARY)
    assert rows(concept_set(cdm, concepts(1), without(4))) == [(1,), (2,)]
    assert rows(concept_set(cdm, concepts(1), without(4, descendants=False))) == [(1,), (2,), (5,)]


def test_drug_groups_by_code_length_and_ingredient(bundle):
    cdm = bundle(
        concept=[concept(0, kind="Ingredient"), concept(10, vocabulary="ATC", code="A01 "),
                 concept(11, vocabulary="ATC", code="A1"), concept(12, kind="Ingredient"),
                 concept(13, kind="Ingredient", domain="Device")],
        concept_ancestor=[(i, 20, 1) for i in (0, 10, 11, 12, 13)] + [(10, 20, 2)],
    )
    assert rows(drug_groups(cdm)) == [(20, 10), (20, 12)]


def test_end_dates_by_domain(bundle):
    day, next_day, later = d("2020-05-01"), d("2020-05-02"), d("2020-05-09")
    cdm = bundle(
        condition_occurrence=[(1, 1, 7, 0, 0, day, None, None), (2, 1, 7, 0, 0, day, later, 5)],
        device_exposure=[(1, 1, 7, day, None, None)],
        measurement=[(1, 1, 7, 1.0, 0, 0, day, None)],
        visit_occurrence=[(1, 1, 7, day, later)],
        death=[(1, day, None), (2, day, 3)],
    )
    at = lambda domain, **more: rows(events(cdm, Events(domain, **more)), "event_id", "start_date", "end_date")
    assert at("condition") == [(1, day, next_day), (2, day, later)]
    assert at("device") == [(1, day, None)]
    assert at("measurement") == [(1, day, next_day)]
    assert at("visit") == [(1, day, later)]
    assert at("visit", anchor="end") == [(1, later, later)]
    assert rows(events(cdm, Events("death")), "event_id", "target_concept_id") == [(1, 0), (2, 3)]


def test_first_event_is_chosen_before_the_other_filters(bundle):
    cdm = bundle(
        concept=[concept(7)],
        condition_occurrence=[(1, 1, 7, 0, 0, d("2019-01-01"), None, None), (2, 1, 7, 0, 0, d("2020-01-01"), None, None),
                              (4, 2, 7, 0, 0, d("2020-01-01"), None, None), (3, 2, 7, 0, 0, d("2020-01-01"), None, None)],
    )
    codes = Codesets(cdm, {0: [concepts(7)]})
    assert rows(events(cdm, Events("condition", 0, first=True, after=d("2019-06-01")), codes), "event_id") == [(3,)]


@pytest.mark.parametrize("source, expected", [(False, [(1,)]), (True, [(2,)])])
def test_source_concept(bundle, source, expected):
    cdm = bundle(
        concept=[concept(7)],
        condition_occurrence=[(1, 1, 7, 8, 0, d("2020-01-01"), None, None), (2, 1, 8, 7, 0, d("2020-01-01"), None, None)],
    )
    codes = Codesets(cdm, {0: [concepts(7)]})
    assert rows(events(cdm, Events("condition", 0, source=source), codes), "event_id") == expected
