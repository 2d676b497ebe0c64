"""Corner counts, and the criteria that rest on them, against plain counting."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from cohortry.operators.criteria import Criterion, Window, all_in, any_in, count_hits, day, evaluate
from cohortry.operators.dominance import count_dominated, with_previous
from cohortry.operators.events import FrameEvents
from tests.conftest import rows
from tests.test_intervals import day as at

INDEX = "person_id long, start_date date, end_date date, op_start_date date, op_end_date date"
EVENT = ("person_id long, event_id long, start_date date, end_date date, target_concept_id long, "
         "visit_occurrence_id long, sort_date date")


def test_corners_are_plain_counts(frame):
    rng = random.Random(1)
    facts = [(rng.choice([1, 1, 1, 2]), at(rng.randint(0, 40)), rng.choice([rng.randint(-5, 60), -(2**40)]), rng.randint(1, 3)) for _ in range(400)]
    points = [(rng.choice([1, 2, 3]), at(rng.randint(-3, 45)), rng.choice([rng.randint(-9, 70), -(2**40), 2**40]), i) for i in range(120)]
    found = count_dominated(frame("k long, day date, y long, id long", *points), frame("k long, day date, y long, n long", *facts), ["k"])
    counted = {r["id"]: r["n"] for r in found.groupBy("id").agg(F.sum("n").alias("n")).collect()}
    for k, x, y, i in points:
        assert counted.get(i, 0) == sum(n for fk, fx, fy, n in facts if fk == k and fx <= x and fy <= y)


def test_nothing_to_count(frame):
    facts, points = "k long, day date, y long, n long", "k long, day date, y long, id long"
    assert count_dominated(frame(points, (1, at(0), 5, 1)), frame(facts), ["k"]).collect() == []
    assert count_dominated(frame(points, (1, None, 5, 1), (1, at(1), None, 2)), frame(facts, (1, at(0), 1, 1)), ["k"]).collect() == []


def test_previous_occurrences(frame):
    seen = frame("person_id long, concept long, day date", (1, 7, at(3)), (1, 7, at(3)), (1, 8, at(3)), (1, 7, at(9)), (2, 7, at(9)))
    first = rows(seen.select(F.unix_date("day").cast("long")).distinct())
    assert rows(with_previous(seen, ["person_id"], -99)) == [(1, at(3), -99, 2), (1, at(9), first[0][0], 1), (2, at(9), -99, 1)]


def _plain(index, others, criterion):
    window, low, high = criterion.window, None, None
    _, start, end, op_start, op_end = index

    def edge(e):
        anchor = start if e.anchor == "start" else end
        return None if anchor is None else anchor + (at(e.days) - at(0))

    found = []
    for _, _, s, e, concept, _, _ in [o for o in others if o[0] == index[0] and o[4] is not None]:
        tests = []
        for bound, value, sign in ((window.starts_from, s, 1), (window.starts_to, s, -1), (window.ends_from, e, 1), (window.ends_to, e, -1)):
            if bound is not None:
                limit = edge(bound)
                tests.append(value is not None and limit is not None and (value >= limit if sign > 0 else value <= limit))
        if not window.ignore_observation:
            tests.append(op_start <= s <= op_end)
        if window.ends_in_observation:
            tests.append(e is not None and e <= op_end)
        if all(tests):
            found.append(concept)
    return len(set(found)) if criterion.distinct else len(found)


CASES = [
    dict(window=Window(starts_to=day(0), ends_from=day(0), ends_to=day(6))),
    dict(window=Window(starts_from=day(-20), starts_to=day(5), ends_from=day(-3), ends_in_observation=True), at_least=2),
    dict(window=Window(ends_to=day(2, "end"), ignore_observation=True), at_least=3),
    dict(window=Window(starts_from=day(4), starts_to=day(-4), ends_from=day(0)), at_least=2),
    dict(window=Window(ends_from=day(5), ends_to=day(-5)), at_least=2),
    dict(window=Window(starts_from=day(-15)), at_least=2, distinct=True),
    dict(window=Window(starts_from=day(-9), starts_to=day(9, "end")), at_least=3, distinct=True),
    dict(window=Window(ignore_observation=True), at_least=3, distinct=True),
    dict(window=Window(starts_to=day(-1), ignore_observation=True), exactly=0, distinct=True),
    dict(window=Window(starts_from=day(3), starts_to=day(-3)), at_least=1, distinct=True),
    dict(window=Window(starts_from=day(-9), ends_to=day(9)), at_least=2, distinct=True),
]


@pytest.mark.parametrize("hot", [False, True])
def test_all_kinds_of_criteria_together(bundle, frame, hot):
    rng = random.Random(5)
    person = (lambda: 1 if rng.random() < 0.6 else rng.randint(2, 5)) if hot else (lambda: rng.randint(1, 6))
    index = sorted({(p, at(s), None if rng.random() < 0.1 else at(s + rng.randint(0, 8)), at(s - 30), at(s + 30)) for p, s in [(person(), rng.randint(0, 90)) for _ in range(60)]}, key=str)
    others = []
    for i in range(400):
        s = rng.randint(-10, 100)
        others.append((person(), i, at(s), None if rng.random() < 0.1 else at(s + rng.randint(0, 12)), rng.choice([1, 2, 3, 4, 5, None]), None, at(s)))
    criteria = [Criterion(FrameEvents(frame(EVENT, *others)), **case) for case in CASES]
    criteria += [Criterion(criteria[0].events, Window(starts_from=day(-5), starts_to=day(5)), at_least=2), Criterion(criteria[0].events, Window(starts_to=day(0), ends_from=day(0)))]
    found = {tuple(r)[:5]: r for r in count_hits(bundle(observation_period=[(1, p, at(-100), at(300), 1) for p in range(1, 7)]), None, frame(INDEX, *index), criteria).collect()}
    assert len(found) == len(index)
    for row in index:
        for i, criterion in enumerate(criteria[:-1]):
            assert found[row][f"_hits_{i}"] == _plain(row, others, criterion), (row, i)


def test_plan_grows_with_the_criteria_and_not_faster(bundle, frame, spark, tmp_path):
    frame(EVENT, (1, 1, at(0), at(1), 1, None, at(0))).write.parquet(str(tmp_path / "events"))
    frame(INDEX, (1, at(0), at(1), at(-9), at(9))).write.parquet(str(tmp_path / "index"))
    events, index = spark.read.parquet(str(tmp_path / "events")), spark.read.parquet(str(tmp_path / "index"))

    def scans(n):
        group = any_in(*[Criterion(FrameEvents(events), Window(starts_to=day(0), ends_from=day(0), ends_to=day(i)), at_least=2) for i in range(n)])
        plan = evaluate(bundle(), None, index, [group], ["kept"])._jdf.queryExecution().optimizedPlan().toString()
        return len(re.findall(r"Relation \[", plan))

    one, two, four = scans(1), scans(2), scans(4)
    assert two - one == (four - two) / 2 and four <= 4 * one


def test_runs_of_a_hot_person_are_spread(frame):
    facts = frame("person_id long, criterion int, day date, y long, n long", (1, 0, at(0), 5, 1))
    points = frame("person_id long, criterion int, day date, y long, id long", (1, 0, at(0), 5, 1))
    plan = count_dominated(points, facts, ["person_id", "criterion"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(person_id#\d+L, criterion#\d+, level#\d+, run#\d+L", plan)
