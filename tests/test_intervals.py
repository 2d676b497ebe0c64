"""Interval operators against hand-made rows and against brute force."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cohortry.operators.intervals import (
    LEVELS,
    _places_by_range,
    collapse_eras,
    first_per,
    in_observation,
    number_events,
    on_all_levels,
    on_own_level,
    overlap_join,
    scan_days,
)
from tests.conftest import d, rows

INTERVAL = "person_id long, start_date date, end_date date"
DAY = dt.date(2020, 1, 1)


def day(n: int) -> dt.date:
    return DAY + dt.timedelta(days=n)


def intervals(seed: int, persons: int, n: int, span: int, hot: bool = False):
    """Random intervals; with ``hot`` person 0 holds a third of them."""
    draw = random.Random(seed)
    out = []
    for i in range(n):
        person = 0 if hot and i % 3 == 0 else draw.randrange(persons)
        start = draw.randrange(span)
        out.append((person, day(start), day(start + draw.randrange(12))))
    return out


def brute_collapse(data, pad):
    out = []
    for person in sorted({r[0] for r in data}):
        eras = []
        for _, start, end in sorted(r for r in data if r[0] == person):
            if eras and start <= eras[-1][1] + dt.timedelta(days=pad):
                eras[-1][1] = max(eras[-1][1], end)
            else:
                eras.append([start, end])
        out += [(person, s, e) for s, e in eras]
    return sorted(out)


@pytest.mark.parametrize("pad, expected", [
    (0, [(1, d("2020-01-01"), d("2020-01-20")), (2, d("2020-01-01"), d("2020-01-10")), (2, d("2020-01-11"), d("2020-01-20"))]),
    (1, [(1, d("2020-01-01"), d("2020-01-20")), (2, d("2020-01-01"), d("2020-01-20"))]),
])
def test_touching_eras(frame, pad, expected):
    df = frame(INTERVAL, (1, d("2020-01-01"), d("2020-01-10")), (1, d("2020-01-10"), d("2020-01-20")),
               (2, d("2020-01-01"), d("2020-01-10")), (2, d("2020-01-11"), d("2020-01-20")))
    assert rows(collapse_eras(df, pad=pad), "person_id", "start_date", "end_date") == expected


def test_pad_across_years(frame):
    df = frame(INTERVAL, (1, d("2019-10-01"), d("2019-10-05")), (1, d("2020-04-02"), d("2020-04-03")),
               (1, d("2020-10-01"), d("2020-10-02")))
    assert rows(collapse_eras(df, pad=180), "start_date", "end_date") == [
        (d("2019-10-01"), d("2020-04-03")), (d("2020-10-01"), d("2020-10-02"))]


@pytest.mark.parametrize("pad", [0, 1, 5, 30])
def test_collapse_matches_brute_force_and_is_idempotent(frame, pad):
    data = intervals(pad, 8, 300, 400, hot=True)
    once = collapse_eras(frame(INTERVAL, *data), pad=pad)
    assert rows(once, "person_id", "start_date", "end_date") == sorted(
        brute_collapse(data, pad), key=lambda r: [(False, str(v)) for v in r])
    assert rows(collapse_eras(once, pad=pad)) == rows(once)


def test_collapsed_days_are_the_union_of_days(frame):
    data = intervals(7, 5, 200, 300)
    covered = {(p, s + dt.timedelta(days=i)) for p, s, e in data for i in range((e - s).days + 1)}
    eras = rows(collapse_eras(frame(INTERVAL, *data)), "person_id", "start_date", "end_date")
    assert sum((e - s).days + 1 for _, s, e in eras) == len(covered)


def test_overlap_join_matches_brute_force_and_emits_once(frame):
    left, right = intervals(1, 4, 120, 900, hot=True), intervals(2, 4, 120, 900, hot=True)
    a = frame("person_id long, a_from date, a_to date", *left)
    b = frame("person_id long, b_from date, b_to date", *right)
    found = overlap_join(a, b, ["person_id"], ("a_from", "a_to"), ("b_from", "b_to"), width=20)
    wanted = [(x[0], x[1], x[2], y[1], y[2]) for x in left for y in right
              if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2]]
    assert rows(found, "person_id", "a_from", "a_to", "b_from", "b_to") == sorted(
        wanted, key=lambda r: [(False, str(v)) for v in r])


def test_a_span_of_any_length_lies_in_two_slices(frame):
    spans = [(1, day(3), day(3)), (2, day(0), day(366 * 9)), (3, dt.date(1, 1, 1), dt.date(9999, 12, 31)), (4, day(5), day(2)), (5, day(5), None)]
    df = frame("id long, f date, t date", *spans)
    found = {r["id"]: r["n"] for r in on_own_level(df, ("f", "t")).groupBy("id").count().withColumnRenamed("count", "n").collect()}
    assert set(found) == {1, 2, 3} and max(found.values()) <= 2
    # A date with its windows is cut once or twice a level.
    assert on_all_levels(frame("id long, f date, t date", (1, day(0), day(395))), ("f", "t")).count() <= 3 + 2 * (LEVELS - 1)


def test_long_spans_meet_all_they_overlap_once(frame):
    left = intervals(11, 3, 60, 20_000)
    right = [(p, s, s + dt.timedelta(days=(e - s).days * 400)) for p, s, e in intervals(12, 3, 60, 20_000)] + [(0, dt.date(1, 1, 1), dt.date(9999, 12, 31))]
    a, b = frame("person_id long, a_from date, a_to date", *left), frame("person_id long, b_from date, b_to date", *right)
    found = overlap_join(a, b, ["person_id"], ("a_from", "a_to"), ("b_from", "b_to"))
    wanted = [(x[0], x[1], x[2], y[1], y[2]) for x in left for y in right if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2]]
    assert rows(found, "person_id", "a_from", "a_to", "b_from", "b_to") == sorted(wanted, key=lambda r: [(False, str(v)) for v in r])


def test_clipped_spans_meet_all_they_overlap_once(frame):
    left = [*intervals(13, 3, 60, 2_000), (0, None, None), (1, day(9), day(3))]
    right = [*intervals(14, 3, 60, 20_000), (0, dt.date(1, 1, 1), dt.date(9999, 12, 31)), (1, dt.date(1, 1, 1), day(0)), (2, day(5), None)]
    a, b = frame("person_id long, a_from date, a_to date", *left), frame("person_id long, b_from date, b_to date", *right)
    spans = (["person_id"], ("a_from", "a_to"), ("b_from", "b_to"))
    found = rows(overlap_join(a, b, *spans, clip=True), "person_id", "a_from", "a_to", "b_from", "b_to")
    assert found and found == rows(overlap_join(a, b, *spans), "person_id", "a_from", "a_to", "b_from", "b_to")
    assert overlap_join(a.limit(0), b, *spans, clip=True).count() == 0


def test_number_events_matches_window(frame):
    data = [(r[0], i, r[1]) for i, r in enumerate(intervals(3, 6, 400, 50, hot=True))]
    numbered = number_events(frame("person_id long, event_id long, sort_date date", *data))
    place, wanted = {}, []
    for person, event, date in sorted(data, key=lambda r: (r[0], r[2], r[1])):
        place[person] = place.get(person, 0) + 1
        wanted.append((person, event, place[person]))
    assert sorted(rows(numbered, "person_id", "event_id", "ordinal")) == sorted(wanted)


def test_a_hot_day_is_numbered_in_ranges(frame, spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        data = [(1, i * 7919 % 3001, day(5), i % 3) for i in range(1500)] + [(1, 5000 + i, day(i), 0) for i in range(9)] + [(2, 9000 + i, day(5), 1) for i in range(20)]
        df = frame("person_id long, event_id long, sort_date date, rank int", *data).repartition(5)
        numbered = number_events(df, ties=("rank", "event_id"), hot_day=100)
        place, wanted = {}, []
        for person, event, date, rank in sorted(data, key=lambda r: (r[0], r[2], r[3], r[1])):
            place[person] = place.get(person, 0) + 1
            wanted.append((person, event, place[person]))
        assert sorted(rows(numbered, "person_id", "event_id", "ordinal")) == sorted(wanted)
        hot = df.where("person_id = 1").where(F.col("sort_date") == F.lit(day(5)))
        shares = [r["n"] for r in _places_by_range(hot, ["person_id", "sort_date"], ["rank", "event_id"]).groupBy("_range").agg(F.count("*").alias("n")).collect()]
        assert sum(shares) == 1501 and len(shares) >= 3 and max(shares) < 1501 / 2
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_scan_days_reads_up_to_and_from_a_day(frame):
    facts = frame("person_id long, day date, n long", (1, day(1), 2), (1, day(3), 5), (2, day(1), 7))
    points = frame("person_id long, day date, tag string", (1, day(0), "a"), (1, day(1), "b"), (1, day(9), "c"),
                   (3, day(1), "d"))
    assert rows(scan_days(points, facts, ["person_id"], {"n": "sum"}), "tag", "n") == [
        ("a", None), ("b", 2), ("c", 7), ("d", None)]
    assert rows(scan_days(points, facts, ["person_id"], {"n": "min"}, forward=True), "tag", "n") == [
        ("a", 2), ("b", 2), ("c", None), ("d", None)]


def test_observation_periods_per_event(frame):
    """Two periods, one overlapping the other: an event in both counts in both."""
    ev = frame("person_id long, start_date date", (1, d("2020-01-15")), (1, d("2020-03-01")), (1, d("2021-01-01")))
    op = frame("observation_period", (1, 1, d("2020-01-01"), d("2020-02-01"), 1), (2, 1, d("2020-01-10"), d("2020-06-01"), 1))
    found = in_observation(ev, op)
    assert rows(found, "start_date", "op_start_date") == [
        (d("2020-01-15"), d("2020-01-01")), (d("2020-01-15"), d("2020-01-10")), (d("2020-03-01"), d("2020-01-10"))]
    assert rows(in_observation(ev, op, prior=14, post=10), "start_date", "op_start_date") == [
        (d("2020-01-15"), d("2020-01-01")), (d("2020-03-01"), d("2020-01-10"))]


def test_first_per_key_is_cut_before_the_shuffle(frame):
    df = frame(INTERVAL, *intervals(4, 5, 50, 100))
    first = first_per(df, ["person_id"], ["start_date", "end_date"])
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert len(rows(first)) == 5
