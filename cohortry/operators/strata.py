"""Strata: split target cohorts by person, time and other cohorts.

The cross-reference comes from settings, so Spark knows its size and broadcasts
it without a hint.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.expressions import age_at, compare
from cohortry.operators.intervals import scan_days
from cohortry.session import small_table
from cohortry.sources.cdm import Cdm

AGE, GENDER, RACE, INDEX_DATE, FOLLOW_UP = "age", "gender", "race", "index_date", "follow_up"

# Script names used in the strata settings file.
SCRIPTS = {
    "StratifyByAge": AGE,
    "StratifyByGender": GENDER,
    "StratifyByRace": RACE,
    "StratifyByIndex": INDEX_DATE,
    "StratifyByFollowUpTime": FOLLOW_UP,
}

COHORT = ("cohort_definition_id", "subject_id", "cohort_start_date", "cohort_end_date")


@dataclass(frozen=True)
class Stratum:
    """``value <op> bound`` for one or two bounds, for example ``[(">=", 0), ("<", 18)]``."""

    strata_id: int
    name: str
    kind: str
    bounds: tuple[tuple[str, object], ...]


def strata_from_settings(rows: Sequence) -> list[Stratum]:
    """Strata from rows of the bulk strata settings file."""
    found = []
    for row in rows:
        kind = SCRIPTS[row["generation_script"].split("/")[-1].removesuffix(".sql")]
        sides = ((row["lb_operator"], row["lb_strata_value"]), (row["ub_operator"], row["ub_strata_value"]))
        bounds = tuple((op, _bound(kind, value)) for op, value in sides if op not in (None, "", "NA"))
        found.append(Stratum(row["cohort_id"], row["name"], kind, bounds))
    return found


def _bound(kind: str, value: str):
    numbers = [int(n) for n in re.findall(r"\d+", value)]
    return dt.date(*numbers) if kind == INDEX_DATE else numbers[0]


def target_strata_xref(targets: DataFrame, bulk: DataFrame, cohort_strata: DataFrame) -> DataFrame:
    """Every target with every stratum; "without" only for strata that are cohorts.

    The inputs are settings lists with ``cohort_id`` and ``name``.
    """
    target = targets.select(F.col("cohort_id").alias("target_id"), F.col("name").alias("target_name"))

    def pairs(strata: DataFrame, offset: int, cohort_type: str, word: str) -> DataFrame:
        stratum = strata.select(
            F.col("cohort_id").alias("strata_id"), F.trim("name").alias("stratum_name"), F.lit(1).alias("_study")
        )
        return target.withColumn("_study", F.lit(1)).join(stratum, "_study").select(
            "target_id",
            "strata_id",
            (F.col("target_id") * 1_000_000 + F.col("strata_id") * 10 + offset).cast("long").alias("cohort_id"),
            F.lit(cohort_type).alias("cohort_type"),
            F.concat_ws(" ", "target_name", F.lit(word), "stratum_name").alias("name"),
        )

    everything = bulk.select("cohort_id", "name").unionByName(cohort_strata.select("cohort_id", "name"))
    return pairs(everything, 1, "TwS", "with").unionByName(pairs(cohort_strata, 2, "TwoS", "without"))


def duplicate_ids(*settings: DataFrame) -> DataFrame:
    """Cohort ids that occur more than once over all settings lists."""
    together = settings[0].select("cohort_id")
    for one in settings[1:]:
        together = together.unionByName(one.select("cohort_id"))
    return together.groupBy("cohort_id").agg(F.count("*").alias("n")).where("n > 1")


def check_unique_ids(*settings: DataFrame) -> None:
    found = [row.cohort_id for row in duplicate_ids(*settings).limit(20).collect()]
    if found:
        raise ValueError(f"cohort ids used more than once: {found}")


def stratify(cdm: Cdm, cohort: DataFrame, xref: DataFrame, strata: Sequence[Stratum]) -> DataFrame:
    """Stratified cohorts of all given strata in one pass over the target cohorts.

    Person is joined once, each row is tested against every stratum, and only
    the strata it belongs to are spread out. Follow-up strata are a branch of
    their own: only they repeat a row for every observation period that holds it.
    """
    by_period = [s for s in strata if s.kind == FOLLOW_UP]
    others = [s for s in strata if s.kind != FOLLOW_UP]
    if by_period and others:
        return stratify(cdm, cohort, xref, others).unionByName(stratify(cdm, cohort, xref, by_period))
    pairs = xref.where(F.col("cohort_type") == "TwS").select("target_id", "strata_id", "cohort_id").distinct()
    targets = xref.select(F.col("target_id").alias("cohort_definition_id")).distinct()
    rows = cohort.join(targets, "cohort_definition_id", "left_semi")
    kinds = {stratum.kind for stratum in strata}
    if kinds & {AGE, GENDER, RACE}:
        person = cdm["person"].select(
            F.col("person_id").alias("subject_id"), "year_of_birth", "gender_concept_id", "race_concept_id"
        )
        rows = rows.join(person, "subject_id", "left")
    if RACE in kinds:
        rows = rows.join(_race_parents(cdm, strata), "race_concept_id", "left")
    if FOLLOW_UP in kinds:
        period = cdm["observation_period"].select(
            F.col("person_id").alias("subject_id"), "observation_period_start_date", "observation_period_end_date"
        )
        inside = (
            (rows["subject_id"] == period["subject_id"])
            & (F.col("cohort_start_date") >= F.col("observation_period_start_date"))
            & (F.col("cohort_start_date") <= F.col("observation_period_end_date"))
        )
        rows = rows.join(period, inside, "left").drop(period["subject_id"])
    member = [F.when(_belongs(stratum), F.lit(stratum.strata_id).cast("long")) for stratum in strata]
    return (
        rows.withColumn("strata_id", F.explode(F.array_compact(F.array(*member))))
        .withColumnRenamed("cohort_definition_id", "target_id")
        .join(pairs, ["target_id", "strata_id"])
        .select(F.col("cohort_id").alias("cohort_definition_id"), *COHORT[1:])
    )


def _belongs(stratum: Stratum) -> Column:
    start = F.col("cohort_start_date")
    value = {
        AGE: lambda: age_at(start, F.col("year_of_birth")),
        GENDER: lambda: F.col("gender_concept_id"),
        INDEX_DATE: lambda: start,
        FOLLOW_UP: lambda: F.date_diff("observation_period_end_date", start) + 1,
    }
    if stratum.kind == RACE:
        return F.array_contains("race_parents", F.lit(stratum.bounds[0][1]).cast("long"))
    found = F.lit(True)
    for operator, bound in stratum.bounds:
        found &= compare(value[stratum.kind](), operator, bound)
    return found


def _race_parents(cdm: Cdm, strata: Sequence[Stratum]) -> DataFrame:
    """For each race concept the race strata above it; no longer than the list of strata."""
    wanted = [stratum.bounds[0][1] for stratum in strata if stratum.kind == RACE]
    return (
        cdm["concept_ancestor"]
        .where(F.col("ancestor_concept_id").isin(*wanted))
        .groupBy(F.col("descendant_concept_id").alias("race_concept_id"))
        .agg(F.collect_set(F.col("ancestor_concept_id").cast("long")).alias("race_parents"))
    )


def stratify_by_cohorts(cohort: DataFrame, xref: DataFrame) -> DataFrame:
    """Targets with (TwS) and without (TwoS) another cohort at their index date.

    A row "with" is repeated for every interval of the stratum cohort that holds
    its index date; a row "without" has none. The counters of all strata are
    looked up once per index date; only then a row is spread over its pairs.
    """
    strata = [row["strata_id"] for row in xref.select("strata_id").distinct().orderBy("strata_id").collect()]
    if not strata:
        return cohort.select(*COHORT).limit(0)
    place = small_table(cohort.sparkSession, [(s, i + 1) for i, s in enumerate(strata)], "strata_id long, _place int")
    pairs = xref.select("target_id", "strata_id", "cohort_id", "cohort_type").join(place, "strata_id")
    targets = cohort.withColumnRenamed("cohort_definition_id", "target_id").join(pairs.select("target_id").distinct(), "target_id", "left_semi")
    open_intervals = F.coalesce(F.element_at("_open", F.col("_place")), F.lit(0).cast("long"))
    copies = F.when(F.col("cohort_type") == "TwS", open_intervals).otherwise(F.when(open_intervals == 0, 1).otherwise(0))
    return (
        targets.join(_open_strata(cohort, targets, strata), ["subject_id", "cohort_start_date"], "left")
        .join(pairs, "target_id")
        .withColumn("_copies", copies)
        .where("_copies > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
        .select(F.col("cohort_id").alias("cohort_definition_id"), *COHORT[1:])
    )


def stratify_with(cohort: DataFrame, xref: DataFrame) -> DataFrame:
    """Target rows whose index date lies in an interval of the stratum cohort."""
    return stratify_by_cohorts(cohort, xref.where(F.col("cohort_type") == "TwS"))


def stratify_without(cohort: DataFrame, xref: DataFrame) -> DataFrame:
    """Target rows whose index date lies in no interval of the stratum cohort."""
    return stratify_by_cohorts(cohort, xref.where(F.col("cohort_type") == "TwoS"))


def replace_strata(staging: DataFrame, xref: DataFrame, split: DataFrame) -> DataFrame:
    """Staging cohorts in which the stratified cohorts take the place of earlier ones."""
    replaced = xref.select(F.col("cohort_id").alias("cohort_definition_id"))
    return staging.join(replaced, "cohort_definition_id", "left_anti").unionByName(split)


def _open_strata(cohort: DataFrame, targets: DataFrame, strata: Sequence[int]) -> DataFrame:
    """``_open``: per subject and index date the open intervals of every stratum cohort, as one array of counters.

    Starts count up, days after ends count down; the running sum at a day is the
    number of intervals open on it.
    """
    step = F.explode(F.array(
        F.struct(F.col("cohort_start_date").alias("day"), F.lit(1).cast("long").alias("n")),
        F.struct(F.date_add("cohort_end_date", 1).alias("day"), F.lit(-1).cast("long").alias("n")),
    ))
    steps = cohort.where(F.col("cohort_definition_id").isin(*strata)).select("subject_id", "cohort_definition_id", step.alias("step"))
    changes = [F.coalesce(F.sum(F.when(F.col("cohort_definition_id") == s, F.col("step.n"))), F.lit(0)).alias(f"_n{s}") for s in strata]
    facts = steps.groupBy("subject_id", F.col("step.day").alias("day")).agg(*changes)
    points = targets.select("subject_id", "cohort_start_date").distinct().withColumn("day", F.col("cohort_start_date"))
    seen = scan_days(points, facts, ["subject_id"], {f"_n{s}": "sum" for s in strata})
    return seen.select("subject_id", "cohort_start_date", F.array(*[F.col(f"_n{s}") for s in strata]).alias("_open"))
