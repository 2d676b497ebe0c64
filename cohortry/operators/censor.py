"""Cohort sizes and the removal of cohorts that are too small to report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cohort_persons(cohort: DataFrame) -> DataFrame:
    """Distinct persons per cohort."""
    return cohort.groupBy("cohort_definition_id").agg(F.count_distinct("subject_id").alias("num_persons"))


def censor_cohorts(staging: DataFrame, xref: DataFrame, min_cell: int) -> DataFrame:
    """Rows of the cohorts that may be reported.

    Targets need more than ``min_cell`` persons. A with/without pair stays only
    if both sides have. Strata that come as a single cohort type always stay.
    """
    # At most as many ids as the cross-reference lists, a settings table: no count is needed.
    feasible = F.broadcast(feasible_cohorts(cohort_persons(staging), xref, min_cell))
    return staging.join(feasible, "cohort_definition_id", "left_semi")


def feasible_cohorts(persons: DataFrame, xref: DataFrame, min_cell: int) -> DataFrame:
    """Ids of the cohorts that ``censor_cohorts`` keeps."""
    enough = persons.where(F.col("num_persons") > min_cell).select("cohort_definition_id")
    targets = enough.join(
        xref.select(F.col("target_id").alias("cohort_definition_id")), "cohort_definition_id", "left_semi"
    )
    sized = xref.join(
        enough.select(F.col("cohort_definition_id").alias("cohort_id"), F.lit(True).alias("enough")),
        "cohort_id", "left",
    )
    pair = sized.groupBy("target_id", "strata_id").agg(
        F.count_distinct("cohort_type").alias("types"),
        F.count_distinct(F.when(F.col("enough"), F.col("cohort_type"))).alias("types_enough"),
    )
    judged = sized.join(pair, ["target_id", "strata_id"])
    single = judged.where("types = 1")
    paired = judged.where("types > 1 AND enough AND types_enough > 1")
    kept = single.select("cohort_id").unionByName(paired.select("cohort_id"))
    return targets.unionByName(kept.select(F.col("cohort_id").alias("cohort_definition_id"))).distinct()


def cohort_counts(cohort: DataFrame, cohort_ids: Sequence[int] | None = None) -> DataFrame:
    """Entries and distinct subjects per cohort, for all or the listed cohorts."""
    if cohort_ids is not None:
        cohort = cohort.where(F.col("cohort_definition_id").isin(*cohort_ids))
    return cohort.groupBy(F.col("cohort_definition_id").alias("cohort_id")).agg(
        F.count("*").alias("cohort_entries"), F.count_distinct("subject_id").alias("cohort_subjects")
    )


def planned_counts(planned: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts of all planned cohorts; NULL where a cohort has no rows."""
    return planned.select("name", "cohort_id").join(counts, "cohort_id", "left")


def instantiated(planned: DataFrame, cohort: DataFrame) -> DataFrame:
    """``cohort_id, instantiated`` for all planned cohorts: which of them have rows?"""
    ids = planned.select("cohort_id").distinct()
    built = cohort.select(F.col("cohort_definition_id").alias("cohort_id")).distinct().withColumn("_built", F.lit(True))
    return ids.join(built, "cohort_id", "left").select("cohort_id", F.coalesce("_built", F.lit(False)).alias("instantiated"))


def with_min_subjects(counts: DataFrame, min_subjects: int | Column = 140) -> DataFrame:
    """Cohorts large enough for characterization."""
    return counts.where(F.col("cohort_subjects") >= min_subjects)
