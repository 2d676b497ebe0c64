"""Shaping of results for export: privacy, covariate lists, cohort lists, key checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.expressions import censor_below, last_digit
from cohortry.operators.features import FEATURE_ANALYSIS
from cohortry.operators.intervals import first_per


def enforce_min_cell(df: DataFrame, column: str, minimum) -> DataFrame:
    """Replace small non-zero values by minus the minimum (a number or a column)."""
    minimum = F.col(minimum) if isinstance(minimum, str) else F.lit(minimum)
    return df.withColumn(column, censor_below(F.col(column), minimum))


def censor_counts(counts: DataFrame, min_cell: int) -> DataFrame:
    for column in ("cohort_entries", "cohort_subjects"):
        counts = enforce_min_cell(counts, column, min_cell)
    return counts


def covariate_values(results: DataFrame, counts: DataFrame, min_cell: int, database_id: str) -> DataFrame:
    """Means and deviations for export.

    Means below ``min_cell`` entries are censored and lose their deviation, both
    values are rounded half to even to three digits. Cohorts without counts drop
    out.
    """
    entries = counts.select("cohort_id", "cohort_entries").distinct()
    smallest = F.try_divide(F.lit(float(min_cell)), F.col("cohort_entries").cast("double"))
    mean = censor_below(F.col("mean"), smallest)
    return results.join(entries, "cohort_id").select(
        "cohort_id",
        "covariate_id",
        F.bround(mean, 3).alias("mean"),
        F.bround(F.when(~(mean < 0), F.col("sd")), 3).alias("sd"),
        F.lit(database_id).alias("database_id"),
    )


def covariate_list(results: DataFrame) -> DataFrame:
    """Distinct covariates whose mean is not zero at four digits."""
    return results.where(F.bround("mean", 4) != 0).select(
        "covariate_id", "covariate_name", F.col("analysis_id").cast("long").alias("covariate_analysis_id")
    ).distinct()


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def cohorts_for_export(cohorts: DataFrame, xref: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Study cohorts and stratified cohorts by id and name, those with counts if given."""
    own = cohorts.select("cohort_id", F.col("name").alias("cohort_name"), F.col("name").alias("cohort_full_name"),
                         "cohort_type")
    split = xref.select("cohort_id", F.col("name").alias("cohort_name"), F.col("name").alias("cohort_full_name"),
                        "cohort_type")
    together = own.unionByName(split)
    return together if counts is None else together.join(counts.select("cohort_id"), "cohort_id", "left_semi")


def with_target_and_strata(exported: DataFrame, xref: DataFrame) -> DataFrame:
    """Add target and stratum ids; a cohort that is no stratum is its own target with stratum 0."""
    split = xref.select("cohort_id", "target_id", "strata_id")
    return exported.join(split, "cohort_id", "left").withColumns({
        "target_id": F.coalesce("target_id", "cohort_id"),
        "strata_id": F.coalesce("strata_id", F.lit(0).cast("long")),
    })


def cohorts_with_details(cohorts: DataFrame, xref: DataFrame, strata: DataFrame) -> DataFrame:
    """Cohorts with the names of their target and stratum; stratum 0 is ``All``."""
    own = cohorts.select(
        "cohort_id",
        F.col("name").alias("cohort_name"),
        F.col("cohort_id").alias("target_id"),
        F.col("name").alias("target_name"),
        F.lit(0).cast("long").alias("strata_id"),
        F.lit("All").alias("strata_name"),
        "cohort_type",
    )
    target = cohorts.select(F.col("cohort_id").alias("target_id"), F.col("name").alias("target_name"))
    stratum = strata.select(F.col("cohort_id").alias("strata_id"), F.col("name").alias("strata_name"))
    split = xref.join(target, "target_id").join(stratum, "strata_id").withColumnRenamed("name", "cohort_name")
    return own.unionByName(split.select(own.columns))


def attrition(inclusion: DataFrame, stats: DataFrame, result: DataFrame) -> DataFrame:
    """Persons left after each inclusion rule of a cohort.

    A person group counts for rule ``k`` if its mask has the bits 0 to ``k``; a
    mask holds up to 63 rules.
    """
    rules = inclusion.select("rule_sequence", "name").distinct()
    mine = stats.where("mode_id = 0").select("rule_sequence", "person_count", "gain_count", "person_total")
    up_to = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: _has_all(F.col("inclusion_rule_mask"), k))
    remain = (
        result.where("mode_id = 0")
        .withColumn("rule_sequence", F.explode(up_to))
        .groupBy("rule_sequence")
        .agg(F.sum("person_count").alias("remain_subjects"))
    )
    return (
        rules.join(mine, "rule_sequence")
        .join(remain, "rule_sequence", "left")
        .select(
            F.col("rule_sequence").alias("rule_sequence_id"),
            F.col("name").alias("rule_name"),
            F.col("person_count").alias("meet_subjects"),
            F.col("gain_count").alias("gain_subjects"),
            F.col("person_total").alias("total_subjects"),
            F.coalesce("remain_subjects", F.lit(0).cast("long")).alias("remain_subjects"),
        )
    )


def _has_all(mask: Column, k: Column) -> Column:
    lowest = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 63 - k)
    return mask.bitwiseAND(lowest) == lowest


def dedupe_covariates(covariates: DataFrame) -> DataFrame:
    """One row per covariate id over all sites (the first by name), with its window."""
    kept = first_per(covariates, ["covariate_id"], ["covariate_name", "covariate_analysis_id"])
    return kept.withColumn("time_window_id", last_digit(F.col("covariate_id")))


def clean_covariates(covariates: DataFrame, marks: DataFrame) -> DataFrame:
    """Choose names for covariate ids that sites name differently.

    In order of priority: ids with a single row; rows of feature cohorts; rows of
    ids marked as plain ASCII.
    """
    seen = covariates.groupBy("covariate_id").agg(
        F.count("*").alias("_rows"), F.bool_or(_is_cohort()).alias("_any_cohort")
    )
    marked = marks.where(F.col("mark") == "ASCII").select("covariate_id").distinct().withColumn("_ascii", F.lit(True))
    judged = covariates.join(seen, "covariate_id").join(marked, "covariate_id", "left")
    keep = (
        (F.col("_rows") == 1)
        | ((F.col("_rows") > 1) & _is_cohort())
        | ((F.col("_rows") > 1) & ~F.col("_any_cohort") & F.col("_ascii"))
    )
    return judged.where(keep).select(
        "covariate_id", "covariate_name", "covariate_analysis_id",
        last_digit(F.col("covariate_id")).alias("time_window_id"),
    ).distinct()


def _is_cohort():
    return F.coalesce(
        F.col("covariate_name").ilike("cohort%") & (F.col("covariate_analysis_id") == FEATURE_ANALYSIS), F.lit(False)
    )


def covariate_coverage(covariates: DataFrame, marks: DataFrame) -> DataFrame:
    """Distinct covariate ids, marked ids, and ids without a mark, as one row."""
    ids = covariates.select("covariate_id").distinct()
    marked = marks.select("covariate_id").distinct().withColumn("_marked", F.lit(True))
    return ids.join(marked, "covariate_id", "full_outer").join(
        ids.withColumn("_known", F.lit(True)), "covariate_id", "left"
    ).agg(
        F.count_if(F.col("_known")).alias("covariates"),
        F.count_if(F.col("_marked")).alias("marked"),
        F.count_if(F.col("_known") & F.col("_marked").isNull()).alias("unmarked"),
    )


# Covariate ids of the age groups from 100 to 199 years, whose names
# show only two digits.
FIRST_OLD_AGE, LAST_OLD_AGE, AGE_STEP = 200031, 380031, 10000


def fix_covariate_names(covariates: DataFrame) -> DataFrame:
    """Lower-case names, drop duplicates, and name the age groups above 99 years rightly."""
    lowered = covariates.withColumn("covariate_name", F.lower("covariate_name")).distinct()
    old = F.col("covariate_id").between(FIRST_OLD_AGE, LAST_OLD_AGE) & (
        (F.col("covariate_id") - FIRST_OLD_AGE) % AGE_STEP == 0
    )
    years = [F.regexp_extract("covariate_name", r"(\d+)-(\d+)", i).try_cast("int") + 100 for i in (1, 2)]
    fixed = F.concat(F.lit("age group: "), years[0].cast("string"), F.lit("-"), years[1].cast("string"))
    return lowered.withColumn("covariate_name", F.when(old, fixed).otherwise(F.col("covariate_name")))


def distinct_cohort_names(cohorts: DataFrame) -> DataFrame:
    return cohorts.select("cohort_name", "cohort_full_name", "cohort_id").distinct()


def typed_cohort_xref(raw: DataFrame) -> DataFrame:
    """Cohort cross-reference read as text, with its ids as numbers."""
    return raw.select(
        *[F.col(c).cast("long").alias(c) for c in ("cohort_id", "target_id")],
        "target_name",
        F.col("strata_id").cast("long").alias("strata_id"),
        "strata_name",
        "cohort_type",
    )


# Primary keys of the result tables.
PRIMARY_KEYS = {
    "cohort": ("cohort_id",),
    "cohort_count": ("cohort_id", "database_id"),
    "covariate": ("covariate_id", "covariate_name"),
    "covariate_value": ("cohort_id", "covariate_id", "database_id"),
    "database": ("database_id",),
}


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


# What must be unique besides, once sites are merged and names are cleaned.
MERGED_KEYS = {"covariate": ("covariate_id",)}


def check_primary_key(df: DataFrame, table: str, merged: bool = False) -> None:
    """Raise if two rows of a result table share their key.

    ``merged`` asks for the keys after the clean-up of merged sites as well.
    """
    keys = [PRIMARY_KEYS[table]] + ([MERGED_KEYS[table]] if merged and table in MERGED_KEYS else [])
    for key in keys:
        found = duplicate_keys(df, key).limit(5).collect()
        if found:
            raise ValueError(f"{table} has duplicate keys {key}, for example {found}")
