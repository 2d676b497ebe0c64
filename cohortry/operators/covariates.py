"""Demographic, drug and condition covariates of cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.expressions import age_at, bulk_sd, proportion, sequential_sd, truncate_name
from cohortry.operators.features import FeatureWindow, subjects_per_fact
from cohortry.operators.vocabulary import condition_groups, drug_groups
from cohortry.session import BROADCAST_ROWS, small_table
from cohortry.sources.cdm import Cdm

# Analysis ids.
GENDER, AGE_GROUP, CONDITION_GROUP, DRUG_GROUP = 1, 3, 212, 412


def restrict(cohort: DataFrame, cohort_ids: Sequence[int] | None) -> DataFrame:
    return cohort if cohort_ids is None else cohort.where(F.col("cohort_definition_id").isin(*cohort_ids))


def cohort_totals(cohort: DataFrame) -> DataFrame:
    return cohort.groupBy("cohort_definition_id").agg(F.count_distinct("subject_id").alias("total_count"))


def age_group_covariates(cdm: Cdm, cohort: DataFrame) -> DataFrame:
    """Subjects per five-year age group at the cohort start."""
    age = age_at(F.col("cohort_start_date"), F.col("year_of_birth"))
    return _demographic(cdm, cohort, F.floor(age / 5), AGE_GROUP)


def gender_covariates(cdm: Cdm, cohort: DataFrame) -> DataFrame:
    """Subjects per gender concept; concept 0 is not counted."""
    known = F.when(F.col("gender_concept_id") != 0, F.col("gender_concept_id"))
    return _demographic(cdm, cohort, known, GENDER).where(F.col("covariate_id").isNotNull())


def _demographic(cdm: Cdm, cohort: DataFrame, value, analysis: int) -> DataFrame:
    person = cdm["person"].select(F.col("person_id").alias("subject_id"), "year_of_birth", "gender_concept_id")
    return (
        cohort.join(person, "subject_id")
        .groupBy("cohort_definition_id", (value.cast("long") * 1000 + analysis).alias("covariate_id"))
        .agg(F.count_distinct("subject_id").alias("sum_value"))
        .select("cohort_definition_id", F.lit(1).alias("window_id"), "covariate_id", "sum_value")
    )


def drug_group_covariates(cdm: Cdm, cohort: DataFrame, windows: Sequence[FeatureWindow]) -> DataFrame:
    """Subjects per drug group with an era that touches the window."""
    eras = cdm["drug_era"].select(
        F.col("person_id").alias("subject_id"), F.col("drug_concept_id").alias("fact_id"),
        F.col("drug_era_start_date").alias("fact_start"), F.col("drug_era_end_date").alias("fact_end"),
    )
    return _group_covariates(cohort, eras, drug_groups(cdm), windows, DRUG_GROUP)


def condition_group_covariates(cdm: Cdm, cohort: DataFrame, windows: Sequence[FeatureWindow]) -> DataFrame:
    """Subjects per condition group with an era that touches the window."""
    eras = cdm["condition_era"].select(
        F.col("person_id").alias("subject_id"), F.col("condition_concept_id").alias("fact_id"),
        F.col("condition_era_start_date").alias("fact_start"), F.col("condition_era_end_date").alias("fact_end"),
    )
    return _group_covariates(cohort, eras, condition_groups(cdm), windows, CONDITION_GROUP)


def _group_covariates(cohort, eras, groups, windows, analysis: int) -> DataFrame:
    touching = [w._replace(kind="overlap") for w in windows]
    above = groups.groupBy("descendant_concept_id").agg(F.collect_set("ancestor_concept_id").alias("groups"))
    # A row takes about six longs besides its groups.
    longs = above.agg(F.sum(F.size("groups") + 6)).first()[0] or 0
    listed = F.broadcast(above) if longs <= 6 * BROADCAST_ROWS else above

    def grouped(met: DataFrame) -> DataFrame:
        held = met.join(listed, F.col("fact_id") == F.col("descendant_concept_id"))
        return held.select("subject_id", "_word", F.explode("groups").alias("fact_id"), "met")

    return subjects_per_fact(cohort, eras, touching, grouped).select(
        "cohort_definition_id",
        "window_id",
        (F.col("fact_id").cast("long") * 1000 + analysis).alias("covariate_id"),
        "sum_value",
    )


def covariate_counts(cdm: Cdm, cohort: DataFrame, windows: Sequence[FeatureWindow],
                     demographics: bool = True) -> DataFrame:
    """All covariates with their subject counts, before ids carry the window."""
    parts = [drug_group_covariates(cdm, cohort, windows), condition_group_covariates(cdm, cohort, windows)]
    if demographics:
        parts += [age_group_covariates(cdm, cohort), gender_covariates(cdm, cohort)]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return together.distinct()


def _two_digits(number: Column) -> Column:
    return F.right(F.concat(F.lit("00"), number.cast("string")), F.lit(2))


def covariate_ref(cdm: Cdm, counts: DataFrame, windows: Sequence[FeatureWindow]) -> DataFrame:
    """Name, analysis and concept of each covariate that occurs in ``counts``."""
    found = counts.select((F.col("covariate_id") * 10 + F.col("window_id")).alias("covariate_id")).distinct()
    return with_names(cdm, found, windows).select("covariate_id", "covariate_name", "analysis_id", "concept_id")


def with_names(cdm: Cdm, rows: DataFrame, windows: Sequence[FeatureWindow]) -> DataFrame:
    """Add name, analysis and concept to rows with a ``covariate_id``, which holds all that a name is made of."""
    window = small_table(
        cdm.spark, [w[:3] for w in windows], "window_id int, window_start int, window_end int"
    )
    known = F.floor(F.col("covariate_id") / 10).cast("long")
    found = (
        rows.withColumns({
            "window_id": F.pmod("covariate_id", F.lit(10)).cast("int"),
            "analysis_id": F.pmod(known, F.lit(1000)).cast("int"),
            "value": F.floor(known / 1000).cast("long"),
        })
        .join(window, "window_id", "left")
        .withColumn("concept_id", F.when(F.col("analysis_id") == AGE_GROUP, 0).otherwise(F.col("value")).cast("long"))
    )
    concept = cdm["concept"].select(F.col("concept_id").alias("_id"), "concept_name")
    label = F.coalesce("concept_name", F.lit("Unknown concept"))
    in_window = F.concat(
        F.lit(" group during day "), F.col("window_start").cast("string"), F.lit(" through "),
        F.col("window_end").cast("string"), F.lit(" days relative to index: "), label,
    )
    name = (
        F.when(
            F.col("analysis_id") == AGE_GROUP,
            F.concat(F.lit("age group: "), _two_digits(F.col("value") * 5), F.lit("-"),
                     _two_digits(F.col("value") * 5 + 4)),
        )
        .when(F.col("analysis_id") == GENDER, F.concat(F.lit("gender = "), label))
        .when(F.col("analysis_id") == DRUG_GROUP, F.concat(F.lit("drug_era"), in_window))
        .otherwise(F.concat(F.lit("condition_era"), in_window))
    )
    named = found.join(concept, F.col("concept_id") == F.col("_id"), "left")
    return named.withColumn("covariate_name", truncate_name(name)).select(
        *rows.columns, "covariate_name", "analysis_id", "concept_id")


def analysis_results(cohort: DataFrame, counts: DataFrame, sd: str = "bulk") -> DataFrame:
    """Mean and standard deviation of every covariate of every cohort.

    ``sd="sequential"`` takes the formula of the one-cohort-at-a-time form.
    """
    spread = {"bulk": bulk_sd, "sequential": sequential_sd}[sd]
    value, n = F.col("sum_value"), F.col("total_count")
    return counts.join(cohort_totals(cohort), "cohort_definition_id").select(
        F.col("cohort_definition_id").alias("cohort_id"),
        (F.col("covariate_id") * 10 + F.col("window_id")).alias("covariate_id"),
        "sum_value",
        proportion(value, n).alias("mean"),
        spread(value, n).alias("sd"),
    )


def characterize(cdm: Cdm, cohort: DataFrame, windows: Sequence[FeatureWindow],
                 cohort_ids: Sequence[int] | None = None, sd: str = "sequential") -> DataFrame:
    """Covariate results for some cohorts and windows; demographics come with window 1 only."""
    cohort = restrict(cohort, cohort_ids)
    counts = covariate_counts(cdm, cohort, windows, demographics=any(w.window_id == 1 for w in windows))
    return with_names(cdm, analysis_results(cohort, counts, sd), windows)
