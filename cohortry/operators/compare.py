"""Questions asked of the merged results: counts, characteristics, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Analysis ids behind the domain filter.
DOMAINS = {
    "All": (1, 10000),
    "Cohort": (10000, 10000),
    "Demographics": (1, 99),
    "Drug": (412, 412),
    "Condition": (212, 212),
}


def values_of(values: DataFrame, cohort_ids: Sequence[int], database_ids: Sequence[str]) -> DataFrame:
    """Covariate values of a cohort (and a comparator) in the chosen databases."""
    return values.where(F.col("cohort_id").isin(*cohort_ids) & F.col("database_id").isin(*database_ids))


def filter_covariates(covariates: DataFrame, window_ids: Sequence[int], domain: str = "All") -> DataFrame:
    """Covariates of some time windows and one domain."""
    low, high = DOMAINS[domain]
    return covariates.where(
        F.col("time_window_id").isin(*window_ids) & F.col("covariate_analysis_id").between(low, high)
    ).select("covariate_id", "covariate_name", "covariate_analysis_id", "time_window_id")


def cohort_count_table(counts: DataFrame, xref: DataFrame, cohort_ids: Sequence[int] | None = None,
                       database_ids: Sequence[str] | None = None) -> DataFrame:
    """Counts with target and stratum names, ordered by target."""
    if cohort_ids is not None:
        counts = counts.where(F.col("cohort_id").isin(*cohort_ids))
    if database_ids is not None:
        counts = counts.where(F.col("database_id").isin(*database_ids))
    return xref.join(counts, "cohort_id").orderBy("target_name")


def pivot_by_database(df: DataFrame, keys: Sequence[str], value: str, database_ids: Sequence[str]) -> DataFrame:
    """One column ``<value>_<database>`` per database."""
    columns = [
        F.max(F.when(F.col("database_id") == one, F.col(value))).alias(f"{value}_{one}") for one in database_ids
    ]
    return df.where(F.col("database_id").isin(*database_ids)).groupBy(*keys).agg(*columns)


def counts_by_database(counts: DataFrame, xref: DataFrame, database_ids: Sequence[str]) -> DataFrame:
    keys = ["cohort_id", "target_id", "target_name", "strata_id", "strata_name", "cohort_type"]
    return pivot_by_database(xref.join(counts, "cohort_id"), keys, "cohort_subjects", database_ids)


def characterization(values: DataFrame, covariates: DataFrame, cohort_id: int, cohort_name: str,
                     database_ids: Sequence[str]) -> DataFrame:
    """Values of one cohort for the filtered covariates."""
    chosen = values_of(values, [cohort_id], database_ids)
    return chosen.join(covariates, "covariate_id").select(
        "cohort_id",
        F.lit(cohort_name).alias("cohort_name"),
        "covariate_id",
        "covariate_name",
        "covariate_analysis_id",
        "time_window_id",
        "database_id",
        "mean",
    )


def characterization_by_database(table: DataFrame, counts: DataFrame, database_ids: Sequence[str]) -> DataFrame:
    """Means side by side for the databases that report counts of the cohort, by covariate name."""
    counted = counts.select("cohort_id", "database_id").distinct()
    keys = ["cohort_id", "cohort_name", "covariate_id", "covariate_name", "covariate_analysis_id", "time_window_id"]
    with_counts = table.join(counted, ["cohort_id", "database_id"], "left_semi")
    return pivot_by_database(with_counts, keys, "mean", database_ids).orderBy("covariate_name")


def compare_cohorts(values: DataFrame, covariates: DataFrame, target_id: int, comparator_id: int,
                    database_id: str) -> DataFrame:
    """Standardised difference of every covariate between two cohorts, largest first.

    A covariate known for one side only has no difference.
    """
    def side(cohort_id: int, mean: str, sd: str) -> DataFrame:
        mine = values.where((F.col("cohort_id") == cohort_id) & (F.col("database_id") == database_id))
        return mine.select("covariate_id", F.col("mean").alias(mean), F.col("sd").alias(sd))

    sd = F.sqrt(F.col("target_sd") * F.col("target_sd") + F.col("comparator_sd") * F.col("comparator_sd"))
    difference = F.try_divide(F.col("comparator_mean") - F.col("target_mean"), F.col("sd"))
    return (
        side(target_id, "target_mean", "target_sd")
        .join(side(comparator_id, "comparator_mean", "comparator_sd"), "covariate_id", "full_outer")
        .join(covariates, "covariate_id")
        .withColumn("sd", sd)
        .withColumn("std_diff", difference)
        .withColumn("abs_std_diff", F.abs("std_diff"))
        .orderBy(F.col("abs_std_diff").desc_nulls_last(), "covariate_id")
    )


def characterized_cohorts(counts: DataFrame, xref: DataFrame, min_subjects: int | Column = 140) -> DataFrame:
    """Cross-reference rows of cohorts large enough in at least one database."""
    large = counts.where(F.col("cohort_subjects") >= min_subjects).select("cohort_id")
    return xref.join(large, "cohort_id", "left_semi")


def target_list(xref: DataFrame) -> DataFrame:
    return xref.select("target_id", "target_name").distinct().orderBy("target_name")


def strata_list(xref: DataFrame) -> DataFrame:
    return xref.select("strata_id", "strata_name").distinct().orderBy("strata_id")


def databases_with_terms(database: DataFrame, terms: DataFrame) -> DataFrame:
    return database.join(terms, "database_id", "left").orderBy("database_id")


def strata_types(xref: DataFrame) -> DataFrame:
    """Strata and the kinds of cohorts that exist for them."""
    return xref.select("strata_id", "strata_name", "cohort_type").distinct().orderBy("strata_id", "cohort_type")


def cohorts_of_stratum(xref: DataFrame, strata_id: int, cohort_type: str) -> DataFrame:
    return xref.where((F.col("strata_id") == strata_id) & (F.col("cohort_type") == cohort_type))


def counts_of_stratum(xref: DataFrame, counts: DataFrame, strata_id: int, cohort_type: str) -> DataFrame:
    return cohorts_of_stratum(xref, strata_id, cohort_type).join(counts, "cohort_id")


def values_of_stratum(xref: DataFrame, values: DataFrame, strata_id: int, cohort_type: str,
                      min_mean: float = 0.01) -> DataFrame:
    return cohorts_of_stratum(xref, strata_id, cohort_type).join(values.where(F.col("mean") > min_mean), "cohort_id")


def peek(df: DataFrame, rows: int, order: Sequence[str] = ()) -> DataFrame:
    """The first rows of a table; none for 0."""
    return (df.orderBy(*order) if order else df).limit(rows)


def definition_links(cohorts: DataFrame, tool_url: str, script_url: str) -> DataFrame:
    """Where the definition of each cohort can be read, by the kind of definition."""
    url: Column = F.when(
        F.col("from_tool"), F.concat(F.lit(tool_url), F.col("tool_id").cast("string"))
    ).otherwise(F.concat(F.lit(script_url), F.col("cohort_id").cast("string"), F.lit(".sql")))
    return cohorts.select("name", url.alias("url")).orderBy("name")
