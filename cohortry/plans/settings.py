"""A study from its settings files."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators.features import windows_from_settings
from cohortry.operators.strata import strata_from_settings
from cohortry.plans.cohort import CohortSpec
from cohortry.plans.study import Study
from cohortry.schemas import TABLES
from cohortry.session import small_table
from cohortry.sources.settings import read_settings

# File names of a settings folder, and the groups that are no targets.
GROUPS, BULK_STRATA, WINDOWS = "CohortGroups.csv", "BulkStrata.csv", "featureTimeWindows.csv"
STRATA, FEATURE = "strata", "feature"


def cohorts_to_create(spark: SparkSession, folder: str, groups: Collection[str] | None = None) -> DataFrame:
    """``cohort_group, name, cohort_id`` of all listed cohorts; of the groups a user may choose, only ``groups`` if given."""
    listed = read_settings(spark, f"{folder}/{GROUPS}", "cohort_groups").collect()
    unknown = set(groups or ()) - {g["cohort_group"] for g in listed}
    if unknown:
        raise ValueError(f"no cohort groups {sorted(unknown)} in {folder}/{GROUPS}")
    found = None
    for group in listed:
        if groups is not None and group["user_can_select"] and group["cohort_group"] not in groups:
            continue
        # Group files are named from the folder above.
        file = group["file_name"].split("/")[-1]
        part = read_settings(spark, f"{folder}/{file}", "cohort_settings").select(F.lit(group["cohort_group"]).alias("cohort_group"), "name", "cohort_id")
        found = part if found is None else found.unionByName(part)
    return small_table(spark, [], "cohort_group string, name string, cohort_id long") if found is None else found


def study_from_settings(spark: SparkSession, folder: str, definitions: Mapping[int, CohortSpec], groups: Collection[str] | None = None,
                        exclude: Collection[int] = (), exclude_from_export: Collection[int] = (), **more) -> Study:
    """The study that a settings folder describes.

    ``definitions`` gives what each cohort id means. ``groups`` chooses among the
    target groups, ``exclude`` leaves cohorts out of the run. An id that is listed
    twice, or has no definition, is an error. ``more`` are further settings of
    ``Study``.
    """
    rows = [r for r in cohorts_to_create(spark, folder, groups).collect() if r["cohort_id"] not in set(exclude)]
    ids = [r["cohort_id"] for r in rows]
    doubled, undefined = sorted({i for i in ids if ids.count(i) > 1}), sorted(set(ids) - set(definitions))
    if doubled or undefined:
        raise ValueError(f"cohorts listed twice: {doubled}; cohorts without a definition: {undefined}")

    def specs(test) -> list[CohortSpec]:
        return [definitions[r["cohort_id"]] for r in rows if test(r["cohort_group"])]

    return Study(
        targets=specs(lambda g: g not in (STRATA, FEATURE)), strata_cohorts=specs(lambda g: g == STRATA), features=specs(lambda g: g == FEATURE),
        bulk_strata=strata_from_settings(read_settings(spark, f"{folder}/{BULK_STRATA}", "bulk_strata").collect()),
        names={r["cohort_id"]: r["name"] for r in rows},
        windows=tuple(windows_from_settings(read_settings(spark, f"{folder}/{WINDOWS}", "feature_windows").collect())),
        exclude_from_export=tuple(exclude_from_export), **more,
    )
