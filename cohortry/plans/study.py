"""The whole study: cohorts, strata, censoring, features, covariates and results."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators.censor import censor_cohorts, cohort_counts, planned_counts, with_min_subjects
from cohortry.operators.covariates import characterize
from cohortry.operators.features import (
    WINDOWS,
    FeatureWindow,
    all_features,
    feature_counts,
    feature_proportions,
    format_features,
)
from cohortry.operators.results import (
    censor_counts,
    cohorts_for_export,
    covariate_list,
    covariate_values,
    enforce_min_cell,
)
from cohortry.operators.strata import Stratum, stratify, stratify_by_cohorts, target_strata_xref
from cohortry.operators.event_store import EventStore
from cohortry.plans.batch import Batch
from cohortry.plans.cohort import CohortSpec, rule_stats, summary_stats
from cohortry.plans.incremental import COHORT, COVARIATES, FEATURES, RESULTS, STRATA, WHOLE, Ledger, Task, study_tasks
from cohortry.schemas import TABLES
from cohortry.session import small_table
from cohortry.sources.cdm import Cdm
from cohortry.sources.merge import database_info
from cohortry.sources.sinks import exclude_cohorts, read_cohorts, write_cohorts, write_results
from cohortry.sources.snapshots import Snapshots
from cohortry.sources.steps import Steps


@dataclass(frozen=True)
class Study:
    """Definitions and names of all cohorts of a study."""

    targets: Sequence[CohortSpec]
    strata_cohorts: Sequence[CohortSpec]
    features: Sequence[CohortSpec]
    bulk_strata: Sequence[Stratum]
    names: dict[int, str]
    windows: Sequence[FeatureWindow] = WINDOWS
    min_cell: int = 5
    min_subjects: int = 140
    sd: str = "bulk"
    exclude_from_export: Sequence[int] = field(default_factory=tuple)
    # Another version of the clinical tables, or of events computed elsewhere: everything runs again.
    data_version: str = ""

    def listed(self, cdm: Cdm, specs: Sequence[CohortSpec], cohort_type: str) -> DataFrame:
        rows = [(self.names[s.cohort_id], s.cohort_id, cohort_type) for s in specs]
        return small_table(cdm.spark, rows, "name string, cohort_id long, cohort_type string")


@dataclass(frozen=True)
class StudyRun:
    """Result tables of a study, and the tasks that this run had to do for them."""

    tables: dict[str, DataFrame]
    ran: tuple[Task, ...]


def run_study(cdm: Cdm, study: Study, folder: str, database_id: str) -> dict[str, DataFrame]:
    """Run a study and write its tables under ``folder``; returns the result tables."""
    return update_study(cdm, study, folder, database_id).tables


# Features and covariates of the cohorts of a target, as they are stored between runs.
_FEATURES = ("target_id long, cohort_id long, covariate_id long, covariate_name string, analysis_id long, mean double, sd double, "
             "feature_cohort_definition_id long, window_id int, total_count long, feature_count long, window_start int, window_end int, "
             "window_type string, feature_name string")
_COVARIATES = "target_id long, cohort_id long, covariate_id long, covariate_name string, analysis_id long, mean double, sd double"


def update_study(cdm: Cdm, study: Study, folder: str, database_id: str) -> StudyRun:
    """Bring the tables of a study under ``folder`` up to date.

    Only tasks whose settings, or those of a task they read, changed since they
    were last finished run again. Every step replaces its rows in a table that
    readers see whole, and is entered in the ledger when they are there: a run
    that breaks off goes on where it stopped. All pending cohorts are built in
    one plan over one reading of each clinical table.
    """
    return _StudyFolder(cdm, study, folder, database_id).update()


class _StudyFolder:
    def __init__(self, cdm: Cdm, study: Study, folder: str, database_id: str):
        self.cdm, self.study, self.folder, self.database_id = cdm, study, folder, database_id
        self.spark = spark = cdm.spark
        self.staging_path, self.cohort_path = f"{folder}/cohort_staging", f"{folder}/cohort"
        self.features = Snapshots(spark, f"{folder}/work/features", "target_id", _FEATURES)
        self.covariates = Snapshots(spark, f"{folder}/work/covariates", "target_id", _COVARIATES)
        self.inclusion = Snapshots(spark, f"{folder}/work/inclusion", "cohort_definition_id", TABLES["cohort_inclusion_result"])
        self.targets = study.listed(cdm, study.targets, "target")
        self.cohort_strata = study.listed(cdm, study.strata_cohorts, "strata")
        self.feature_cohorts = study.listed(cdm, study.features, "feature")
        bulk = small_table(spark, [(s.name, s.strata_id) for s in study.bulk_strata], "name string, cohort_id long")
        self.xref = target_strata_xref(self.targets, bulk, self.cohort_strata)
        # Every cohort of a target: the target itself and its strata.
        own = self.targets.select(F.col("cohort_id").alias("target_id"), "cohort_id")
        self.members = own.unionByName(self.xref.select("target_id", "cohort_id"))

    def update(self) -> StudyRun:
        tasks, ledger = study_tasks(self.study, self.database_id), Ledger(self.spark, self.folder)
        pending = ledger.pending(tasks)
        for kind, step in ((COHORT, self._cohorts), (STRATA, self._strata), (FEATURES, self._features), (COVARIATES, self._covariates), (RESULTS, self._results)):
            ids = [i for i, k in tasks if k == kind and (i, k) in pending]
            if ids:
                step(ids)
                ledger.record(tasks, [(i, kind) for i in ids])
        return StudyRun({name: self.spark.read.parquet(f"{self.folder}/results/{name}") for name in RESULT_TABLES}, tuple(t for t in tasks if t in pending))

    def _chosen(self, df: DataFrame, column: str, ids: Iterable[int]) -> DataFrame:
        listed = small_table(self.spark, [(i,) for i in ids], f"{column} long")
        return df.join(listed, column, "left_semi")

    def _of_targets(self, cohort: DataFrame, ids: Sequence[int]) -> DataFrame:
        members = self._chosen(self.members, "target_id", ids).select(F.col("cohort_id").alias("cohort_definition_id"))
        return cohort.join(F.broadcast(members), "cohort_definition_id", "left_semi")

    def _cohorts(self, ids: Sequence[int]) -> None:
        """All pending definitions side by side, and how many persons meet their inclusion rules."""
        specs = [s for s in (*self.study.targets, *self.study.strata_cohorts, *self.study.features) if s.cohort_id in set(ids)]
        steps, place = Steps(self.spark, f"{self.folder}/work"), f"build-{uuid.uuid4().hex}"
        batch = Batch(EventStore(self.cdm, specs, lambda name, df: steps(f"{place}/{name}", df)))
        write_cohorts(batch.cohorts(), self.staging_path, ids)
        self.inclusion.replace(batch.inclusion(), ids)
        steps.drop(place)

    def _strata(self, ids: Sequence[int]) -> None:
        """Split the pending targets, and copy what is large enough to report."""
        xref = self._chosen(self.xref, "target_id", ids)
        unsplit = [*ids, *[s.cohort_id for s in self.study.strata_cohorts]]
        staging = self._chosen(read_cohorts(self.spark, self.staging_path), "cohort_definition_id", unsplit)
        split = stratify(self.cdm, staging, xref, self.study.bulk_strata)
        if self.study.strata_cohorts:
            by_cohort = xref.join(self.cohort_strata.select(F.col("cohort_id").alias("strata_id")), "strata_id", "left_semi")
            split = split.unionByName(stratify_by_cohorts(staging, by_cohort))
        split_ids = [row.cohort_id for row in xref.select("cohort_id").distinct().collect()]
        write_cohorts(split, self.staging_path, split_ids)
        staged = self._of_targets(read_cohorts(self.spark, self.staging_path), ids)
        write_cohorts(censor_cohorts(staged, xref, self.study.min_cell), self.cohort_path, [*ids, *split_ids])

    def _counts(self) -> DataFrame:
        return censor_counts(cohort_counts(read_cohorts(self.spark, self.cohort_path)), self.study.min_cell)

    def _features(self, ids: Sequence[int]) -> None:
        study = self.study
        cohort = self._of_targets(read_cohorts(self.spark, self.cohort_path), ids)
        counted = [s.cohort_id for s in (*study.strata_cohorts, *study.features)]
        windows = small_table(self.spark, study.windows, TABLES["feature_windows"])
        counts = feature_counts(cohort, read_cohorts(self.spark, self.staging_path), study.windows, counted)
        named = format_features(feature_proportions(cohort, counts), windows, all_features(self.cohort_strata, self.feature_cohorts))
        large = named.where(F.col("total_count") >= study.min_subjects)
        self.features.replace(large.join(F.broadcast(self.members), "cohort_id"), ids)

    def _covariates(self, ids: Sequence[int]) -> None:
        cohort = self._of_targets(read_cohorts(self.spark, self.cohort_path), ids)
        large = with_min_subjects(cohort_counts(cohort), self.study.min_subjects).select(F.col("cohort_id").alias("cohort_definition_id"))
        # At most as many ids as the study has cohorts. Each kind of covariate reads the rows several times.
        described = self._stored("work/described", cohort.join(F.broadcast(large), "cohort_definition_id", "left_semi"))
        found = characterize(self.cdm, described, self.study.windows, sd=self.study.sd).withColumn("analysis_id", F.col("analysis_id").cast("long"))
        self.covariates.replace(found.join(F.broadcast(self.members), "cohort_id"), ids)

    def _stored(self, part: str, table: DataFrame) -> DataFrame:
        write_results(table, f"{self.folder}/{part}", "parquet")
        return self.spark.read.parquet(f"{self.folder}/{part}")

    def _results(self, _: Sequence[int]) -> None:
        """All result tables, from what the other steps stored."""
        study, spark = self.study, self.spark
        listed = self.targets.unionByName(self.cohort_strata).unionByName(self.feature_cohorts)
        planned = listed.select("name", "cohort_id").unionByName(self.xref.select("name", "cohort_id"))
        staging_counts = planned_counts(planned, censor_counts(cohort_counts(read_cohorts(spark, self.staging_path)), study.min_cell))
        # Rows of cohorts that are no longer part of the study stay in its tables but out of its results.
        counts = self._stored("work/cohort_count", self._counts().join(F.broadcast(self.members.select("cohort_id").distinct()), "cohort_id", "left_semi"))
        target_ids = [s.cohort_id for s in study.targets]
        features = self._chosen(self.features.read(), "target_id", target_ids)
        covariates = self._chosen(self.covariates.read(), "target_id", target_ids)
        columns = ["cohort_id", "covariate_id", "covariate_name", "analysis_id", "mean", "sd"]
        everything = features.select(*columns).unionByName(covariates.select(*columns))
        ruled = [(s.cohort_id, k, f"rule {k + 1}", "") for s in (*study.targets, *study.strata_cohorts, *study.features) for k in range(len(s.inclusion_rules))]
        inclusion = self._chosen(self.inclusion.read(), "cohort_definition_id", {r[0] for r in ruled})
        sizes = small_table(spark, list(Counter(r[0] for r in ruled).items()), "cohort_definition_id long, rules int")
        sized, rules = inclusion.join(sizes, "cohort_definition_id"), F.col("rules")
        results = {
            "database": database_info(self.cdm, self.database_id),
            "cohort": cohorts_for_export(listed, self.xref, counts),
            "cohort_staging_count": staging_counts.withColumn(
                "database_id", F.when(F.col("cohort_entries").isNotNull(), F.lit(self.database_id))
            ),
            "cohort_count": counts.withColumn("database_id", F.lit(self.database_id)),
            "feature_proportions": enforce_min_cell(features.drop("target_id"), "feature_count", study.min_cell),
            "covariate": covariate_list(everything),
            "covariate_value": covariate_values(everything, counts, study.min_cell, self.database_id).distinct(),
            "cohort_inclusion": small_table(spark, ruled, TABLES["cohort_inclusion"]),
            "cohort_inclusion_result": inclusion,
            "cohort_inclusion_stats": rule_stats(sized, rules).select(*_names("cohort_inclusion_stats")),
            "cohort_summary_stats": summary_stats(sized, rules).select(*_names("cohort_summary_stats")),
        }
        if study.exclude_from_export:
            for name in ("covariate_value", "cohort_count"):
                results[name] = exclude_cohorts(results[name], study.exclude_from_export)
        for name in RESULT_TABLES:
            self._stored(f"results/{name}", results[name])


RESULT_TABLES = (
    "database", "cohort", "cohort_staging_count", "cohort_count", "feature_proportions", "covariate", "covariate_value",
    "cohort_inclusion", "cohort_inclusion_result", "cohort_inclusion_stats", "cohort_summary_stats",
)


def _names(table: str) -> list[str]:
    return [column.split()[0] for column in TABLES[table].split(",")]
