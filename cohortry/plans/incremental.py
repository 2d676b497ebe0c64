"""Which parts of a study must run again.

A study is a graph of tasks: cohorts, then the strata of each target, then its
features and its covariates, then the results. A task's checksum is taken over
its own settings and the checksums of the tasks it reads, so a change in one
definition reaches exactly what depends on it. The ledger remembers the checksum
with which each task was finished.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.schemas import TABLES
from cohortry.session import small_table
from cohortry.sources.sinks import pending_tasks, record_tasks
from cohortry.sources.snapshots import Snapshots

COHORT, STRATA, FEATURES, COVARIATES, RESULTS = "cohort", "strata", "features", "covariates", "results"

# The results are one task of the whole study.
WHOLE = 0

# A task: cohort id and kind.
Task = tuple[int, str]


def digest(*parts) -> str:
    return hashlib.md5("\x1f".join(map(repr, parts)).encode()).hexdigest()


def study_tasks(study, database_id: str) -> dict[Task, str]:
    """Checksum of every task of a study, in an order in which they can run."""
    ids = [s.cohort_id for s in (*study.targets, *study.strata_cohorts, *study.features)]
    if len(set(ids)) < len(ids):
        raise ValueError(f"cohorts {sorted({i for i in ids if ids.count(i) > 1})} are defined more than once")
    found: dict[Task, str] = {
        (spec.cohort_id, COHORT): digest(study.data_version, spec)
        for spec in (*study.targets, *study.strata_cohorts, *study.features)
    }

    def cohorts(specs) -> list[str]:
        return [found[spec.cohort_id, COHORT] for spec in specs]

    names = lambda specs: [study.names[s.cohort_id] for s in specs]
    counted = [*study.strata_cohorts, *study.features]
    for target in study.targets:
        i = target.cohort_id
        found[i, STRATA] = digest(found[i, COHORT], study.bulk_strata, cohorts(study.strata_cohorts), study.min_cell)
        found[i, FEATURES] = digest(found[i, STRATA], cohorts(counted), names(counted), study.windows, study.min_subjects)
        found[i, COVARIATES] = digest(found[i, STRATA], study.windows, study.min_subjects, study.sd)
    found[WHOLE, RESULTS] = digest(list(found.items()), study.names, study.min_cell, study.min_subjects, study.exclude_from_export, database_id)
    return found


class Ledger:
    """Finished tasks of a study folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self._table = Snapshots(spark, f"{folder}/ledger", "cohort_id", TABLES["ledger"])

    def read(self) -> DataFrame:
        """All finished tasks; a task that stands there twice stops the run."""
        found = self._table.read()
        twice = found.groupBy("cohort_id", "task").count().where("count > 1").select("cohort_id", "task").take(5)
        if twice:
            raise ValueError(f"the ledger holds tasks more than once: {[tuple(r) for r in twice]}")
        return found

    def _frame(self, tasks: dict[Task, str]) -> DataFrame:
        rows = [(i, kind, checksum) for (i, kind), checksum in tasks.items()]
        return small_table(self.spark, rows, "cohort_id long, task string, checksum string")

    def pending(self, tasks: dict[Task, str]) -> set[Task]:
        """Tasks that were never finished, or with another checksum."""
        return {(r["cohort_id"], r["task"]) for r in pending_tasks(self._frame(tasks), self.read()).collect()}

    def record(self, tasks: dict[Task, str], done: Iterable[Task]) -> None:
        """Enter finished tasks in place of their earlier entries."""
        finished = {task: tasks[task] for task in done}
        if finished:
            rows = record_tasks(self.read(), self._frame(finished)).select("cohort_id", "task", "checksum", F.col("time_stamp").cast("timestamp"))
            self._table.replace(rows, {i for i, _ in finished})
