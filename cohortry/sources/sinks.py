"""Writing cohorts and results, again or for the first time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.schemas import TABLES
from cohortry.sources.snapshots import Snapshots


def _cohorts(spark: SparkSession, path: str) -> Snapshots:
    return Snapshots(spark, path, "cohort_definition_id", TABLES["cohort"])


def write_cohorts(df: DataFrame, path: str, cohort_ids: Sequence[int]) -> None:
    """Replace the rows of the given cohorts in the cohort table, and no others.

    A cohort that came out empty is empty afterwards. Readers see the table as it
    was before or after, never between.
    """
    _cohorts(df.sparkSession, path).replace(df, cohort_ids)


def write_cohort_table(df: DataFrame, path: str) -> None:
    """Write a whole cohort table anew."""
    _cohorts(df.sparkSession, path).overwrite(df)


def write_cohort(df: DataFrame, path: str, cohort_id: int) -> None:
    write_cohorts(df, path, [cohort_id])


def read_cohorts(spark: SparkSession, path: str) -> DataFrame:
    """The cohort table; empty if nothing was written yet."""
    return _cohorts(spark, path).read()


def write_results(df: DataFrame, path: str, format: str = "csv") -> None:
    """Write a result table; the number of files is left to Spark."""
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if format == "csv" else writer.parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows without those whose key is in ``new``, followed by ``new``."""
    kept = old.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def checksum(definition: Column | str) -> Column:
    """MD5 of a cohort definition's text."""
    return F.md5(F.lit(definition) if isinstance(definition, str) else definition)


def pending_tasks(tasks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Tasks the ledger does not hold with the same checksum."""
    return tasks.join(ledger, ["cohort_id", "task", "checksum"], "left_anti")


def record_tasks(ledger: DataFrame, done: DataFrame) -> DataFrame:
    """Ledger in which the finished tasks replace their earlier entries."""
    return upsert(ledger, done.withColumn("time_stamp", F.current_timestamp()), ["cohort_id", "task"])


def exclude_cohorts(df: DataFrame, cohort_ids: Sequence[int]) -> DataFrame:
    """Result rows without some cohorts."""
    return df.where(~F.col("cohort_id").isin(*cohort_ids))
