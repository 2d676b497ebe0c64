"""Settings and inclusion files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.schemas import TABLES


def read_settings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A settings CSV with a header, read with a known table's schema (or a DDL string).

    Columns are taken in file order, so camel-case headers need no conversion.
    """
    return spark.read.csv(path, schema=TABLES.get(schema, schema), header=True, enforceSchema=True, nullValue="NA")


def inclusion_stats(df: DataFrame, cohort_id: int) -> DataFrame:
    """Rows of one cohort in an inclusion table."""
    return df.where(F.col("cohort_definition_id") == cohort_id)
