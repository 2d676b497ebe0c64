"""Bringing the results of many databases together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.sources.cdm import Cdm


def database_info(cdm: Cdm, database_id: str, name: str | None = None, description: str = "") -> DataFrame:
    """The database's row in the results, with the version of its vocabulary."""
    return cdm["vocabulary"].where(F.col("vocabulary_id") == "None").select(
        F.lit(database_id).alias("database_id"),
        F.lit(name or database_id).alias("database_name"),
        F.lit(description).alias("description"),
        "vocabulary_version",
        F.lit(0).alias("is_meta_analysis"),
    )


# Columns whose type is settled in a lenient merge.
INTEGER_COLUMNS = (
    "cohort_id", "cohort_entries", "cohort_subjects", "concept_set_id", "concept_id", "source_concept_id",
    "concept_subjects", "concept_count",
)
TEXT_COLUMNS = ("concept_code",)


def merge_sites(tables: Sequence[DataFrame], strict: bool = True) -> DataFrame:
    """One result table of many sites.

    ``strict`` asks for the same columns everywhere. Otherwise the first table
    decides: later tables lose columns it lacks and get NULL for those they lack.
    """
    first = tables[0]
    merged = first if strict else _settle_types(first)
    for table in tables[1:]:
        if strict:
            if set(table.columns) != set(first.columns):
                raise ValueError(f"columns differ: {sorted(table.columns)} and {sorted(first.columns)}")
            merged = merged.unionByName(table)
        else:
            common = [c for c in first.columns if c in table.columns]
            merged = merged.unionByName(_settle_types(table.select(*common)), allowMissingColumns=True)
    return merged


def _settle_types(df: DataFrame) -> DataFrame:
    types = {**dict.fromkeys(INTEGER_COLUMNS, "long"), **dict.fromkeys(TEXT_COLUMNS, "string")}
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in df.columns})


# Fixed value: a site known under an older id.
RENAMED_DATABASES = {"deid_lite": "STARR-OMOP"}


def remap_database(df: DataFrame, mapping: Mapping[str, str] = RENAMED_DATABASES) -> DataFrame:
    """Replace database ids, whatever their case."""
    renamed = F.col("database_id")
    for old, new in mapping.items():
        renamed = F.when(F.lower("database_id") == old.lower(), F.lit(new)).otherwise(renamed)
    return df.withColumn("database_id", renamed)
