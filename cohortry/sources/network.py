"""Results of many sites: admission, merge, names and keys in one plan.

A site is admitted if each of its tables has the expected columns and no key
twice. Sites that fail are left out as a whole and listed with the reason; the
others are merged, so one broken delivery neither stops a network's results nor
gets into them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators.results import PRIMARY_KEYS, dedupe_covariates, fix_covariate_names
from cohortry.schemas import TABLES
from cohortry.session import small_table
from cohortry.sources.merge import remap_database

# What a site delivers.
DELIVERED = ("database", "cohort_count", "covariate", "covariate_value")

_QUARANTINE = "site string, table_name string, reason string"


def _columns(table: str) -> list[str]:
    return [column.split()[0] for column in TABLES[table].split(",")]


def merge_chain(spark: SparkSession, sites: Mapping[str, Mapping[str, DataFrame]]) -> dict[str, DataFrame]:
    """Merged tables of all admitted sites, and ``quarantine`` (site, table_name, reason).

    ``sites`` maps a site to its tables. Columns are settled from the schemas, no
    data is read; doubled keys are counted per site in the same plan that merges,
    and what decides is one row per broken site and table. Covariates of all sites
    become one name per id: lower case, ages above 99 spelled out, the first by
    name where sites differ.
    """
    refused, admitted = [], {}
    for site, tables in sites.items():
        wrong = [(site, name, "no such table") for name in DELIVERED if name not in tables]
        for name in DELIVERED:
            if name in tables and set(tables[name].columns) != set(_columns(name)):
                odd = sorted(set(tables[name].columns) ^ set(_columns(name)))
                wrong.append((site, name, f"columns differ: {', '.join(odd)}"))
        refused += wrong
        if not wrong:
            admitted[site] = tables
    together = {name: _union(spark, name, {site: tables[name] for site, tables in admitted.items()}) for name in DELIVERED}
    doubled = None
    for name, table in together.items():
        keys = PRIMARY_KEYS[name]
        part = (
            table.groupBy("_site", *keys).agg(F.count("*").alias("_n")).where("_n > 1").groupBy("_site").agg(F.count("*").alias("_keys"))
            .select(F.col("_site").alias("site"), F.lit(name).alias("table_name"), F.concat(F.col("_keys").cast("string"), F.lit(f" keys ({', '.join(keys)}) stand more than once")).alias("reason"))
        )
        doubled = part if doubled is None else doubled.unionByName(part)
    # One row per site at most: its size is that of the list of sites.
    out = F.broadcast(doubled.select(F.col("site").alias("_site")).distinct())
    merged = {name: remap_database(kept) if "database_id" in kept.columns else kept
              for name, kept in ((name, table.join(out, "_site", "left_anti").drop("_site")) for name, table in together.items())}
    merged["covariate"] = dedupe_covariates(fix_covariate_names(merged["covariate"]))
    merged["quarantine"] = small_table(spark, refused, _QUARANTINE).unionByName(doubled)
    return merged


def _union(spark: SparkSession, name: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    kinds = dict(column.split() for column in TABLES[name].split(","))
    found = small_table(spark, [], TABLES[name]).withColumn("_site", F.lit(None).cast("string"))
    for site, table in tables.items():
        found = found.unionByName(table.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()], F.lit(site).alias("_site")))
    return found
