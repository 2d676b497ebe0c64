"""Checks on cohorts before a study is run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.expressions import age_at
from cohortry.operators.events import DOMAINS, Events, events
from cohortry.operators.vocabulary import Codesets
from cohortry.session import small_table
from cohortry.sources.cdm import Cdm

DAYS_PER_YEAR = 365.25


def incidence_rate(cdm: Cdm, cohort: DataFrame) -> DataFrame:
    """Cohort starts per 1000 person-years by calendar year, gender and ten-year age group.

    Every cohort of ``cohort`` has a row for each group that was observed, with
    a rate of 0 where nobody started.
    """
    person = cdm["person"].select("person_id", "year_of_birth", "gender_concept_id")
    period = cdm["observation_period"].select(
        "person_id", F.col("observation_period_start_date").alias("_from"),
        F.col("observation_period_end_date").alias("_to"),
    )
    strata = ["calendar_year", "gender_concept_id", "age_group"]
    years = period.withColumn("calendar_year", F.explode(F.sequence(F.year("_from"), F.year("_to"))))
    days = F.date_diff(
        F.least("_to", F.make_date("calendar_year", F.lit(12), F.lit(31))),
        F.greatest("_from", F.make_date("calendar_year", F.lit(1), F.lit(1))),
    ) + 1
    decade = F.floor((F.col("calendar_year") - F.col("year_of_birth")) / 10)
    exposed = (
        years.join(person, "person_id")
        .withColumn("age_group", decade)
        .groupBy(*strata)
        .agg(F.sum(days).cast("long").alias("person_days"))
    )
    started = (
        cohort.withColumnRenamed("subject_id", "person_id")
        .join(period, "person_id")
        .where(F.col("cohort_start_date").between(F.col("_from"), F.col("_to")))
        .join(person, "person_id")
        .withColumn("calendar_year", F.year("cohort_start_date"))
        .withColumn("age_group", F.floor(age_at(F.col("cohort_start_date"), F.col("year_of_birth")) / 10))
        .groupBy("cohort_definition_id", *strata)
        .agg(F.count("*").alias("cohort_count"))
    )
    rate = F.col("cohort_count") * 1000 / (F.col("person_days") / DAYS_PER_YEAR)
    cohorts = cohort.select("cohort_definition_id").distinct().agg(F.collect_set("cohort_definition_id").alias("_ids"))
    cells = exposed.withColumn("cohort_definition_id", F.explode(cohorts.scalar()))
    return (
        cells.join(started, ["cohort_definition_id", *strata], "left")
        .withColumn("cohort_count", F.coalesce("cohort_count", F.lit(0).cast("long")))
        .withColumn("incidence_rate", rate)
    )


def time_distributions(cdm: Cdm, cohort: DataFrame) -> DataFrame:
    """Spread of the observed days before, after and within the cohort."""
    period = cdm["observation_period"].select(
        F.col("person_id").alias("subject_id"), F.col("observation_period_start_date").alias("_from"),
        F.col("observation_period_end_date").alias("_to"),
    )
    seen = cohort.join(period, "subject_id").where(F.col("cohort_start_date").between(F.col("_from"), F.col("_to")))
    measures = {
        "days before index": F.date_diff("cohort_start_date", "_from"),
        "days after index": F.date_diff("_to", "cohort_start_date"),
        "days in cohort": F.date_diff("cohort_end_date", "cohort_start_date"),
    }
    long = seen.select(
        "cohort_definition_id",
        F.explode(F.array(*[F.struct(F.lit(name).alias("time_metric"), days.alias("days"))
                            for name, days in measures.items()])).alias("m"),
    ).select("cohort_definition_id", "m.*")
    quantiles = {"min": 0.0, "p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "max": 1.0}
    return long.groupBy("cohort_definition_id", "time_metric").agg(
        F.count("*").alias("n"),
        F.avg("days").alias("average"),
        *[F.percentile("days", q).alias(f"{name}_days") for name, q in quantiles.items()],
    )


def index_event_breakdown(cdm: Cdm, codes: Codesets | None, cohort: DataFrame, queries: Sequence[Events]) -> DataFrame:
    """Which concepts of the primary events occurred on the index date."""
    found = None
    for query in queries:
        part = events(cdm, query, codes).select(
            F.col("person_id").alias("subject_id"), F.col("start_date").alias("cohort_start_date"),
            F.col("target_concept_id").alias("concept_id"), F.lit(query.domain).alias("domain"),
        )
        found = part if found is None else found.unionByName(part)
    return (
        cohort.join(found, ["subject_id", "cohort_start_date"])
        .groupBy("cohort_definition_id", "domain", "concept_id")
        .agg(F.count("*").alias("concept_count"), F.count_distinct("subject_id").alias("concept_subjects"))
    )


def included_source_concepts(cdm: Cdm, codeset: DataFrame, domain: str) -> DataFrame:
    """Source codes behind the records that a codeset selects."""
    where = DOMAINS[domain]
    raw = cdm[where.table]
    return (
        raw.join(codeset, raw[where.concept] == codeset["concept_id"], "left_semi")
        .groupBy(F.col(where.concept).alias("concept_id"), F.col(where.source_concept).alias("source_concept_id"))
        .agg(F.count("*").alias("concept_count"), F.count_distinct("person_id").alias("concept_subjects"))
    )


# Characters of the pieces of names that are looked up.
GRAM = 3


def _grams(text, length: int):
    """The different pieces of so many characters of a text."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - length + 1, F.lit(1)))
    return F.array_distinct(F.filter(F.transform(places, lambda i: F.substr(text, i, F.lit(length))), lambda g: F.length(g) == length))


def names_with_terms(names: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Rows of ``names(concept_id, concept_name)`` whose name holds one of the terms, whatever its case.

    A name that holds a term holds all the term's pieces of GRAM characters (of
    fewer where the term is shorter). Each term is looked up by its rarest piece
    in an inverted index of the names, and only the names found there are
    searched; thousands of terms so read the names once and not once each. A
    missing name holds nothing, the empty term is in every name.
    """
    wanted = sorted({t.lower() for t in terms})
    named = names.where(F.col("concept_name").isNotNull()).withColumn("_name", F.lower("concept_name"))
    if "" in wanted or not wanted:
        return named.drop("_name") if wanted else named.drop("_name").limit(0)
    lengths = sorted({min(GRAM, len(t)) for t in wanted})
    listed = small_table(names.sparkSession, [(t, min(GRAM, len(t))) for t in wanted], "term string, size int")
    index = asked = None
    for length in lengths:
        held = named.select("concept_id", "_name", F.explode(_grams(F.col("_name"), length)).alias("gram"))
        parts = listed.where(F.col("size") == length).withColumn("gram", F.explode(_grams(F.col("term"), length)))
        index, asked = (held, parts) if index is None else (index.unionByName(held), asked.unionByName(parts))
    # How often the pieces of the terms occur: pieces that no term has are not counted.
    counts = index.join(F.broadcast(asked.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    known = asked.join(counts, "gram", "left").select("term", "gram", F.coalesce("n", F.lit(0)).alias("n"))
    rarest = known.groupBy("term").agg(F.min(F.struct("n", "gram")).alias("least")).where("least.n > 0").select("term", "least.gram")
    # As many rows as there are terms, a settings list.
    found = index.join(F.broadcast(rarest), "gram").where(F.col("_name").contains(F.col("term"))).select("concept_id").distinct()
    return named.drop("_name").join(found, "concept_id", "left_semi")


def orphan_concepts(cdm: Cdm, codeset: DataFrame, terms: Sequence[str], domain: str) -> DataFrame:
    """Concepts outside a codeset that are in use and whose name holds one of its search terms."""
    where = DOMAINS[domain]
    used = cdm[where.table].groupBy(F.col(where.concept).alias("concept_id")).agg(
        F.count("*").alias("concept_count"), F.count_distinct("person_id").alias("concept_subjects")
    )
    return (
        names_with_terms(cdm["concept"].select("concept_id", "concept_name"), terms)
        .join(codeset, "concept_id", "left_anti")
        .join(used, "concept_id")
    )
