"""Feature cohorts in time windows around the index date."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortry.functions.expressions import bulk_sd, proportion
from cohortry.operators.intervals import overlap_join


class FeatureWindow(NamedTuple):
    """Days ``start`` to ``end`` from the index date.

    ``overlap`` asks that the feature touch the window, ``start`` that it begin
    in it.
    """

    window_id: int
    start: int
    end: int
    kind: str


# The windows of the study.
WINDOWS = (
    FeatureWindow(1, -365, -1, "overlap"),
    FeatureWindow(2, -30, -1, "overlap"),
    FeatureWindow(3, 0, 0, "start"),
    FeatureWindow(4, 0, 30, "start"),
)

FEATURE_ANALYSIS = 10000


def windows_from_settings(rows: Sequence) -> list[FeatureWindow]:
    return [FeatureWindow(r["window_id"], r["window_start"], r["window_end"], r["window_type"]) for r in rows]


# So many bits of one long are used, for windows and cohorts.
_WORD = 62


def facts_in_windows(cohort: DataFrame, facts: DataFrame, windows: Sequence[FeatureWindow]) -> DataFrame:
    """``(subject_id, cohort_start_date, window_id, fact_id)`` of the facts that match.

    ``facts`` has ``subject_id, fact_id, fact_start, fact_end``. A fact id with
    several intervals may repeat.
    """
    dates = cohort.select("subject_id", "cohort_start_date").distinct().withColumns({"_word": F.lit(0), "_cohorts": F.lit(1).cast("long")})
    return _union([
        facts_met(dates, cohort, facts, windows, ids).select(
            "subject_id", "cohort_start_date", "fact_id", F.explode(F.array_compact(F.array(*[
                F.when(_has(k), F.lit(i)) for k, i in enumerate(ids)
            ]))).alias("window_id"))
        for ids in window_words(windows)
    ])


def window_words(windows: Sequence[FeatureWindow]) -> list[list[int]]:
    """Distinct ids of some windows, as many at a time as one long has room for."""
    ids = list(dict.fromkeys(w.window_id for w in windows))
    return [ids[k:k + _WORD] for k in range(0, len(ids), _WORD)]


def cohort_bits(cohort: DataFrame, ids: Sequence[int]) -> DataFrame:
    """``(cohort_definition_id, _word, _bit)``: a place for each cohort, as many to a word as fit with so many windows.

    One row per cohort of a study.
    """
    place = F.row_number().over(W.orderBy("cohort_definition_id")) - 1
    per = _per_word(ids)
    return cohort.select("cohort_definition_id").distinct().select(
        "cohort_definition_id", F.floor(place / per).cast("int").alias("_word"), (place % per).cast("int").alias("_bit"))


def index_dates(cohort: DataFrame, places: DataFrame) -> DataFrame:
    """``(subject_id, cohort_start_date, _word, _cohorts)``: the cohorts that share an index date, as bits."""
    place = places.withColumnRenamed("cohort_definition_id", "_id")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))
    return (
        cohort.join(F.broadcast(place), F.col("cohort_definition_id").eqNullSafe(F.col("_id")))
        .groupBy("subject_id", "cohort_start_date", "_word")
        .agg(F.bit_or(bit).alias("_cohorts"))
    )


def facts_met(dates: DataFrame, cohort: DataFrame, facts: DataFrame, windows: Sequence[FeatureWindow], ids: Sequence[int],
              per: int = 1) -> DataFrame:
    """``(subject_id, cohort_start_date, fact_id, _word, met)``: the bits of ``_cohorts``, ``k * per`` places up, where a window with the ``k``-th id matches.

    Cohorts share most of their index dates, so each date of a subject is looked at
    once for all cohorts of a word, with all windows at a time. ``dates`` are those of ``cohort``.
    """
    start = F.col("cohort_start_date")
    span = {
        "_from": F.date_add(start, min(w.start for w in windows)),
        "_to": F.date_add(start, max(w.end for w in windows)),
    }
    # A window may look at the start alone, or be touched by an interval stored backwards: the slices
    # of a fact run between its two days, whichever they are.
    last = F.coalesce("fact_end", "fact_start")
    spanned = facts.withColumns({"_low": F.least("fact_start", last), "_high": F.greatest("fact_start", last)})
    pairs = overlap_join(dates.withColumns(span), spanned, ["subject_id"], ("_from", "_to"), ("_low", "_high"), clip=cohort.withColumns(span))
    met = F.lit(0).cast("long")
    for w in windows:
        if w.window_id in ids:
            hit = (F.col("fact_start") <= F.date_add(start, w.end)) & (
                F.col("fact_start" if w.kind == "start" else "fact_end") >= F.date_add(start, w.start))
            met = met.bitwiseOR(F.when(hit, F.shiftleft("_cohorts", ids.index(w.window_id) * per)).otherwise(0).cast("long"))
    return pairs.select("subject_id", "cohort_start_date", "fact_id", "_word", met.alias("met")).where("met <> 0")


def subjects_per_fact(cohort: DataFrame, facts: DataFrame, windows: Sequence[FeatureWindow],
                      counted_as: Callable[[DataFrame], DataFrame] = lambda met: met) -> DataFrame:
    """Distinct subjects per cohort, fact and window.

    Matches are shuffled once, by subject and fact, as bits of all windows and cohorts: a subject
    with many facts is spread out, and a row is never repeated for the cohorts of its index date.
    Subjects with equal bits are counted together, and only their counts are spread over cohorts
    and windows. ``counted_as`` may put other ``fact_id`` in place of those met.
    """
    parts = []
    for ids in window_words(windows):
        per, places = _per_word(ids), cohort_bits(cohort, ids)
        met = facts_met(index_dates(cohort, places), cohort, facts, windows, ids, per)
        alike = (
            counted_as(met).groupBy("subject_id", "fact_id", "_word").agg(F.bit_or("met").alias("met"))
            .groupBy("fact_id", "_word", "met").agg(F.count("*").alias("_n"))
        )
        own = alike.join(F.broadcast(places), "_word").withColumn("met", F.call_function("shiftright", F.col("met"), F.col("_bit")))
        found = F.explode(F.array_compact(F.array(*[F.when(_has(k * per), F.lit(i)) for k, i in enumerate(ids)])))
        parts.append(
            own.select("cohort_definition_id", "fact_id", found.alias("window_id"), "_n")
            .groupBy("cohort_definition_id", "fact_id", "window_id").agg(F.sum("_n").alias("sum_value"))
        )
    return _union(parts)


def _per_word(ids: Sequence[int]) -> int:
    """Cohorts whose bits for so many windows fit one long."""
    return _WORD // len(ids)


def _has(bit: int) -> Column:
    return F.col("met").bitwiseAND(F.lit(1 << bit)) != 0


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return together


def feature_counts(cohort: DataFrame, staging: DataFrame, windows: Sequence[FeatureWindow],
                   feature_ids: Sequence[int]) -> DataFrame:
    """Subjects of each cohort with each feature cohort in each window."""
    facts = staging.where(F.col("cohort_definition_id").isin(*feature_ids)).select(
        "subject_id",
        F.col("cohort_definition_id").alias("fact_id"),
        F.col("cohort_start_date").alias("fact_start"),
        F.col("cohort_end_date").alias("fact_end"),
    )
    return subjects_per_fact(cohort, facts, windows).select(
        "cohort_definition_id",
        F.col("fact_id").alias("feature_cohort_definition_id"),
        "window_id",
        F.col("sum_value").alias("feature_count"),
    )


def feature_proportions(cohort: DataFrame, summary: DataFrame) -> DataFrame:
    """Mean and standard deviation per feature, for cohorts of more than one subject."""
    total = (
        cohort.groupBy("cohort_definition_id")
        .agg(F.count_distinct("subject_id").alias("total_count"))
        .where("total_count > 1")
    )
    count, n = F.col("feature_count"), F.col("total_count")
    return summary.join(total, "cohort_definition_id").select(
        "cohort_definition_id",
        "feature_cohort_definition_id",
        "window_id",
        "total_count",
        "feature_count",
        proportion(count, n).alias("mean"),
        bulk_sd(count, n).alias("sd"),
    )


def all_features(cohort_strata: DataFrame, features: DataFrame) -> DataFrame:
    """Cohorts counted as features: the strata cohorts and the feature cohorts."""
    return cohort_strata.select("name", "cohort_id").unionByName(features.select("name", "cohort_id"))


def format_features(proportions: DataFrame, windows: DataFrame, features: DataFrame) -> DataFrame:
    """Give feature proportions a covariate id and a readable name."""
    named = features.select(
        F.col("cohort_id").alias("feature_cohort_definition_id"), F.col("name").alias("feature_name")
    )
    return (
        proportions.join(windows, "window_id")
        .join(named, "feature_cohort_definition_id")
        .withColumnRenamed("cohort_definition_id", "cohort_id")
        .withColumn("covariate_id", F.col("feature_cohort_definition_id") * 1000 + F.col("window_id"))
        .withColumn(
            "covariate_name",
            F.concat(
                F.lit("Cohort during day "), F.col("window_start").cast("string"), F.lit(" through "),
                F.col("window_end").cast("string"), F.lit(" days "), "window_type", F.lit(" the index: "),
                "feature_name",
            ),
        )
        .withColumn("analysis_id", F.lit(FEATURE_ANALYSIS).cast("long"))
    )
