"""Cohort definitions and the plan that builds their rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.operators.criteria import Group, evaluate, shapes
from cohortry.operators.exits import DateOffset, DrugEra, ObservationEnd, censor_dates
from cohortry.operators.intervals import collapse_eras, first_per, in_observation
from cohortry.operators.vocabulary import Codesets, Concepts
from cohortry.sources.cdm import Cdm

# Order of a person's index events; ties on the day are broken by the position of
# the event query in the definition, then by the id of the source row.
EARLIEST = ("start_date", "rank", "event_id", "end_date", "op_start_date")


# Rules a mask can hold: a long without its sign.
MAX_RULES = 63


@dataclass(frozen=True)
class CohortSpec:
    """A cohort definition, in the order in which its parts apply."""

    cohort_id: int
    primary: Sequence
    codesets: Mapping[int, Sequence[Concepts]] = field(default_factory=dict)
    prior_days: int = 0
    post_days: int = 0
    primary_limit: str = "all"
    additional: Group | None = None
    qualified_limit: str = "all"
    inclusion_rules: Sequence[Group] = ()
    expression_limit: str = "all"
    exit: ObservationEnd | DateOffset | DrugEra = ObservationEnd()
    censors: Sequence = ()
    era_pad: int = 0


def primary_events(cdm: Cdm, codes: Codesets | None, queries: Sequence) -> DataFrame:
    """Events of all primary queries, each marked with the place of its query."""
    together = None
    for rank, query in enumerate(queries):
        part = query.frame(cdm, codes).withColumn("rank", F.lit(rank))
        together = part if together is None else together.unionByName(part)
    return together


def limit_first(index: DataFrame, limit: str) -> DataFrame:
    """A person's earliest index event, or all of them."""
    return first_per(index, ["person_id"], EARLIEST) if limit == "first" else index


def qualified_events(cdm: Cdm, codes: Codesets | None, spec: CohortSpec) -> DataFrame:
    """Index events: observed long enough, limited, and passing the additional criteria."""
    events = shapes(primary_events(cdm, codes, spec.primary))
    index = in_observation(events, cdm["observation_period"], spec.prior_days, spec.post_days)
    index = limit_first(index, spec.primary_limit)
    if spec.additional is not None:
        index = evaluate(cdm, codes, index, [spec.additional], ["_kept"]).where("_kept").drop("_kept")
    return limit_first(index, spec.qualified_limit)


def inclusion_mask(cdm: Cdm, codes: Codesets | None, index: DataFrame, rules: Sequence[Group]) -> DataFrame:
    """Add ``inclusion_rule_mask``: bit ``i`` is set where rule ``i`` holds."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} inclusion rules; a mask of 64 bits holds {MAX_RULES}")
    names = [f"_rule_{i}" for i in range(len(rules))]
    judged = evaluate(cdm, codes, index, rules, names) if rules else index
    mask = F.lit(0).cast("long")
    for i, name in enumerate(names):
        mask = mask.bitwiseOR(F.shiftleft(F.col(name).cast("long"), i))
    return judged.withColumn("inclusion_rule_mask", mask).drop(*names)


def included_events(cdm: Cdm, codes: Codesets | None, index: DataFrame, spec: CohortSpec) -> DataFrame:
    """Index events that satisfy every inclusion rule."""
    if spec.inclusion_rules:
        every = (1 << len(spec.inclusion_rules)) - 1
        masked = inclusion_mask(cdm, codes, index, spec.inclusion_rules)
        index = masked.where(F.col("inclusion_rule_mask") == every).drop("inclusion_rule_mask")
    return limit_first(index, spec.expression_limit)


def cohort_rows(cdm: Cdm, codes: Codesets | None, included: DataFrame, spec: CohortSpec) -> DataFrame:
    """One interval per index event: it ends at the earliest exit on or after its start."""
    rows = spec.exit.ends(cdm, codes, included)
    if spec.censors:
        rows = censor_dates(cdm, codes, rows, spec.censors)
        rows = rows.withColumn("exit_date", F.least("exit_date", "censor_date"))
    return rows.where(F.col("exit_date") >= F.col("start_date")).select(
        "person_id", "start_date", F.col("exit_date").alias("end_date")
    )


def build_cohort(cdm: Cdm, spec: CohortSpec) -> DataFrame:
    """Rows of a cohort: closed, non-overlapping intervals per person."""
    codes = Codesets(cdm, spec.codesets)
    index = qualified_events(cdm, codes, spec)
    included = included_events(cdm, codes, index, spec)
    eras = collapse_eras(cohort_rows(cdm, codes, included, spec), ["person_id"], spec.era_pad)
    return as_cohort(eras, spec.cohort_id)


def as_cohort(intervals: DataFrame, cohort_id: int) -> DataFrame:
    return intervals.select(
        F.lit(cohort_id).cast("long").alias("cohort_definition_id"),
        F.col("person_id").alias("subject_id"),
        F.col("start_date").alias("cohort_start_date"),
        F.col("end_date").alias("cohort_end_date"),
    )


def inclusion_result(cdm: Cdm, spec: CohortSpec) -> DataFrame:
    """Distinct persons per inclusion mask: mode 1 all index events, mode 0 a person's best one.

    The best event is the one that satisfies most rules; among equals the
    earliest counts.
    """
    codes = Codesets(cdm, spec.codesets)
    masked = inclusion_mask(cdm, codes, qualified_events(cdm, codes, spec), spec.inclusion_rules)
    best = first_per(
        masked.withColumn("_missed", -F.bit_count("inclusion_rule_mask")), ["person_id"], ["_missed", *EARLIEST]
    )
    parts = [
        rows.groupBy("inclusion_rule_mask")
        .agg(F.count_distinct("person_id").alias("person_count"))
        .select(
            F.lit(spec.cohort_id).cast("long").alias("cohort_definition_id"),
            "inclusion_rule_mask",
            "person_count",
            F.lit(mode).alias("mode_id"),
        )
        for mode, rows in ((1, masked), (0, best))
    ]
    return parts[0].unionByName(parts[1])


def _every(rules: int | Column) -> Column:
    """The mask in which so many rules hold."""
    return F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 64 - rules if isinstance(rules, Column) else F.lit(64 - rules))


def rule_stats(result: DataFrame, rules: int | Column) -> DataFrame:
    """Per rule and mode: who meets it, who would be gained without it, and all persons.

    ``result`` is what ``inclusion_result`` gives; a rule gains those who meet
    all others. ``rules`` is how many a cohort has, at least one: a number, or a
    column where the cohorts differ.
    """
    mask, persons = F.col("inclusion_rule_mask"), F.col("person_count")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("rule_sequence"))
    last = rules - 1 if isinstance(rules, Column) else F.lit(rules - 1)
    return (
        result.withColumn("rule_sequence", F.explode(F.sequence(F.lit(0), last)))
        .groupBy("cohort_definition_id", "rule_sequence", "mode_id")
        .agg(
            F.sum(F.when(mask.bitwiseAND(bit) != 0, persons).otherwise(0)).alias("person_count"),
            F.sum(F.when(mask == _every(rules).bitwiseXOR(bit), persons).otherwise(0)).alias("gain_count"),
            F.sum(persons).alias("person_total"),
        )
    )


def summary_stats(result: DataFrame, rules: int | Column) -> DataFrame:
    """Per mode: persons before and after all inclusion rules."""
    kept = F.when(F.col("inclusion_rule_mask") == _every(rules), F.col("person_count")).otherwise(0)
    return result.groupBy("cohort_definition_id", "mode_id").agg(
        F.sum("person_count").alias("base_count"), F.sum(kept).alias("final_count")
    )
