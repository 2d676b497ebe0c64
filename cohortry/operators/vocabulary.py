"""Concept sets and concept groups."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators.intervals import all_of
from cohortry.session import broadcast_if_small, is_small, small_table
from cohortry.sources.cdm import Cdm


@dataclass(frozen=True)
class Concepts:
    """A list of concept ids inside a concept set definition."""

    ids: tuple[int, ...]
    descendants: bool = True
    excluded: bool = False


def concepts(*ids: int, descendants: bool = True) -> Concepts:
    return Concepts(tuple(ids), descendants)


def without(*ids: int, descendants: bool = True) -> Concepts:
    return Concepts(tuple(ids), descendants, excluded=True)


def codesets(cdm: Cdm, definitions: Mapping[int, Iterable[Concepts]]) -> DataFrame:
    """Resolve all concept sets of a study in one pass: ``(codeset_id, concept_id)``.

    A listed id counts when the vocabulary has it, valid or not; descendants
    count only when valid. A concept reached by an excluded entry is dropped.
    """
    rows = [
        (codeset_id, concept_id, entry.descendants, entry.excluded)
        for codeset_id, entries in definitions.items()
        for entry in entries
        for concept_id in entry.ids
    ]
    listed = small_table(
        cdm.spark, rows, "codeset_id int, listed_id long, descendants boolean, excluded boolean"
    )
    concept = cdm["concept"].select("concept_id", "invalid_reason")
    itself = listed.join(concept, F.col("listed_id") == F.col("concept_id"))
    below = (
        listed.where("descendants")
        .join(cdm["concept_ancestor"], F.col("listed_id") == F.col("ancestor_concept_id"))
        .join(concept.where(F.col("invalid_reason").isNull()),
              F.col("descendant_concept_id") == F.col("concept_id"))
    )
    columns = ["codeset_id", "concept_id", "excluded"]
    return (
        itself.select(*columns)
        .unionByName(below.select(*columns))
        .groupBy("codeset_id", "concept_id")
        .agg(F.bool_or("excluded").alias("excluded"))
        .where(~F.col("excluded"))
        .drop("excluded")
    )


def concept_set(cdm: Cdm, *entries: Concepts) -> DataFrame:
    """One concept set as a column of concept ids."""
    return codesets(cdm, {0: entries}).select("concept_id")


class Codesets:
    """Resolved concept sets of a definition, kept in memory.

    One count of all of them decides whether each is broadcast; only where they
    are large together is a single set counted by itself.
    """

    def __init__(self, cdm: Cdm, definitions: Mapping[int, Iterable[Concepts]]):
        self._rows = codesets(cdm, definitions).persist() if definitions else None
        self._small = self._rows is not None and is_small(self._rows)

    def __getitem__(self, codeset_id: int) -> DataFrame:
        chosen = self._rows.where(F.col("codeset_id") == codeset_id).select("concept_id")
        return F.broadcast(chosen) if self._small else broadcast_if_small(chosen)


def drug_groups(cdm: Cdm) -> DataFrame:
    """Drug concepts with the classes and ingredients above them."""
    # Lengths of the class codes in use.
    code_lengths = (1, 3, 4, 5)
    group = cdm["concept"].where(
        (
            ((F.col("vocabulary_id") == "ATC") & F.length(F.rtrim("concept_code")).isin(*code_lengths))
            | (
                (F.col("standard_concept") == "S")
                & (F.col("concept_class_id") == "Ingredient")
                & (F.col("domain_id") == "Drug")
            )
        )
        & (F.col("concept_id") != 0)
    )
    return _with_descendants(cdm, group)


# Root of the clinical findings, groups wanted although they are
# close to it, and the names that mark a group as too general.
CLINICAL_FINDING = 441840
HIGH_LEVEL_GROUPS = (
    433736, 433595, 441408, 72404, 192671, 137977, 434621, 437312, 439847, 4171917,
    438555, 4299449, 375258, 76784, 40483532, 4145627, 434157, 433778, 258449, 313878,
)
GENERAL_NAMES = (
    "%finding",
    "Disorder of%",
    "Finding of%",
    "Disease of%",
    "Injury of%",
    "%by site",
    "%by body site",
    "%by mechanism",
    "%of body region",
    "%of anatomical site",
    "%of specific body structure%",
)


def condition_groups(cdm: Cdm) -> DataFrame:
    """Condition concepts with the clinical groups above them."""
    below_root = (
        cdm["concept_ancestor"]
        .where(F.col("ancestor_concept_id") == CLINICAL_FINDING)
        .where((F.col("min_levels_of_separation") > 2) | F.col("descendant_concept_id").isin(*HIGH_LEVEL_GROUPS))
        .select(F.col("descendant_concept_id").alias("concept_id"))
    )
    specific = all_of([~F.col("concept_name").like(pattern) for pattern in GENERAL_NAMES])
    group = (
        cdm["concept"].where(specific & (F.col("domain_id") == "Condition")).join(below_root, "concept_id", "left_semi")
    )
    return _with_descendants(cdm, group)


def _with_descendants(cdm: Cdm, group: DataFrame) -> DataFrame:
    ancestor = cdm["concept_ancestor"].select("descendant_concept_id", "ancestor_concept_id")
    wanted = group.select(F.col("concept_id").alias("ancestor_concept_id"))
    return ancestor.join(wanted, "ancestor_concept_id", "left_semi").select(
        "descendant_concept_id", "ancestor_concept_id"
    ).distinct()
