"""Events of many definitions at once: each clinical table is read one time and tagged with all codesets.

Definitions name their own codesets. Here equal ones become one, all are resolved
together, and a join of every clinical row with the table "concept -> codesets"
tags it with all codesets it belongs to. Rows without a tag that some query wants
are dropped, the rest is stored sorted by person, one table per domain. Whatever
the definitions ask later - any number of event queries in one go - is read from
there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.expressions import age_at
from cohortry.operators.criteria import Criterion, Group
from cohortry.operators.events import DOMAINS, Domain, Events, _concept, _conditions, _end_date
from cohortry.operators.exits import DrugEra
from cohortry.operators.intervals import all_of, first_per
from cohortry.operators.vocabulary import codesets
from cohortry.session import broadcast_if_small
from cohortry.sources.cdm import Cdm

# What a matched event has; ``query`` numbers the event queries that were asked.
MATCHED = ("query", "person_id", "event_id", "start_date", "end_date", "target_concept_id")


def share_codesets(specs: Sequence) -> tuple[list, dict[int, tuple]]:
    """Definitions over common codeset numbers, and what each of these holds."""
    numbers: dict[tuple, int] = {}
    shared = []
    for spec in specs:
        own = {i: numbers.setdefault(tuple(entries), len(numbers)) for i, entries in spec.codesets.items()}
        shared.append(_renumber(spec, own))
    return shared, {number: entries for entries, number in numbers.items()}


def _renumber(spec, own: Mapping[int, int]):
    def query(one):
        if not isinstance(one, Events):
            return one
        return replace(one, codeset=None if one.codeset is None else own[one.codeset], group=group(one.group))

    def group(one):
        if one is None:
            return None
        return replace(one, members=tuple(member(m) for m in one.members))

    def member(one):
        if isinstance(one, Group):
            return group(one)
        return replace(one, events=query(one.events)) if isinstance(one, Criterion) else one

    leave = replace(spec.exit, codeset=own[spec.exit.codeset]) if isinstance(spec.exit, DrugEra) else spec.exit
    return replace(
        spec, primary=tuple(map(query, spec.primary)), additional=group(spec.additional),
        inclusion_rules=tuple(map(group, spec.inclusion_rules)), exit=leave, censors=tuple(map(query, spec.censors)),
    )


def criteria_of(group: Group | None) -> list[Criterion]:
    """All criteria of a group, in order and without repetition; not those of nested event queries."""
    found: dict[Criterion, None] = {}
    for member in group.members if group is not None else ():
        for one in criteria_of(member) if isinstance(member, Group) else [member]:
            if isinstance(one, Criterion):
                found[one] = None
    return list(found)


def queries_of(specs: Iterable) -> list:
    """All event queries of some definitions, nested ones included."""
    found: dict = {}

    def add(query) -> None:
        if query not in found:
            found[query] = None
            if isinstance(query, Events) and query.group is not None:
                for criterion in criteria_of(query.group):
                    add(criterion.events)

    for spec in specs:
        groups = [spec.additional, *spec.inclusion_rules]
        for query in [*spec.primary, *spec.censors, *[c.events for g in groups for c in criteria_of(g)]]:
            add(query)
    return list(found)


def domains_of(specs: Iterable) -> set[str]:
    """Domains whose tables some definitions read."""
    specs = list(specs)
    era = any(isinstance(s.exit, DrugEra) for s in specs)
    return {q.domain for q in queries_of(specs) if isinstance(q, Events)} | ({"drug"} if era else set())


def resolved(cdm: Cdm, definitions: Mapping[int, tuple], keep: Callable[[str, DataFrame], DataFrame]) -> DataFrame | None:
    """``concept_id, tags``: one row per concept of any codeset, stored once and broadcast if a count allows it; None without codesets."""
    if not definitions:
        return None
    rows = codesets(cdm, definitions).groupBy("concept_id").agg(F.sort_array(F.collect_set("codeset_id")).alias("tags"))
    return broadcast_if_small(keep("concept_tags", rows))


class EventStore:
    """Tagged events of some definitions; ``keep(name, df)`` stores a table and returns it as read back.

    ``tags`` are those of ``resolved`` for the same definitions, where they are known.
    """

    def __init__(self, cdm: Cdm, specs: Sequence, keep: Callable[[str, DataFrame], DataFrame], tags: DataFrame | None = None):
        self.cdm, self.keep = cdm, keep
        self.specs, self.definitions = share_codesets(specs)
        self.queries = queries_of(self.specs)
        self.eras = list({s.exit: None for s in self.specs if isinstance(s.exit, DrugEra)})
        self._tags = tags if tags is not None else resolved(cdm, self.definitions, keep)
        self.tables = {domain: keep(f"events/{domain}", self.tagged(domain)) for domain in sorted(domains_of(self.specs))}

    def tagged(self, name: str) -> DataFrame:
        """One domain: its clinical table, read once, with the codesets of every row's concepts."""
        domain, asked = DOMAINS[name], [q for q in self.queries if isinstance(q, Events) and q.domain == name]
        era = name == "drug" and bool(self.eras)
        rows = self.cdm[domain.table]
        keys = {"tags": domain.concept} if era or any(q.codeset is not None and not q.source for q in asked) else {}
        if era or any(q.codeset is not None and q.source for q in asked):
            keys["source_tags"] = domain.source_concept
        for tags, concept in keys.items():
            known = self._tags.select(F.col("concept_id").alias(f"_{tags}_of"), F.col("tags").alias(tags))
            rows = rows.join(known, rows[concept] == known[f"_{tags}_of"], "left")
        if not any(q.codeset is None for q in asked):
            held = F.lit(False)
            for tags in keys:
                held |= F.col(tags).isNotNull()
            rows = rows.where(held)
        start = F.col(domain.start)
        columns = {
            "person_id": F.col("person_id"), "event_id": F.col(domain.event_id).cast("long"), "start_date": start,
            "end_date": _end_date(domain, start, "start"), "target_concept_id": _concept(Events(name), domain),
            "raw_end": F.col(domain.end) if domain.end else F.lit(None).cast("date"),
        }
        columns |= {c: F.col(c) for c in self._filtered(domain, asked)} | {tags: F.col(tags) for tags in keys}
        if era:
            columns["exposed_to"] = F.coalesce(F.col(domain.end), F.date_add(start, F.col("days_supply")), F.date_add(start, 1))
        named = rows.select(*[value.alias(c) for c, value in columns.items()])
        return named.hint("rebalance", "person_id").sortWithinPartitions("person_id", "start_date")

    @staticmethod
    def _filtered(domain: Domain, asked: Sequence[Events]) -> list[str]:
        """Columns that the filters of some queries look at."""
        wanted = {
            "value_as_number": any(q.value_between for q in asked), "unit_concept_id": any(q.units for q in asked),
            "value_as_concept_id": any(q.value_concepts for q in asked), domain.type_concept: any(q.type_concepts for q in asked),
        }
        return [c for c, used in wanted.items() if used]

    @staticmethod
    def _in_codeset(query: Events) -> Column:
        if query.codeset is None:
            return F.lit(True)
        return F.coalesce(F.array_contains("source_tags" if query.source else "tags", query.codeset), F.lit(False))

    def matched(self, queries: Sequence, judge: Callable | None = None) -> DataFrame:
        """``MATCHED`` rows of all ``queries``; ``query`` is the position in the list.

        Every domain is read once, and once more where queries want a person's first
        event. ``judge(events, groups)`` keeps those of nested queries that satisfy
        their group.
        """
        parts: list[DataFrame] = []
        numbered = list(enumerate(queries))
        for name in self.tables:
            own = [(i, q) for i, q in numbered if isinstance(q, Events) and q.domain == name]
            for first in (False, True):
                some = [(i, q) for i, q in own if q.first == first]
                if some:
                    parts.append(self._of_domain(name, some, first))
        for i, q in numbered:
            if not isinstance(q, Events):
                parts.append(q.frame(self.cdm).withColumn("query", F.lit(i)).select(*MATCHED))
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        nested = {i: q.group for i, q in numbered if isinstance(q, Events) and q.group is not None}
        if nested:
            inner = found.where(F.col("query").isin(*nested))
            found = found.where(~F.col("query").isin(*nested)).unionByName(judge(inner, nested))
        return found

    def _of_domain(self, name: str, queries: Sequence[tuple[int, Events]], first: bool) -> DataFrame:
        domain, rows = DOMAINS[name], self.tables[name]

        def start(q: Events) -> Column:
            return F.col("raw_end") if q.anchor == "end" else F.col("start_date")

        def passes(q: Events) -> Column:
            return all_of(_conditions(q, domain, start(q)))

        early = [F.when(self._in_codeset(q) if first else self._in_codeset(q) & passes(q), F.lit(i)) for i, q in queries]
        rows = rows.withColumn("query", F.explode(F.array_compact(F.array(*early))))
        if first:
            rows = first_per(rows, ["query", "person_id"], ["start_date", "event_id"])
            rows = rows.where(_by_query(queries, passes, F.lit(False)))
        at_end = [i for i, q in queries if q.anchor == "end"]
        if at_end:
            ends = F.col("query").isin(*at_end)
            rows = rows.withColumns({"start_date": F.when(ends, F.col("raw_end")).otherwise(F.col("start_date")),
                                     "end_date": F.when(ends, F.col("raw_end")).otherwise(F.col("end_date"))})
        asking = [(i, q) for i, q in queries if q.genders or q.min_age is not None or q.below_age is not None]
        if asking:
            person = self.cdm["person"].select("person_id", "year_of_birth", "gender_concept_id")
            chosen = F.col("query").isin(*[i for i, _ in asking])
            judged = rows.where(chosen).join(person, "person_id").where(_by_query(asking, _of_person, F.lit(False)))
            rows = rows.where(~chosen).select(*MATCHED).unionByName(judged.select(*MATCHED))
        return rows.select(*MATCHED)

    def exposures(self) -> DataFrame:
        """``era, person_id, start_date, end_date`` of the drug exposures of every drug era exit (numbered as in ``eras``)."""
        held = [F.when(F.coalesce(F.array_contains("tags", e.codeset), F.lit(False)) | F.coalesce(F.array_contains("source_tags", e.codeset), F.lit(False)), F.lit(i))
                for i, e in enumerate(self.eras)]
        rows = self.tables["drug"].withColumn("era", F.explode(F.array_compact(F.array(*held))))
        return rows.select("era", "person_id", "start_date", F.col("exposed_to").alias("end_date"))


def _by_query(queries: Sequence[tuple[int, Events]], what: Callable[[Events], Column], otherwise: Column) -> Column:
    """A condition of its own for each query."""
    found = otherwise
    for i, q in queries:
        found = F.when(F.col("query") == i, what(q)).otherwise(found)
    return found


def _of_person(q: Events) -> Column:
    age = age_at(F.col("start_date"), F.col("year_of_birth"))
    found = []
    if q.genders:
        found.append(F.col("gender_concept_id").isin(*q.genders))
    if q.min_age is not None:
        found.append(age >= q.min_age)
    if q.below_age is not None:
        found.append(age < q.below_age)
    return all_of(found)
