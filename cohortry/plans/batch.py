"""Many cohort definitions in one plan.

The definitions run side by side: index events carry the number of their
definition (``owner``), and every step - observation, limits, criteria, inclusion
rules, exits, eras - is one step for all of them. A study of a hundred
definitions so reads each clinical table once and shuffles as often as a single
one does. Rows and rules are those of ``plans.cohort``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.operators.criteria import (
    BEFORE_ALL,
    Criterion,
    Demographic,
    Group,
    corners,
    count_by_pairs,
    leaves,
    scan_points,
)
from cohortry.operators.dominance import count_dominated, with_previous
from cohortry.operators.event_store import EventStore, criteria_of, domains_of, queries_of, resolved, share_codesets
from cohortry.operators.events import DOMAINS, Events
from cohortry.operators.exits import DateOffset, DrugEra
from cohortry.operators.intervals import collapse_eras, first_per, in_observation, scan_days
from cohortry.plans.cohort import EARLIEST, MAX_RULES, CohortSpec
from cohortry.schemas import TABLES
from cohortry.session import scanned_bytes, small_table
from cohortry.sources.cdm import Cdm

# Index events of all definitions.
INDEX = ("owner", "person_id", "start_date", "end_date", "op_start_date", "op_end_date", "rank", "event_id")

_SETTINGS = ("owner int, cohort_id long, prior_days int, post_days int, exit_field string, exit_days int, "
             "era int, era_pad int, every long")

# Bytes of the clinical tables whose persons are taken in one round, about; slices of persons that rounds are made of.
ROUND_BYTES, SLICES = 3 << 30, 256

# Answers of so many criteria are the bits of one long.
_WORD = 62


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


class Batch:
    """Some definitions over one event store; ``keep`` stores the tables between the steps."""

    def __init__(self, store: EventStore):
        self.store, self.keep = store, store.keep
        self.specs: list[CohortSpec] = store.specs
        for spec in self.specs:
            if len(spec.inclusion_rules) > MAX_RULES:
                raise ValueError(f"{len(spec.inclusion_rules)} inclusion rules; a mask of 64 bits holds {MAX_RULES}")
        rows = []
        for i, spec in enumerate(self.specs):
            leave = spec.exit
            offset = isinstance(leave, DateOffset)
            rows.append((i, spec.cohort_id, spec.prior_days, spec.post_days, leave.field if offset else None, leave.days if offset else None,
                         store.eras.index(leave) if isinstance(leave, DrugEra) else None, spec.era_pad, (1 << len(spec.inclusion_rules)) - 1))
        self.settings = small_table(store.cdm.spark, rows, _SETTINGS)
        self._nested = 0
        self._masked: DataFrame | None = None

    def _owners(self, test: Callable[[CohortSpec], bool]) -> list[int]:
        return [i for i, spec in enumerate(self.specs) if test(spec)]

    def primary(self) -> DataFrame:
        """Distinct index events with their observation period, per definition."""
        asked = list({q: None for spec in self.specs for q in spec.primary})
        places = [(asked.index(q), i, rank) for i, spec in enumerate(self.specs) for rank, q in enumerate(spec.primary)]
        events = self.store.matched(asked, self.judge).join(small_table(self.store.cdm.spark, places, "query int, owner int, rank int"), "query")
        shapes = (
            events.groupBy("owner", "person_id", "start_date", "end_date")
            .agg(F.min(F.struct("rank", "event_id")).alias("_first"))
            .select("owner", "person_id", "start_date", "end_date", "_first.rank", "_first.event_id")
        )
        observed = in_observation(shapes, self.store.cdm["observation_period"]).join(self.settings.select("owner", "prior_days", "post_days"), "owner")
        long_enough = (F.date_add("op_start_date", F.col("prior_days")) <= F.col("start_date")) & (F.date_add("start_date", F.col("post_days")) <= F.col("op_end_date"))
        return observed.where(long_enough).select(*INDEX)

    def limited(self, index: DataFrame, name: str) -> DataFrame:
        """A person's earliest index event in the definitions that limit here (``name`` of the limit), all events in the others."""
        some = self._owners(lambda s: getattr(s, name) == "first")
        if not some:
            return index
        chosen = F.col("owner").isin(*some)
        first = first_per(index.where(chosen), ["owner", "person_id"], EARLIEST)
        return first if len(some) == len(self.specs) else index.where(~chosen).unionByName(first)

    def _limits(self, name: str) -> bool:
        return bool(self._owners(lambda s: getattr(s, name) == "first"))

    def qualified(self) -> DataFrame:
        """Index events that are limited and pass the additional criteria; stored between steps that read them more than once."""
        index = self.primary()
        groups = {i: [s.additional] for i, s in enumerate(self.specs) if s.additional is not None}
        if groups or self._limits("primary_limit"):
            index = self.limited(self.keep("index/primary", index), "primary_limit")
        if groups:
            chosen = F.col("owner").isin(*groups)
            judged = self.evaluate(index.where(chosen), groups, "additional")
            index = index.where(~chosen).unionByName(judged.where(F.col("mask") == 1).drop("mask"))
        if groups or self._limits("qualified_limit"):
            index = self.limited(self.keep("index/passed", index), "qualified_limit")
        return index

    def masked(self) -> DataFrame:
        """Qualified events with ``inclusion_rule_mask``; read from what is stored, since cohorts and statistics both read it."""
        if self._masked is None:
            self._masked = self._mask()
        return self._masked

    def _mask(self) -> DataFrame:
        index = self.keep("index/qualified", self.qualified())
        groups = {i: list(s.inclusion_rules) for i, s in enumerate(self.specs) if s.inclusion_rules}
        none = index.withColumn("mask", F.lit(0).cast("long"))
        if not groups:
            return none.withColumnRenamed("mask", "inclusion_rule_mask")
        chosen = F.col("owner").isin(*groups)
        none = none.where(~chosen).unionByName(self.evaluate(index.where(chosen), groups, "rules"))
        return self.keep("index/masked", none.withColumnRenamed("mask", "inclusion_rule_mask"))

    def cohorts(self) -> DataFrame:
        """Rows of all cohorts."""
        masked = self.masked().join(self.settings.select("owner", "every"), "owner")
        included = masked.where(F.col("inclusion_rule_mask") == F.col("every")).select(*INDEX)
        if self.store.eras or self._limits("expression_limit") or self._owners(lambda s: bool(s.censors)):
            included = self.keep("index/included", self.limited(included, "expression_limit"))
        rows = self._exits(included)
        pads = self.settings.select("owner", "cohort_id", "era_pad")
        stays = rows.where(F.col("exit_date") >= F.col("start_date")).select("owner", "person_id", "start_date", F.col("exit_date").alias("end_date")).join(pads, "owner")
        eras = collapse_eras(stays, ["cohort_id", "person_id", "era_pad"], F.col("era_pad"))
        return eras.select(
            F.col("cohort_id").alias("cohort_definition_id"), F.col("person_id").alias("subject_id"),
            F.col("start_date").alias("cohort_start_date"), F.col("end_date").alias("cohort_end_date"))

    def inclusion(self) -> DataFrame:
        """What ``inclusion_result`` gives, for all definitions with inclusion rules."""
        ruled = self.settings.where("every > 0").select("owner", "cohort_id")
        masked = self.masked().join(ruled, "owner")
        best = first_per(masked.withColumn("_missed", -F.bit_count("inclusion_rule_mask")), ["owner", "person_id"], ["_missed", *EARLIEST])
        parts = [
            rows.groupBy(F.col("cohort_id").alias("cohort_definition_id"), "inclusion_rule_mask")
            .agg(F.count_distinct("person_id").alias("person_count")).withColumn("mode_id", F.lit(mode))
            for mode, rows in ((1, masked), (0, best))
        ]
        return parts[0].unionByName(parts[1])

    def _exits(self, index: DataFrame) -> DataFrame:
        """Add ``exit_date``: the earliest of all exits of the definition."""
        rows = index.join(self.settings.select("owner", "exit_field", "exit_days", "era"), "owner")
        anchor = F.when(F.col("exit_field") == "end", F.col("end_date")).otherwise(F.col("start_date"))
        moved = F.greatest(F.date_add(anchor, F.col("exit_days")), F.col("start_date"))
        rows = rows.withColumn("exit_date", F.when(F.col("exit_days").isNull(), F.col("op_end_date")).otherwise(moved))
        if self.store.eras:
            in_era = F.col("era").isNotNull()
            rows = rows.where(~in_era).unionByName(self._era_ends(rows.where(in_era)))
        censored = self._owners(lambda s: bool(s.censors))
        if censored:
            chosen = F.col("owner").isin(*censored)
            rows = rows.where(~chosen).unionByName(self._censored(rows.where(chosen)))
        return rows

    def _era_ends(self, rows: DataFrame) -> DataFrame:
        """The end of the drug era that holds the index day, not after observation."""
        settings = small_table(self.store.cdm.spark, [(i, e.gap, e.offset) for i, e in enumerate(self.store.eras)], "era int, gap int, shift int")
        taken = self.store.exposures().join(rows.select("era", "person_id").distinct(), ["era", "person_id"], "left_semi").join(settings, "era")
        eras = collapse_eras(taken, ["person_id", "era", "gap", "shift"], F.col("gap"))
        ends = F.date_add("end_date", F.col("shift"))
        facts = eras.select("person_id", "era", ends.alias("day"), F.col("start_date").alias("_era_start"), ends.alias("_era_end"))
        # Eras do not overlap: the first one to end on or after the index day is the only candidate.
        keys = ["person_id", "era"]
        seen = scan_days(rows.withColumn("day", F.col("start_date")), facts, keys, {"_era_start": "min", "_era_end": "min"}, forward=True, spread=keys)
        held = F.when(F.col("_era_start") <= F.col("start_date"), F.col("_era_end"))
        return seen.withColumn("exit_date", F.least(held, F.col("op_end_date"))).select(*rows.columns)

    def _censored(self, rows: DataFrame) -> DataFrame:
        """Exits no later than the first censoring event from the index day to the end of observation."""
        asked = list({q: None for spec in self.specs for q in spec.censors})
        owners = [(asked.index(q), i) for i, spec in enumerate(self.specs) for q in spec.censors]
        found = self.store.matched(asked, self.judge).join(small_table(self.store.cdm.spark, owners, "query int, owner int"), "query")
        day = F.col("start_date")
        facts = found.select("person_id", "owner", day.alias("day"), day.alias("_next")).distinct()
        keys = ["person_id", "owner"]
        seen = scan_days(rows.withColumn("day", day), facts, keys, {"_next": "min"}, forward=True, spread=keys)
        censor = F.when(F.col("_next") <= F.col("op_end_date"), F.col("_next"))
        return seen.withColumn("exit_date", F.least("exit_date", censor)).select(*rows.columns)

    # --- Criteria of all owners at once ---------------------------------------------------------

    def judge(self, events: DataFrame, groups: Mapping[int, Group]) -> DataFrame:
        """Events of nested queries that satisfy their group, each seen within its own observation period."""
        self._nested += 1
        name = f"nested/{self._nested}"
        events = self.keep(f"{name}-events", events)
        alike = events.select(F.col("query").alias("owner"), "person_id", "start_date", "end_date").distinct()
        index = in_observation(alike, self.store.cdm["observation_period"])
        judged = self.evaluate(index, {i: [g] for i, g in groups.items()}, name)
        kept = judged.where(F.col("mask") == 1).select(*[F.col(c).alias(f"_{c}") for c in ("owner", "person_id", "start_date", "end_date")])
        same = ((F.col("query") == F.col("_owner")) & (F.col("person_id") == F.col("_person_id"))
                & (F.col("start_date") == F.col("_start_date")) & F.col("end_date").eqNullSafe(F.col("_end_date")))
        return events.join(kept, same, "left_semi")

    def evaluate(self, index: DataFrame, groups: Mapping[int, Sequence[Group]], name: str) -> DataFrame:
        """Add ``mask``: bit ``k`` is set where the owner's ``k``-th group holds.

        All criteria of all owners are counted together. Equal criteria of different
        owners share their facts, and so do different windows over the same events.
        """
        index = self.keep(f"criteria/{name}", index)
        columns = index.columns
        wanted = {o: list({c: None for g in own for c in criteria_of(g)}) for o, own in groups.items()}
        criteria = list({c: None for own in wanted.values() for c in own})
        number = {c: i for i, c in enumerate(criteria)}
        if criteria:
            hits = self._hits(index, wanted, criteria, number, name)
            # Corners that meet no event have no part: these events have a row all the same.
            bare = [o for o, own in wanted.items() if all(c.by_corners for c in own)]
            if bare:
                hits = hits.unionByName(index.where(F.col("owner").isin(*bare)).withColumns({"criterion": F.lit(-1), "hits": F.lit(0).cast("long")}))
            # Dealt by the index event once, for the sum of each criterion and for the answers of all.
            hits = hits.repartition(*columns).groupBy(*columns, "criterion").agg(F.sum("hits").alias("hits"))
            least = F.element_at(F.create_map(*[F.lit(x) for c in criteria for x in (number[c], c.at_least if c.exactly is None else c.exactly)]), F.col("criterion"))
            exact = F.col("criterion").isin(*[number[c] for c in criteria if c.exactly is not None])
            held = F.when(exact, F.col("hits") == least).otherwise(F.col("hits") >= least)
            index = hits.groupBy(*columns).agg(*[
                F.bit_or(F.when(held & F.col("criterion").isin(*range(k, k + _WORD)), _bit(F.col("criterion") - k)).otherwise(0)).alias(f"_held_{k // _WORD}")
                for k in range(0, len(criteria), _WORD)
            ])
        found = [leaf for own in groups.values() for g in own for leaf in leaves(g)]
        if any(isinstance(leaf, Demographic) and leaf.needs_person for leaf in found):
            index = index.join(self.store.cdm["person"].select("person_id", "year_of_birth", "gender_concept_id"), "person_id", "left")

        def answer(member) -> Column:
            if isinstance(member, Group):
                return member.satisfied(answer)
            if isinstance(member, Demographic):
                return member.satisfied()
            word, place = divmod(number[member], _WORD)
            return F.col(f"_held_{word}").bitwiseAND(F.lit(1 << place)) != 0

        mask = F.lit(0).cast("long")
        for owner, own in groups.items():
            bits = F.lit(0).cast("long")
            for k, group in enumerate(own):
                bits = bits.bitwiseOR(F.shiftleft(group.satisfied(answer).cast("long"), k))
            mask = F.when(F.col("owner") == owner, bits).otherwise(mask)
        return index.select(*columns, mask.alias("mask"))

    def _hits(self, index: DataFrame, wanted: Mapping[int, Sequence[Criterion]], criteria: Sequence[Criterion], number: Mapping[Criterion, int], name: str) -> DataFrame:
        """``criterion, hits`` of the index events: parts whose sums are the hits; a criterion that no event meets may have none."""
        sources = list({_source(c): None for c in criteria})
        place = {c: F.lit(sources.index(_source(c))) for c in criteria}
        columns, found = index.columns, []

        def asked(kind: Callable[[Criterion], bool], points: Callable[[list[Criterion]], Column]) -> DataFrame:
            """Index events once per point of their owner's criteria of a kind."""
            array = None
            for owner, own in wanted.items():
                some = [c for c in own if kind(c)]
                if some:
                    mine = F.col("owner") == owner
                    array = F.when(mine, points(some)) if array is None else array.when(mine, points(some))
            return index.withColumn("_ask", F.explode(array)).select(*columns, "_ask.*")

        if any(map(_by_scan, criteria)):
            points = asked(_by_scan, lambda own: F.array(*[p for c in own for p in scan_points(number[c], c, source=place[c])]))
            keys = ["person_id", "source", "op_start", "op_end"]
            seen = scan_days(points, self._scan_facts(sources), keys, {"n": "sum", "reach": "max"}, spread=keys)
            # A criterion by reach has one point: whether it is reached.
            reached = F.coalesce(F.col("reach") >= F.col("need"), F.lit(False)).cast("long")
            by_reach = F.col("criterion").isin(*[number[c] for c in criteria if c.by_reach])
            counted = F.col("sign") * F.coalesce("n", F.lit(0))
            found.append(seen.select(*columns, "criterion", F.when(by_reach, reached).otherwise(counted).alias("hits")))
        if any(c.by_corners for c in criteria):
            cornered = lambda c: c.by_corners
            # A criterion that meets no event has no part below; where zero is asked for, it counts zero.
            zero = F.lit(0).cast("long").alias("hits")
            meant = lambda c: c.by_corners and c.satisfied_by_none
            if any(map(meant, criteria)):
                found.append(asked(meant, lambda own: F.array(*[F.struct(F.lit(number[c]).alias("criterion"), zero) for c in own])))
            points = asked(cornered, lambda own: F.flatten(F.array(*[corners(number[c], c, source=place[c]) for c in own])))
            # Ranks, runs and points all read the facts: they are found once.
            facts = self.keep(f"criteria/{name}-corners", self._corner_facts(sources))
            parts = count_dominated(points, facts, ["person_id", "source"])
            found.append(parts.select(*columns, "criterion", (F.col("sign") * F.col("n")).alias("hits")))
        for c in criteria:
            if c.by_pairs:
                owners = [o for o, own in wanted.items() if c in own]
                given = replace(c, events=_Matched(self._of_sources([_source(c)], ["pairs"])))
                counted = count_by_pairs(self.store.cdm, None, index.where(F.col("owner").isin(*owners)), given, "hits")
                found.append(counted.withColumn("criterion", F.lit(number[c])).select(*columns, "criterion", "hits"))
        together = found[0]
        for part in found[1:]:
            together = together.unionByName(part)
        return together

    def _of_sources(self, sources: Sequence[tuple], kinds: Sequence[str]) -> DataFrame:
        """Events that count for the sources of some kinds, with the number of the source; those without a concept do not.

        Only what these kinds ask is read, and only their nested queries are judged.
        """
        chosen = [(i, query) for i, (query, kind) in enumerate(sources) if kind in kinds]
        queries = list({query: None for _, query in chosen})
        found = self.store.matched(queries, self.judge).where(F.col("target_concept_id").isNotNull())
        return found.join(small_table(self.store.cdm.spark, [(queries.index(q), i) for i, q in chosen], "query int, source int"), "query")

    def _scan_facts(self, sources: Sequence[tuple]) -> DataFrame:
        """Counts and latest ends per source, person and day."""
        columns = ["person_id", "source", "op_start", "op_end", F.col("start_date").alias("day"), "end_date"]
        none, kinds, parts = F.lit(None).cast("date"), {kind for _, kind in sources}, []
        if "count" in kinds:
            parts.append(self._of_sources(sources, ["count"]).withColumns({"op_start": none, "op_end": none}).select(*columns))
        if kinds & {"reach", "reach observed"}:
            seen = self._of_sources(sources, ["reach", "reach observed"]).select("person_id", "source", "start_date", "end_date")
            seen = in_observation(seen, self.store.cdm["observation_period"])
            within = [i for i, (_, kind) in enumerate(sources) if kind == "reach observed"]
            seen = seen.where(~F.col("source").isin(*within) | (F.col("end_date") <= F.col("op_end_date")))
            parts.append(seen.withColumns({"op_start": F.col("op_start_date"), "op_end": F.col("op_end_date")}).select(*columns))
        together = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return together.groupBy("person_id", "source", "op_start", "op_end", "day").agg(F.count("*").alias("n"), F.max("end_date").alias("reach"))

    def _corner_facts(self, sources: Sequence[tuple]) -> DataFrame:
        """Starts by ends, and occurrences by the previous ones of their concept."""
        kinds, parts = {kind for _, kind in sources}, []
        if "ends" in kinds:
            spans = self._of_sources(sources, ["ends"]).where(F.col("end_date").isNotNull())
            parts.append(spans.groupBy("person_id", "source", F.col("start_date").alias("day"), F.unix_date("end_date").cast("long").alias("y")).agg(F.count("*").alias("n")))
        if "concepts" in kinds:
            seen = self._of_sources(sources, ["concepts"])
            seen = seen.select("person_id", "source", F.col("target_concept_id").alias("concept"), F.col("start_date").alias("day"))
            parts.append(with_previous(seen, ["person_id", "source"], BEFORE_ALL))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _by_scan(c: Criterion) -> bool:
    return not c.by_corners and not c.by_pairs


def _source(c: Criterion) -> tuple:
    """What a criterion counts: criteria that agree in it share their facts."""
    if c.by_reach:
        return c.events, "reach observed" if c.window.ends_in_observation else "reach"
    if c.by_corners:
        return c.events, "concepts" if c.distinct else "ends"
    return c.events, "pairs" if c.by_pairs else "count"


@dataclass(frozen=True)
class _Matched:
    """Matched rows in the place of an event query."""

    rows: DataFrame

    def frame(self, cdm, codes=None) -> DataFrame:
        return self.rows


def build_cohorts(cdm: Cdm, specs: Sequence[CohortSpec], keep: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
    """Rows of many cohorts, each clinical table read once; ``keep`` stores the tables between the steps.

    The rows are those of ``build_cohort`` for every definition. Their numbers
    must differ. No definition gives no row.

    Whatever a step asks stays within a person. Large tables are therefore stored
    once by slices of persons, and slices are taken in rounds, so that the steps of
    one round are on disk at a time. ``keep.drop(name)``, if there is one, removes
    the tables of a round when its cohorts are stored.
    """
    if len({s.cohort_id for s in specs}) < len(specs):
        raise ValueError("two definitions share a cohort id")
    if not specs:
        return small_table(cdm.spark, [], TABLES["cohort"])
    rounds = _rounds(cdm, specs)
    return Batch(EventStore(cdm, specs, keep)).cohorts() if rounds == 1 else _in_rounds(cdm, specs, keep, rounds)


def _rounds(cdm: Cdm, specs: Sequence[CohortSpec]) -> int:
    """One where the tables are small, or where definitions read events that no domain holds."""
    if not all(isinstance(q, Events) for q in queries_of(specs)):
        return 1
    held = sum(scanned_bytes(cdm[DOMAINS[name].table]) for name in domains_of(specs))
    return max(1, min(SLICES, -(-held // ROUND_BYTES)))


def _in_rounds(cdm: Cdm, specs: Sequence[CohortSpec], keep: Callable[[str, DataFrame], DataFrame], rounds: int) -> DataFrame:
    drop = getattr(keep, "drop", lambda name: None)
    tags = resolved(cdm, share_codesets(specs)[1], keep)
    events = {DOMAINS[name].table: DOMAINS[name].event_id for name in domains_of(specs)}
    sliced = {}
    for name in sorted({*events, "observation_period", "person"}):
        rows = cdm[name] if events.get(name) == "visit_occurrence_id" else cdm[name].drop("visit_occurrence_id")
        # Sorted, so that a round reads its pages of a file and no others.
        rows = rows.withColumn("_slice", F.pmod(F.xxhash64("person_id"), F.lit(SLICES)).cast("int")).sortWithinPartitions("_slice")
        sliced[name] = keep(f"slices/{name}", rows)
    parts = []
    for k in range(rounds):
        low, high = k * SLICES // rounds, (k + 1) * SLICES // rounds - 1
        own = {name: rows.where(F.col("_slice").between(low, high)).drop("_slice") for name, rows in sliced.items()}
        store = EventStore(cdm.with_tables(**own), specs, lambda name, df, k=k: keep(f"round-{k}/{name}", df), tags)
        parts.append(keep(f"cohorts/{k}", Batch(store).cohorts()))
        drop(f"round-{k}")
    drop("slices")
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return together
