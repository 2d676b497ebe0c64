"""Sources and sinks, results, and questions about results."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.operators import compare, results
from cohortry.operators.censor import cohort_counts
from cohortry.operators.diagnostics import (
    incidence_rate,
    included_source_concepts,
    index_event_breakdown,
    orphan_concepts,
    time_distributions,
)
from cohortry.operators.events import Events
from cohortry.operators.vocabulary import Codesets, concept_set, concepts
from cohortry.plans.cohort import inclusion_result, rule_stats, summary_stats
from cohortry.session import small_table
from cohortry.sources.cdm import Cdm
from cohortry.plans.settings import study_from_settings
from cohortry.sources.merge import database_info, merge_sites, remap_database
from cohortry.sources.network import merge_chain
from cohortry.sources.settings import inclusion_stats, read_settings
from cohortry.sources.sinks import (
    checksum,
    exclude_cohorts,
    pending_tasks,
    read_cohorts,
    record_tasks,
    upsert,
    write_cohort,
    write_cohorts,
    write_results,
)
from contract.cohort_queries import ALL_INDEX, MASK_SQL, RULES, SET_SQL, SETS, in_folder, spec
from contract.events_queries import EVENT_SQL
from contract.registry import query
from contract.strata_queries import (
    ALL_SQL,
    BULK,
    COHORT_STRATA,
    COUNTS_SQL,
    FORMATTED_SQL,
    TARGETS,
    XREF_SQL,
    all_staging,
    formatted,
    settings,
    values,
    xref,
)
from contract.views import PART

SITES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]

# --- Sources and sinks ------------------------------------------------------------------------


@query("io1_read_cdm", """
    select v.visit_occurrence_id, v.person_id, v.visit_start_date, v.visit_end_date, p.year_of_birth
    from visit_occurrence v join person p on p.person_id = v.person_id""")
def _(s):
    folder = s.scratch()
    for table in ("visit_occurrence", "person"):
        s.cdm[table].write.parquet(f"{folder}/{table}")
    stored = Cdm.parquet(s.spark, folder)
    return stored["visit_occurrence"].join(stored["person"], "person_id").select(
        "visit_occurrence_id", "person_id", "visit_start_date", "visit_end_date", "year_of_birth")


@query("io2_read_settings", "select c_name as name, cast(null as string) as full_name, c_custkey % 10 as tool_id, c_custkey as cohort_id from customer")
def _(s):
    folder = s.scratch()
    rows = s.table("customer").select(F.col("c_name").alias("name"), F.lit("NA").alias("fullName"),
                                      (F.col("c_custkey") % 10).alias("toolId"), F.col("c_custkey").alias("cohortId"))
    rows.write.csv(folder, header=True)
    return read_settings(s.spark, folder, "cohort_settings")


@query("io3_inclusion_of_cohort", "select * from staging where cohort_definition_id = 202")
def _(s):
    return inclusion_stats(s.staging, 202)


@query("io4_replace_cohorts", """
    select * from staging where cohort_definition_id = 201 union all
    select 102, subject_id, cohort_start_date, cohort_end_date from staging where cohort_definition_id = 302""")
def _(s):
    folder = s.scratch()
    write_cohorts(s.staging, folder, [101, 102, 201])
    other = s.staging.where("cohort_definition_id = 302").withColumn("cohort_definition_id", F.lit(102).cast("long"))
    write_cohort(other, folder, 102)
    # An empty result clears the cohort.
    write_cohort(s.staging.where("cohort_definition_id = 0"), folder, 101)
    return read_cohorts(s.spark, folder)


@query("io5_write_results", "select cohort_id, cohort_entries, cohort_subjects, database_id from site_count")
def _(s):
    folder = s.scratch()
    counts = s.view("site_count")
    write_results(counts, folder)
    return s.spark.read.csv(folder, schema=counts.schema, header=True)


@query("io6_upsert", """
    with newer as (select cohort_id, covariate_id, mean + 1 as mean, database_id from site_value where covariate_id % 2 = 1)
    select cohort_id, covariate_id, mean, sd, database_id from site_value v where not exists (select 1 from newer n
        where n.cohort_id = v.cohort_id and n.covariate_id = v.covariate_id and n.database_id = v.database_id)
    union all select cohort_id, covariate_id, mean, null, database_id from newer""")
def _(s):
    old = s.view("site_value")
    new = old.where("covariate_id % 2 = 1").select("cohort_id", "covariate_id", (F.col("mean") + 1).alias("mean"),
                                                   "database_id")
    return upsert(old, new, ["cohort_id", "covariate_id", "database_id"])


def tasks(s):
    """One task per customer, whose definition is the customer's segment."""
    return s.table("customer").select(F.col("c_custkey").alias("cohort_id"), F.lit("characterize").alias("task"),
                                      checksum(F.col("c_mktsegment")).alias("checksum"))


def ledger(s):
    """Two thirds of the tasks are recorded, every fifth with an older definition."""
    older = F.when(F.col("cohort_id") % 5 == 0, checksum("older")).otherwise(F.col("checksum"))
    return tasks(s).where("cohort_id % 3 <> 0").withColumn("checksum", older).withColumn(
        "time_stamp", F.lit("2020-01-01 00:00:00").cast("timestamp"))


query("io7_pending_tasks", """
    select c_custkey as cohort_id, 'characterize' as task, md5(c_mktsegment) as checksum from customer
    where c_custkey % 3 = 0 or c_custkey % 5 = 0""")(lambda s: pending_tasks(tasks(s), ledger(s)))


@query("io8_record_tasks", """
    select c_custkey as cohort_id, 'characterize' as task,
           md5(case when c_custkey % 3 <> 0 and c_custkey % 5 = 0 and c_custkey % 4 <> 0 then 'older' else c_mktsegment end)
               as checksum,
           c_custkey % 4 = 0 as is_new
    from customer where c_custkey % 3 <> 0 or c_custkey % 4 = 0""")
def _(s):
    recorded = record_tasks(ledger(s), tasks(s).where("cohort_id % 4 = 0"))
    return recorded.withColumn("is_new", F.col("time_stamp") > F.lit("2021-01-01").cast("timestamp")).drop("time_stamp")


query("io9_exclude_cohorts", "select * from site_count where cohort_id not in (101, 202)")(
    lambda s: exclude_cohorts(s.view("site_count"), [101, 202]))
query("io10_database_info", """
    select 'given' as database_id, 'Given tables' as database_name, 'Orders as conditions' as description,
           vocabulary_version, 0 as is_meta_analysis from vocabulary where vocabulary_id = 'None'""")(
    lambda s: database_info(s.cdm, "given", "Given tables", "Orders as conditions"))


def site_tables(s):
    table = s.view("site_count")
    return [table.where(F.col("database_id") == site) for site in SITES]


@query("io11_merge_strict", "select * from site_count")
def _(s):
    tables = site_tables(s)
    turned = tables[1].select("database_id", "cohort_subjects", "cohort_entries", "cohort_id")
    return merge_sites([tables[0], turned, *tables[2:]], strict=True)


@query("io12_merge_lenient", """
    select cohort_id, cohort_entries, cohort_subjects, database_id from site_count where database_id = 'AFRICA'
    union all
    select cohort_id, null, cohort_subjects, database_id from site_count where database_id <> 'AFRICA'""")
def _(s):
    tables = site_tables(s)
    others = [t.drop("cohort_entries").withColumn("cohort_id", F.col("cohort_id").cast("string"))
              .withColumn("surplus", F.lit(1)) for t in tables[1:]]
    return merge_sites([tables[0], *others], strict=False)


query("io13_remap_database", """
    select cohort_id, case when database_id = 'ASIA' then 'STARR-OMOP' else database_id end as database_id from site_count""")(
    lambda s: remap_database(s.view("site_count").select(
        "cohort_id", F.when(F.col("database_id") == "ASIA", "DEID_Lite").otherwise(F.col("database_id"))
        .alias("database_id"))))

# --- Results ----------------------------------------------------------------------------------

query("r1_min_cell", """
    select cohort_id, case when cohort_entries < 600 and cohort_entries <> 0 then -600 else cohort_entries end
               as cohort_entries,
           case when cohort_subjects < cohort_id * 2 and cohort_subjects <> 0 then -2 * cohort_id
                else cohort_subjects end as cohort_subjects,
           database_id from site_count""")(
    lambda s: results.enforce_min_cell(
        results.enforce_min_cell(s.view("site_count"), "cohort_entries", 600)
        .withColumn("_least", F.col("cohort_id") * 2), "cohort_subjects", "_least").drop("_least"))

VALUE_SQL = f"""select cohort_id, covariate_id, round_even(m, 3) as mean,
        round_even(case when m < 0 then null else sd end, 3) as sd, 'here' as database_id
    from (select f.cohort_id, f.covariate_id, f.sd, case when f.mean < 40.0 / c.cohort_entries and f.mean <> 0
            then -(40.0 / c.cohort_entries) else f.mean end as m
          from ({FORMATTED_SQL}) f join ({COUNTS_SQL}) c on c.cohort_id = f.cohort_id) v"""
query("r2_covariate_values", VALUE_SQL)(
    lambda s: results.covariate_values(formatted(s), cohort_counts(s.staging), 40, "here"))
query("r3_covariate_list", f"""
    select distinct covariate_id, covariate_name, analysis_id as covariate_analysis_id from ({FORMATTED_SQL}) f
    where round_even(mean, 4) <> 0""")(lambda s: results.covariate_list(formatted(s)))
query("r4_distinct_values", "select * from site_value")(
    lambda s: results.distinct_rows(s.view("site_value").unionByName(s.view("site_value"))))


def study_cohorts(s):
    rows = [(n, i, "target") for n, i in TARGETS] + [(n, i, "strata") for n, i in COHORT_STRATA]
    return small_table(s.spark, rows, "name string, cohort_id long, cohort_type string")


STUDY_SQL = values([(n, i, "target") for n, i in TARGETS] + [(n, i, "strata") for n, i in COHORT_STRATA],
                   "name, cohort_id, cohort_type")
EXPORT_SQL = f"""select cohort_id, name as cohort_name, name as cohort_full_name, cohort_type from (
        select cohort_id, name, cohort_type from {STUDY_SQL} c union all
        select cohort_id, name, cohort_type from {XREF_SQL} x) y
    where cohort_id in (select cohort_definition_id from {ALL_SQL} a where cohort_start_date >= date '1999-01-01')"""


def exported(s):
    # Only cohorts with rows since 1999: the stratum of spring 1998 has none.
    counts = cohort_counts(all_staging(s).where("cohort_start_date >= date '1999-01-01'"))
    return results.cohorts_for_export(study_cohorts(s), xref(s), counts)


query("r5_cohorts_for_export", EXPORT_SQL)(exported)
query("r5_with_target_and_strata", f"""
    select e.*, coalesce(x.target_id, e.cohort_id) as target_id, coalesce(x.strata_id, 0) as strata_id
    from ({EXPORT_SQL}) e left join {XREF_SQL} x on x.cohort_id = e.cohort_id""")(
    lambda s: results.with_target_and_strata(exported(s), xref(s)))


ALL_STRATA = [(row[1], row[6]) for row in BULK] + COHORT_STRATA


@query("r5_cohorts_with_details", f"""
    select d.*, n.entries from (
        select cohort_id, name as cohort_name, cohort_id as target_id, name as target_name, 0::bigint as strata_id,
               'All' as strata_name, cohort_type from {STUDY_SQL} c
        union all
        select x.cohort_id, x.name, x.target_id, t.name, x.strata_id, s.name, x.cohort_type from {XREF_SQL} x
        join {values(TARGETS, 'name, id')} t on t.id = x.target_id
        join {values(ALL_STRATA, 'name, id')} s on s.id = x.strata_id) d
    join (select cohort_definition_id, count(*) as entries from staging group by all) n
        on n.cohort_definition_id = d.target_id""")
def _(s):
    details = results.cohorts_with_details(study_cohorts(s), xref(s), settings(s, ALL_STRATA))
    sizes = s.staging.groupBy(F.col("cohort_definition_id").alias("target_id")).agg(F.count("*").alias("entries"))
    return details.join(sizes, "target_id")


RULE_NAMES = ["near a drug", "without another", "visit or low"]


@query("r6_attrition", f"""
    with masked as (select *, {MASK_SQL} as mask from {ALL_INDEX} p),
    best as (select mask, count(*) as n from (select *, row_number() over (partition by person_id
        order by bit_count(mask) desc, start_date, tie, end_date, op_start_date) as place from masked) b
        where place = 1 group by mask)
    select cast(r.k as int) as rule_sequence_id, r.name as rule_name,
           (select coalesce(sum(n), 0) from best where (mask >> r.k) & 1 = 1)::bigint as meet_subjects,
           (select coalesce(sum(n), 0) from best where mask = 7 - (1 << r.k))::bigint as gain_subjects,
           (select sum(n) from best)::bigint as total_subjects,
           (select coalesce(sum(n), 0) from best where mask & ((2 << r.k) - 1) = (2 << r.k) - 1)::bigint as remain_subjects
    from {values(list(enumerate(RULE_NAMES)), 'k, name')} r""")
def _(s):
    found = inclusion_result(s.cdm, spec(inclusion_rules=RULES))
    rules = small_table(s.spark, [(1, i, n) for i, n in enumerate(RULE_NAMES)],
                        "cohort_definition_id long, rule_sequence int, name string")
    stats = rule_stats(found, len(RULES))
    return results.attrition(rules, stats, found)


_BEST_SQL = f"""
    with masked as (select *, {MASK_SQL} as mask from {ALL_INDEX} p),
    counted as (select mask, 1 as mode_id, count(distinct person_id) as n from masked group by mask
        union all select mask, 0, count(*) from (select *, row_number() over (partition by person_id
            order by bit_count(mask) desc, start_date, tie, end_date, op_start_date) as place from masked) b
        where place = 1 group by mask)"""
query("r7_inclusion_stats", f"""{_BEST_SQL}
    select {spec().cohort_id}::bigint as cohort_definition_id, cast(r.k as int) as rule_sequence, mode_id,
           sum(case when (mask >> r.k) & 1 = 1 then n else 0 end)::bigint as person_count,
           sum(case when mask = 7 - (1 << r.k) then n else 0 end)::bigint as gain_count, sum(n)::bigint as person_total
    from counted, {values(list(enumerate(RULE_NAMES)), 'k, name')} r group by r.k, mode_id""")(
    lambda s: rule_stats(inclusion_result(s.cdm, spec(inclusion_rules=RULES)), len(RULES)))
query("r7_summary_stats", f"""{_BEST_SQL}
    select {spec().cohort_id}::bigint as cohort_definition_id, mode_id, sum(n)::bigint as base_count,
           sum(case when mask = 7 then n else 0 end)::bigint as final_count
    from counted group by mode_id""")(
    lambda s: summary_stats(inclusion_result(s.cdm, spec(inclusion_rules=RULES)), len(RULES)))


query("r8_dedupe_covariates", """
    select covariate_id, min(covariate_name) as covariate_name, min(covariate_analysis_id) as covariate_analysis_id,
           cast(right(cast(covariate_id as string), 1) as int) as time_window_id
    from site_covariate group by covariate_id""")(lambda s: results.dedupe_covariates(s.view("site_covariate")))


query("r9_clean_covariates", """
    with ranked as (
        select c.*, case when count(*) over (partition by covariate_id) = 1 then 1
                         when covariate_name ilike 'cohort%' and covariate_analysis_id = 10000 then 2
                         when covariate_id in (select covariate_id from site_mark where mark = 'ASCII') then 3 end as priority
        from site_covariate c)
    select distinct covariate_id, covariate_name, covariate_analysis_id,
           cast(right(cast(covariate_id as string), 1) as int) as time_window_id
    from (select *, min(priority) over (partition by covariate_id) as best from ranked) r where priority = best""")(
    lambda s: results.clean_covariates(s.view("site_covariate"), s.view("site_mark")))
query("r10_covariate_coverage", """
    select (select count(distinct covariate_id) from site_covariate) as covariates,
           (select count(distinct covariate_id) from site_mark) as marked,
           (select count(distinct covariate_id) from site_covariate where covariate_id not in
               (select covariate_id from site_mark)) as unmarked""")(
    lambda s: results.covariate_coverage(s.view("site_covariate"), s.view("site_mark")))
query("r11_fix_covariate_names", """
    select covariate_id, covariate_analysis_id, case when covariate_id between 200031 and 380031
            and (covariate_id - 200031) % 10000 = 0
        then 'age group: ' || (5 * (covariate_id - 31) // 10000) || '-' || (5 * (covariate_id - 31) // 10000 + 4)
        else covariate_name end as covariate_name
    from (select distinct covariate_id, lower(covariate_name) as covariate_name, covariate_analysis_id
          from site_covariate) c""")(lambda s: results.fix_covariate_names(s.view("site_covariate")))
query("r12_distinct_cohort_names", """
    select distinct c_mktsegment as cohort_name, c_mktsegment as cohort_full_name, c_custkey % 7 as cohort_id from customer""")(
    lambda s: results.distinct_cohort_names(s.table("customer").select(
        F.col("c_mktsegment").alias("cohort_name"), F.col("c_mktsegment").alias("cohort_full_name"),
        (F.col("c_custkey") % 7).alias("cohort_id"), F.col("c_acctbal").alias("surplus"))))
query("r13_typed_cohort_xref", "select * from site_xref")(
    lambda s: results.typed_cohort_xref(s.view("site_xref").select(
        *[F.col(c).cast("string").alias(c) for c in ("cohort_id", "target_id", "strata_id")],
        "target_name", "strata_name", "cohort_type")))
# Five sites deliver: one has every count twice, one a column too many; the other three are merged and named.
def deliveries(s) -> dict:
    # Deliveries are files.
    keep, found = in_folder(s, s.scratch()), {}
    counts, covariates, values_ = (keep(name, s.view(name)) for name in ("site_count", "site_covariate", "site_value"))
    for site in SITES:
        mine = F.col("database_id") == site
        region = s.table("region").where(F.col("r_name") == site)
        tables = {
            "database": region.select(F.col("r_name").alias("database_id"), F.col("r_name").alias("database_name"), F.lit("").alias("description"),
                                      F.lit("v1").alias("vocabulary_version"), F.lit(0).alias("is_meta_analysis")),
            "cohort_count": counts.where(mine), "covariate": covariates, "covariate_value": values_.where(mine),
        }
        if site == "ASIA":
            tables["cohort_count"] = tables["cohort_count"].unionByName(tables["cohort_count"])
        if site == "EUROPE":
            tables["covariate_value"] = tables["covariate_value"].withColumn("note", F.lit("x"))
        found[site] = tables
    return found


@query("merge_chain", """
    select v.cohort_id, v.covariate_id, n.covariate_name, n.time_window_id, v.mean, v.database_id, c.cohort_subjects
    from site_value v join site_count c on c.cohort_id = v.cohort_id and c.database_id = v.database_id
    join (select covariate_id, cast(right(cast(covariate_id as string), 1) as int) as time_window_id,
                 min(case when covariate_id between 200031 and 380031 and (covariate_id - 200031) % 10000 = 0
                     then 'age group: ' || (5 * (covariate_id - 31) // 10000) || '-' || (5 * (covariate_id - 31) // 10000 + 4)
                     else lower(covariate_name) end) as covariate_name
          from site_covariate group by covariate_id) n on n.covariate_id = v.covariate_id
    where v.database_id not in ('ASIA', 'EUROPE')""")
def _(s):
    merged = merge_chain(s.spark, deliveries(s))
    named = merged["covariate_value"].join(merged["covariate"], "covariate_id")
    counted = named.join(merged["cohort_count"].select("cohort_id", "database_id", "cohort_subjects"), ["cohort_id", "database_id"])
    return counted.select("cohort_id", "covariate_id", "covariate_name", "time_window_id", "mean", "database_id", "cohort_subjects")


query("merge_chain_quarantine", """
    select 'ASIA' as site, 'cohort_count' as table_name, count(*) || ' keys (cohort_id, database_id) stand more than once' as reason
    from site_count where database_id = 'ASIA'
    union all select r_name, 'covariate_value', 'columns differ: note' from region where r_name = 'EUROPE'""")(
    lambda s: merge_chain(s.spark, deliveries(s))["quarantine"])


# A settings folder made of the nations: two target groups by region, strata and features; one cohort is left out.
@query("study_from_settings", """
    select case n_regionkey when 0 then 'target' when 2 then 'strata' else 'feature' end as role, 100 + n_nationkey as cohort_id, n_name as name
    from nation where n_regionkey in (0, 2, 3) and n_nationkey <> 5
    union all select 'bulk', cast(3 as bigint), 'Sex = Female' from region where r_regionkey = 0
    union all select 'window', cast(1 as bigint), '-365 to -1 overlap' from region where r_regionkey = 0""")
def _(s):
    folder, nation = s.scratch(), s.table("nation")
    groups = {0: "covid", 1: "influenza", 2: "strata", 3: "feature"}
    listed = [(name, f"settings/{name}.csv", key < 2) for key, name in groups.items()]

    def write(df, name):
        df.coalesce(1).write.csv(f"{folder}/{name}", header=True, nullValue="NA")

    write(small_table(s.spark, listed, "cohortGroup string, fileName string, userCanSelect boolean"), "CohortGroups.csv")
    for key, name in groups.items():
        rows = nation.where(F.col("n_regionkey") == key)
        write(rows.select(F.col("n_name").alias("name"), F.col("n_name").alias("atlasName"), F.col("n_nationkey").alias("atlasId"), (F.col("n_nationkey") + 100).alias("cohortId")), f"{name}.csv")
    write(small_table(s.spark, [("strata/StratifyByGender.sql", "Sex = Female", "=", "8532", None, None, 3)],
                      "generationScript string, name string, lbOperator string, lbStrataValue string, ubOperator string, ubStrataValue string, cohortId long"), "BulkStrata.csv")
    write(small_table(s.spark, [(1, -365, -1, "overlap")], "windowId int, windowStart int, windowEnd int, windowType string"), "featureTimeWindows.csv")
    study = study_from_settings(s.spark, folder, {i: spec(cohort_id=i) for i in range(100, 200)}, groups={"covid"}, exclude={105})
    roles = [("target", study.targets), ("strata", study.strata_cohorts), ("feature", study.features)]
    found = [(role, c.cohort_id, study.names[c.cohort_id]) for role, specs in roles for c in specs]
    found += [("bulk", b.strata_id, b.name) for b in study.bulk_strata] + [("window", w.window_id, f"{w.start} to {w.end} {w.kind}") for w in study.windows]
    return small_table(s.spark, found, "role string, cohort_id long, name string")


# All five result tables by their keys, and the covariates by the key they need once sites are merged.
KEYED = [
    ("cohort", "site_xref", "cohort_id"), ("cohort_count", "site_count", "cohort_id, database_id"),
    ("covariate", "site_covariate", "covariate_id, covariate_name"), ("covariate_merged", "site_covariate", "covariate_id"),
    ("covariate_value", "site_value", "cohort_id, covariate_id, database_id"), ("database", "region", "r_name"),
]


@query("r14_duplicate_keys", " union all ".join(
    f"select '{name}' as table_name, count(*) as duplicated from (select {keys} from {view} group by {keys} having count(*) > 1) d_{name}"
    for name, view, keys in KEYED))
def _(s):
    found = None
    for name, view, _ in KEYED:
        merged = name.endswith("_merged")
        keys = results.MERGED_KEYS["covariate"] if merged else results.PRIMARY_KEYS[name]
        table = s.table(view).withColumnRenamed("r_name", "database_id") if view == "region" else s.view(view)
        part = results.duplicate_keys(table, keys).agg(F.count("*").alias("duplicated")).select(F.lit(name).alias("table_name"), "duplicated")
        found = part if found is None else found.unionByName(part)
    return found

# --- Questions --------------------------------------------------------------------------------

WINDOWED_SQL = """(select distinct covariate_id, lower(covariate_name) as covariate_name, covariate_analysis_id,
    cast(right(cast(covariate_id as string), 1) as int) as time_window_id from site_covariate)"""


def windowed(s):
    return s.view("site_covariate").select(
        "covariate_id", F.lower("covariate_name").alias("covariate_name"), "covariate_analysis_id",
        F.right(F.col("covariate_id").cast("string"), F.lit(1)).cast("int").alias("time_window_id")).distinct()


query("q1_values_of_cohorts", """
    select * from site_value where cohort_id in (101, 102) and database_id in ('ASIA', 'EUROPE')""")(
    lambda s: compare.values_of(s.view("site_value"), [101, 102], ["ASIA", "EUROPE"]))
for _domain, _range in {"All": "1 and 10000", "Cohort": "10000 and 10000", "Demographics": "1 and 99", "Drug": "412 and 412",
                        "Condition": "212 and 212"}.items():
    query(f"q2_filter_{_domain.lower()}", f"""
        select * from {WINDOWED_SQL} c where time_window_id in (1, 3) and covariate_analysis_id between {_range}""")(
        lambda s, domain=_domain: compare.filter_covariates(windowed(s), [1, 3], domain))
query("q3_cohort_counts", """
    select x.*, c.cohort_entries, c.cohort_subjects, c.database_id from site_xref x join site_count c
        on c.cohort_id = x.cohort_id where c.cohort_id in (101, 102, 301) and c.database_id <> 'ASIA'""")(
    lambda s: compare.cohort_count_table(s.view("site_count"), s.view("site_xref"), [101, 102, 301],
                                         [d for d in SITES if d != "ASIA"]))


def pivot_sql(value: str, sites) -> str:
    return ", ".join(f"max(case when database_id = '{d}' then {value} end) as \"{value}_{d}\"" for d in sites)


query("q4_counts_by_database", f"""
    select x.cohort_id, target_id, target_name, strata_id, strata_name, cohort_type, {pivot_sql('cohort_subjects', SITES)}
    from site_xref x join site_count c on c.cohort_id = x.cohort_id group by all""")(
    lambda s: compare.counts_by_database(s.view("site_count"), s.view("site_xref"), SITES))

TABLE_SQL = f"""(select v.cohort_id, 'urgent' as cohort_name, v.covariate_id, c.covariate_name, c.covariate_analysis_id,
        c.time_window_id, v.database_id, v.mean
    from site_value v join {WINDOWED_SQL} c on c.covariate_id = v.covariate_id
    where v.cohort_id = 101 and c.time_window_id in (1, 2) and v.database_id in ('AFRICA', 'ASIA', 'EUROPE'))"""


def characterized(s):
    chosen = compare.filter_covariates(windowed(s), [1, 2])
    return compare.characterization(s.view("site_value"), chosen, 101, "urgent", ["AFRICA", "ASIA", "EUROPE"])


query("q5_characterization", f"select * from {TABLE_SQL} t")(characterized)
# One database reports no counts of the cohort and stays out.
query("q6_characterization_by_database", f"""
    select cohort_id, cohort_name, covariate_id, covariate_name, covariate_analysis_id, time_window_id,
           {pivot_sql('mean', SITES)} from {TABLE_SQL} t group by all""")(
    lambda s: compare.characterization_by_database(characterized(s), s.view("site_count"), list(SITES)))
query("q7_compare_cohorts", f"""
    select c.*, target_mean, target_sd, comparator_mean, comparator_sd,
           sqrt(target_sd * target_sd + comparator_sd * comparator_sd) as sd,
           (comparator_mean - target_mean) / nullif(sqrt(target_sd * target_sd + comparator_sd * comparator_sd), 0)
               as std_diff,
           abs((comparator_mean - target_mean) / nullif(sqrt(target_sd * target_sd + comparator_sd * comparator_sd), 0))
               as abs_std_diff
    from (select coalesce(a.covariate_id, b.covariate_id) as id, a.mean as target_mean, a.sd as target_sd,
                 b.mean as comparator_mean, b.sd as comparator_sd
          from (select * from site_value where cohort_id = 101 and database_id = 'ASIA') a
          full join (select * from site_value where cohort_id = 102 and database_id = 'ASIA') b
              on a.covariate_id = b.covariate_id) m
    join {WINDOWED_SQL} c on c.covariate_id = m.id""")(
    lambda s: compare.compare_cohorts(s.view("site_value"), windowed(s), 101, 102, "ASIA"))
query("q8_characterized_cohorts", """
    select * from site_xref where cohort_id in (select cohort_id from site_count where cohort_subjects >= (select count(*) / 10 from customer))""")(
    lambda s: compare.characterized_cohorts(s.view("site_count"), s.view("site_xref"),
                                            s.table("customer").agg(F.count("*") / 10).scalar()))
query("q8_target_list", "select distinct target_id, target_name from site_xref")(
    lambda s: compare.target_list(s.view("site_xref")))
query("q8_strata_list", "select distinct strata_id, strata_name from site_xref")(
    lambda s: compare.strata_list(s.view("site_xref")))
# Every seventh nation gives a region its terms; there are too few nations for the last region.
query("q9_databases_with_terms", """
    select r_name as database_id, r_regionkey, n.n_name as terms_of_use from region
    left join nation n on n.n_nationkey = r_regionkey * 7""")(
    lambda s: compare.databases_with_terms(
        s.table("region").withColumnRenamed("r_name", "database_id"),
        s.table("nation").join(s.table("region"), F.col("n_nationkey") == F.col("r_regionkey") * 7).select(
            F.col("r_name").alias("database_id"), F.col("n_name").alias("terms_of_use"))))
query("q10_strata_types", "select distinct strata_id, strata_name, cohort_type from site_xref")(
    lambda s: compare.strata_types(s.view("site_xref")))
query("q10_cohorts_of_stratum", "select * from site_xref where strata_id = 2 and cohort_type = 'TwoS'")(
    lambda s: compare.cohorts_of_stratum(s.view("site_xref"), 2, "TwoS"))
query("q10_counts_of_stratum", """
    select x.*, c.cohort_entries, c.cohort_subjects, c.database_id from site_xref x join site_count c
        on c.cohort_id = x.cohort_id where strata_id = 2 and cohort_type = 'TwoS'""")(
    lambda s: compare.counts_of_stratum(s.view("site_xref"), s.view("site_count"), 2, "TwoS"))
query("q10_values_of_stratum", """
    select x.*, v.covariate_id, v.mean, v.sd, v.database_id from site_xref x join site_value v
        on v.cohort_id = x.cohort_id where strata_id = 1 and cohort_type = 'TwS' and v.mean > 0.01""")(
    lambda s: compare.values_of_stratum(s.view("site_xref"), s.view("site_value"), 1, "TwS"))
query("q11_peek", "select * from site_value order by cohort_id, covariate_id, database_id limit 10")(
    lambda s: compare.peek(s.view("site_value"), 10, ["cohort_id", "covariate_id", "database_id"]))
query("q12_definition_links", """
    select c_name as name, case when c_custkey % 2 = 0 then 'https://tool.example/' || c_custkey % 100
        else 'https://code.example/' || c_custkey || '.sql' end as url from customer""")(
    lambda s: compare.definition_links(
        s.table("customer").select(F.col("c_name").alias("name"), (F.col("c_custkey") % 2 == 0).alias("from_tool"),
                                   (F.col("c_custkey") % 100).alias("tool_id"), F.col("c_custkey").alias("cohort_id")),
        "https://tool.example/", "https://code.example/"))

# --- Diagnostics ------------------------------------------------------------------------------

TARGET_ROWS = "(select * from staging where cohort_definition_id in (101, 102))"


def targets(s):
    return s.staging.where(F.col("cohort_definition_id").isin(101, 102))


query("g1_incidence_rate", f"""
    with years as (select o.*, cast(unnest(range(year(observation_period_start_date),
                       year(observation_period_end_date) + 1)) as int) as calendar_year from observation_period o),
    exposed as (select calendar_year, gender_concept_id, cast(floor((calendar_year - year_of_birth) / 10.0) as bigint)
            as age_group,
            sum(least(observation_period_end_date, make_date(calendar_year, 12, 31))
                - greatest(observation_period_start_date, make_date(calendar_year, 1, 1)) + 1)::bigint as person_days
        from years y join person p on p.person_id = y.person_id group by all),
    started as (select c.cohort_definition_id, cast(year(cohort_start_date) as int) as calendar_year, gender_concept_id,
            cast(floor((year(cohort_start_date) - year_of_birth) / 10.0) as bigint) as age_group,
            count(*) as cohort_count
        from {TARGET_ROWS} c join person p on p.person_id = c.subject_id join observation_period o
            on o.person_id = c.subject_id and c.cohort_start_date between o.observation_period_start_date
                and o.observation_period_end_date group by all)
    select c.cohort_definition_id, e.*, coalesce(s.cohort_count, 0) as cohort_count,
        coalesce(s.cohort_count, 0) * 1000 / (e.person_days / 365.25::double) as incidence_rate
    from exposed e cross join (values (101), (102)) c(cohort_definition_id)
    left join started s using (cohort_definition_id, calendar_year, gender_concept_id, age_group)""")(
    lambda s: incidence_rate(s.cdm, targets(s)))
query("g2_time_distributions", f"""
    with days as (
        select c.cohort_definition_id, unnest(['days before index', 'days after index', 'days in cohort']) as time_metric,
            unnest([c.cohort_start_date - o.observation_period_start_date,
                    o.observation_period_end_date - c.cohort_start_date,
                    c.cohort_end_date - c.cohort_start_date]) as days
        from {TARGET_ROWS} c join observation_period o on o.person_id = c.subject_id
            and c.cohort_start_date between o.observation_period_start_date and o.observation_period_end_date)
    select cohort_definition_id, time_metric, count(*) as n, avg(days) as average,
        {", ".join(f"quantile_cont(days::double, {q}) as {name}_days" for name, q in
                   (("min", 0.0), ("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9),
                    ("max", 1.0)))}
    from days group by all""")(lambda s: time_distributions(s.cdm, targets(s)))
query("g3_index_event_breakdown", f"""
    select c.cohort_definition_id, e.domain, e.target_concept_id as concept_id, count(*) as concept_count,
           count(distinct c.subject_id) as concept_subjects
    from {TARGET_ROWS} c join (
        select person_id, start_date, target_concept_id, 'condition' as domain from ({EVENT_SQL['condition']}) a
            where target_concept_id in {SET_SQL[0]}
        union all
        select person_id, start_date, target_concept_id, 'procedure' from ({EVENT_SQL['procedure']}) b
            where target_concept_id in {SET_SQL[2]}) e
        on e.person_id = c.subject_id and e.start_date = c.cohort_start_date group by all""")(
    lambda s: index_event_breakdown(s.cdm, Codesets(s.cdm, SETS), targets(s),
                                    [Events("condition", 0), Events("procedure", 2)]))
query("g4_included_source_concepts", f"""
    select drug_concept_id as concept_id, drug_source_concept_id as source_concept_id, count(*) as concept_count,
           count(distinct person_id) as concept_subjects from drug_exposure where drug_concept_id in {SET_SQL[3]}
    group by all""")(
    lambda s: included_source_concepts(s.cdm, Codesets(s.cdm, SETS)[3], "drug"))
query("g5_orphan_concepts", f"""
    select c.concept_id, c.concept_name, count(*) as concept_count, count(distinct d.person_id) as concept_subjects
    from concept c join drug_exposure d on d.drug_concept_id = c.concept_id
    where (lower(c.concept_name) like '%ring%' or lower(c.concept_name) like '%blue%')
      and c.concept_id not in ({PART + 1}, {PART + 2}, {PART + 3}) group by all""")(
    lambda s: orphan_concepts(
        s.cdm, concept_set(s.cdm, concepts(PART + 1, PART + 2, PART + 3, descendants=False)), ["ring", "Blue"], "drug"))
# As many terms as there are orders' clerks and customers' names end in: each a few characters of some part's name.
TERMS = [a + b for a in "abcdefghijklmnopqrstuvwxyz " for b in "abcdefghijklmnopqrstuvwxyz_#"] + [f"rt#{i}" for i in range(0, 3000, 7)] + ["blue", "GREEN", "m r", "q"]
query("g5_many_terms", f"""
    select c.concept_id, c.concept_name, count(*) as concept_count, count(distinct d.person_id) as concept_subjects
    from concept c join drug_exposure d on d.drug_concept_id = c.concept_id
    where ({" or ".join(f"contains(lower(c.concept_name), '{t.lower()}')" for t in TERMS)}) and c.concept_id <> {PART + 1} group by all""")(
    lambda s: orphan_concepts(s.cdm, concept_set(s.cdm, concepts(PART + 1, descendants=False)), TERMS, "drug"))
query("g6_censored_breakdown", f"""
    select source, case when n < 1000 and n <> 0 then -1000 else n end as n from (
        select drug_source_concept_id as source, count(*) as n from drug_exposure group by all) x""")(
    lambda s: results.enforce_min_cell(
        s.cdm["drug_exposure"].groupBy(F.col("drug_source_concept_id").alias("source")).agg(F.count("*").alias("n")),
        "n", 1000))
