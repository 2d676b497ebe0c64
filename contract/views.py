"""The given tables seen as clinical tables.

Each view is one SQL text that Spark and DuckDB both understand, so that the
operators under test, and nothing else, make the difference between the two.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators.intervals import collapse_eras
from cohortry.schemas import CLINICAL
from cohortry.session import shared_folder
from cohortry.sources.cdm import Cdm

BASE = ("region", "nation", "customer", "part", "orders", "lineitem", "events")


def _day_code(date: str) -> str:
    """Number below 8192 that grows with the date (years 1990 to 2011)."""
    return f"((year({date}) - 1990) * 372 + month({date}) * 31 + day({date}))"


_SHIP = "cast(l_shipdate as date)"
_ORDER = "cast(o_orderdate as date)"
_DIGIT = "cast(substr(o_orderpriority, 1, 1) as bigint)"
_LINE_ID = f"((l_orderkey * 8 + l_linenumber) * 262144 + l_partkey) * 8192 + {_day_code(_SHIP)}"
_TYPE = (
    "(4000000 + case p_type when 'ECONOMY' then 1 when 'LARGE' then 2 when 'MEDIUM' then 3 "
    "when 'PROMO' then 4 when 'SMALL' then 5 else 6 end)"
)
_BRAND = "(3000000 + cast(substr(p_brand, 7) as bigint))"

# Parts are concepts from this number on.
PART = 10_000_000

VIEWS = {
    "person": """
        select c_custkey as person_id, cast(1920 + c_custkey % 80 as int) as year_of_birth,
               cast(case when c_custkey % 2 = 1 then 8532 else 8507 end as bigint) as gender_concept_id,
               cast(1000000 + c_nationkey as bigint) as race_concept_id
        from {customer}""",
    "observation_period": f"""
        select o_custkey as observation_period_id, o_custkey as person_id,
               min({_ORDER}) as observation_period_start_date, max({_ORDER}) as observation_period_end_date,
               cast(1 as bigint) as period_type_concept_id
        from {{orders}} group by o_custkey""",
    "condition_occurrence": f"""
        select o_orderkey as condition_occurrence_id, o_custkey as person_id,
               5000000 + {_DIGIT} as condition_concept_id, {PART} + o_orderkey % 7 as condition_source_concept_id,
               cast(case o_orderstatus when 'O' then 1 when 'F' then 2 else 3 end as bigint)
                   as condition_type_concept_id,
               {_ORDER} as condition_start_date,
               case when o_orderkey % 3 = 0 then {_ORDER} + cast(o_orderkey % 20 as int) end as condition_end_date,
               case when o_orderstatus = 'F' then o_orderkey end as visit_occurrence_id
        from {{orders}}""",
    "observation": f"""
        select o_orderkey as observation_id, o_custkey as person_id, {PART} + 20 + o_orderkey % 5
                   as observation_concept_id,
               o_orderkey % 3 as value_as_concept_id, {_ORDER} as observation_date,
               case when o_orderstatus = 'F' then o_orderkey end as visit_occurrence_id
        from {{orders}}""",
    "visit_occurrence": f"""
        select o_orderkey as visit_occurrence_id, o_custkey as person_id, {PART} + 51 + o_orderkey % 2
                   as visit_concept_id,
               {_ORDER} as visit_start_date, {_ORDER} + cast(o_orderkey % 14 as int) as visit_end_date
        from {{orders}} where o_orderstatus = 'F'""",
    "drug_exposure": f"""
        select {_LINE_ID} as drug_exposure_id, o_custkey as person_id, {PART} + l_partkey as drug_concept_id,
               {PART} + l_suppkey as drug_source_concept_id, {_SHIP} as drug_exposure_start_date,
               case when l_linenumber = 1 then {_SHIP} + 5 end as drug_exposure_end_date,
               case when l_linenumber <> 2 then cast(l_quantity as int) end as days_supply,
               cast(null as bigint) as visit_occurrence_id
        from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey""",
    "procedure_occurrence": f"""
        select {_LINE_ID} as procedure_occurrence_id, o_custkey as person_id,
               cast({PART} + l_linenumber as bigint) as procedure_concept_id, {_SHIP} as procedure_date,
               o_orderkey as visit_occurrence_id
        from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey where l_returnflag = 'R'""",
    "device_exposure": f"""
        select {_LINE_ID} as device_exposure_id, o_custkey as person_id,
               {PART} + 10 + l_suppkey % 10 as device_concept_id, {_SHIP} as device_exposure_start_date,
               case when l_orderkey % 3 <> 0 then {_SHIP} + cast(l_quantity as int) end
                   as device_exposure_end_date,
               cast(null as bigint) as visit_occurrence_id
        from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey where l_linestatus = 'F'""",
    "death": f"""
        select o_custkey as person_id, max({_ORDER}) as death_date,
               cast(case when o_custkey % 20 = 0 then null else 1 end as bigint) as cause_concept_id
        from {{orders}} where o_custkey % 10 = 0 group by o_custkey""",
    "measurement": f"""
        select event_id as measurement_id, user_id as person_id,
               cast({PART} + 30 + case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3
                    when 'signup' then 4 else 5 end as bigint) as measurement_concept_id,
               value as value_as_number, event_id % 2 as unit_concept_id, event_id % 3 as value_as_concept_id,
               cast(ts as date) as measurement_date, cast(null as bigint) as visit_occurrence_id
        from {{events}}""",
    "measurement_period": """
        select user_id as observation_period_id, user_id as person_id,
               min(cast(ts as date)) as observation_period_start_date,
               max(cast(ts as date)) as observation_period_end_date, cast(1 as bigint) as period_type_concept_id
        from {events} group by user_id""",
    "concept": f"""
        select {PART} + p_partkey as concept_id, p_name as concept_name, 'Drug' as domain_id,
               'RxNorm' as vocabulary_id,
               case when p_partkey % 100 = 0 then 'Ingredient' else 'Clinical Drug' end as concept_class_id,
               'S' as standard_concept, cast(p_partkey as string) as concept_code,
               case when p_partkey % 50 = 0 then 'D' end as invalid_reason
        from {{part}}
        union all
        select distinct {_BRAND}, p_brand, 'Drug', 'ATC', 'ATC 2nd', 'C',
               'B' || lpad(substr(p_brand, 7), 2, '0') || case when p_brand = 'Brand#1' then '  ' else '' end,
               cast(null as string)
        from {{part}}
        union all
        select distinct cast({_TYPE} as bigint), p_type, 'Drug', 'RxNorm', 'Ingredient', 'S', p_type,
               cast(null as string)
        from {{part}}
        union all
        select cast(1000000 + n_nationkey as bigint), n_name, 'Race', 'ATC', 'Race', 'S', 'N1', cast(null as string)
        from {{nation}}
        union all
        select cast(2000000 + r_regionkey as bigint), r_name, 'Race', 'Race', 'Race', 'S', r_name,
               cast(null as string)
        from {{region}}
        union all
        select distinct 5000000 + {_DIGIT}, o_orderpriority, 'Condition', 'SNOMED', 'Clinical Finding', 'S',
               o_orderpriority, cast(null as string)
        from {{orders}}
        union all
        select distinct 6000000 + {_DIGIT},
               case {_DIGIT} when 4 then 'Urgency finding' when 3 then 'Disorder of delay'
                    else 'Urgency up to ' || o_orderpriority end,
               'Condition', 'SNOMED', 'Clinical Finding', 'S', o_orderpriority, cast(null as string)
        from {{orders}}
        union all
        select cast(0 as bigint), 'No matching concept', 'Drug', 'None', 'Ingredient', 'S', r_name,
               cast(null as string)
        from {{region}} where r_regionkey = 0
        union all
        select cast(8532 as bigint), 'FEMALE', 'Gender', 'Gender', 'Gender', 'S', r_name, cast(null as string)
        from {{region}} where r_regionkey = 0
        union all
        select cast(441840 as bigint), 'Clinical finding', 'Condition', 'SNOMED', 'Clinical Finding', 'S', r_name,
               cast(null as string)
        from {{region}} where r_regionkey = 0""",
    "concept_ancestor": f"""
        select {PART} + p_partkey as ancestor_concept_id, {PART} + p_partkey as descendant_concept_id,
               0 as min_levels_of_separation
        from {{part}}
        union all
        select {_BRAND}, {PART} + p_partkey, 1 from {{part}}
        union all
        select cast({_TYPE} as bigint), {PART} + p_partkey, 1 from {{part}}
        union all
        select cast(0 as bigint), {PART} + p_partkey, 1 from {{part}} where p_partkey % 10 = 0
        union all
        select cast(1000000 + n_nationkey as bigint), cast(1000000 + n_nationkey as bigint), 0 from {{nation}}
        union all
        select cast(2000000 + n_regionkey as bigint), cast(1000000 + n_nationkey as bigint), 1 from {{nation}}
        union all
        select distinct 5000000 + {_DIGIT}, 5000000 + {_DIGIT}, 0 from {{orders}}
        union all
        select distinct 6000000 + {_DIGIT}, 5000000 + {_DIGIT}, 1 from {{orders}}
        union all
        select distinct cast(6000005 as bigint), 5000000 + {_DIGIT}, 2 from {{orders}}
        union all
        select distinct cast(441840 as bigint), 5000000 + {_DIGIT}, 4 from {{orders}}
        union all
        select distinct cast(441840 as bigint), 6000000 + {_DIGIT}, cast(case when {_DIGIT} = 2 then 2 else 3 end as int)
        from {{orders}}""",
    "vocabulary": """
        select 'None' as vocabulary_id, 'v' || r_name as vocabulary_version from {region} where r_regionkey = 0
        union all
        select r_name, 'v1' from {region}""",
    # Staging cohorts whose intervals overlap: targets 101 and 102, strata 201 and 202, features 301 and 302.
    "staging": f"""
        select cast(case substr(o_orderpriority, 1, 1) when '1' then 101 when '2' then 102 when '3' then 202 else 302 end
                    as bigint) as cohort_definition_id,
               o_custkey as subject_id, {_ORDER} as cohort_start_date,
               {_ORDER} + case substr(o_orderpriority, 1, 1) when '1' then 30 when '2' then 60 when '3' then 365 else 1
                          end as cohort_end_date
        from {{orders}} where substr(o_orderpriority, 1, 1) <> '5'
        union all
        select cast(case o_orderstatus when 'F' then 201 else 301 end as bigint), o_custkey, {_ORDER},
               {_ORDER} + case o_orderstatus when 'F' then 90 else 10 end
        from {{orders}} where o_orderstatus <> 'O'""",
}

# Results of five sites: one per region.
_MEMBER = f"""
        select c.cohort_definition_id as cohort_id, c.subject_id, r_name as database_id,
               year(c.cohort_start_date) - (1880 + c.subject_id % 120) as age
        from ({VIEWS['staging']}) c join {{customer}} on c_custkey = c.subject_id
        join {{nation}} on n_nationkey = c_nationkey join {{region}} on r_regionkey = n_regionkey"""
_FACT = f"""
        select cohort_id, subject_id, database_id,
               (cast(floor(age / 5.0) as bigint) * 1000 + 3) * 10 + 1 as covariate_id, cast(3 as bigint) as analysis_id,
               'Age group: ' || right('00' || cast(cast(floor(age / 5.0) as bigint) * 5 as string), 2) || '-'
                   || right('00' || cast(cast(floor(age / 5.0) as bigint) * 5 + 4 as string), 2) as covariate_name
        from ({_MEMBER}) m where age >= 0
        union all
        select m.cohort_id, m.subject_id, m.database_id,
               ((5000000 + {_DIGIT}) * 1000 + 212) * 10 + o_orderkey % 4 + 1, cast(212 as bigint),
               'condition_era group: ' || o_orderpriority
        from ({_MEMBER}) m join {{orders}} on o_custkey = m.subject_id
        union all
        select m.cohort_id, m.subject_id, m.database_id, ((4000000 + o_orderkey % 6) * 1000 + 412) * 10 + o_custkey % 4 + 1,
               cast(412 as bigint), 'drug_era group: type ' || cast(o_orderkey % 6 as string)
        from ({_MEMBER}) m join {{orders}} on o_custkey = m.subject_id where o_orderstatus = 'P'
        union all
        select m.cohort_id, m.subject_id, m.database_id, 301000 + o_orderkey % 4 + 1, cast(10000 as bigint),
               'Cohort during window: partial'
        from ({_MEMBER}) m join {{orders}} on o_custkey = m.subject_id where o_orderstatus = 'P'"""
VIEWS["site_count"] = f"""
        select cohort_id, count(*) as cohort_entries, count(distinct subject_id) as cohort_subjects, database_id
        from ({_MEMBER}) m group by cohort_id, database_id"""
VIEWS["site_value"] = f"""
        select f.cohort_id, f.covariate_id, cast(f.n as double) / cast(t.n as double) as mean,
               sqrt(cast(f.n as double) / cast(t.n as double) * (1 - cast(f.n as double) / cast(t.n as double))) as sd,
               f.database_id
        from (select cohort_id, database_id, covariate_id, count(distinct subject_id) as n
              from ({_FACT}) x group by cohort_id, database_id, covariate_id) f
        join (select cohort_id, database_id, count(distinct subject_id) as n from ({_MEMBER}) m
              group by cohort_id, database_id) t on t.cohort_id = f.cohort_id and t.database_id = f.database_id"""
VIEWS["site_covariate"] = f"""
        select distinct covariate_id,
               case when database_id in ('ASIA', 'EUROPE') then upper(covariate_name) else covariate_name end
                   as covariate_name,
               analysis_id as covariate_analysis_id
        from ({_FACT}) f"""
VIEWS["site_mark"] = f"""
        select distinct covariate_id, case when covariate_id % 3 = 0 then 'UTF8' else 'ASCII' end as mark
        from ({_FACT}) f where analysis_id <> 10000"""
VIEWS["site_xref"] = f"""
        select cohort_id, 100 + cohort_id % 2 as target_id,
               case when cohort_id % 2 = 1 then 'urgent target' else 'high target' end as target_name,
               cast(floor(cohort_id / 100.0) as bigint) as strata_id,
               'stratum ' || cast(cast(floor(cohort_id / 100.0) as bigint) as string) as strata_name,
               case when cohort_id < 200 then 'TwS' else 'TwoS' end as cohort_type
        from (select distinct cohort_definition_id as cohort_id from ({VIEWS['staging']}) s) c"""

# Eras of the exposures and conditions, collapsed with a gap of 30 days.
ERAS = {
    "drug_era": ("drug_exposure", "drug_concept_id", "drug_exposure_start_date", "drug_exposure_end_date"),
    "condition_era": (
        "condition_occurrence", "condition_concept_id", "condition_start_date", "condition_end_date"
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a Spark DataFrame.

    The given tables are registered once and stay: dropping a temporary view
    would also drop every cached plan that reads the same files.
    """
    prefix = "given_" + re.sub(r"\W", "_", sf_dir)
    names = {table: f"{prefix}_{table}" for table in BASE}
    for table in set(re.findall(r"{(\w+)}", VIEWS[name])):
        if not spark.catalog.tableExists(names[table]):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(names[table])
    return spark.sql(VIEWS[name].format(**names))


def era_view(cdm: Cdm, name: str) -> DataFrame:
    table, concept, start, end = ERAS[name]
    rows = cdm[table].select("person_id", concept, F.col(start).alias("start_date"),
                             F.coalesce(end, F.date_add(start, 1)).alias("end_date"))
    # Dealt by the keys of the eras, rows are not shuffled again for their days.
    eras = collapse_eras(rows.repartition("person_id", concept), ["person_id", concept], 30)
    code = (F.year("start_date") - 1990) * 372 + F.month("start_date") * 31 + F.dayofmonth("start_date")
    return eras.select(
        ((F.col("person_id") * 262144 + F.pmod(concept, F.lit(262144))) * 8192 + code).alias(f"{name}_id"),
        "person_id",
        concept,
        F.col("start_date").alias(f"{name}_start_date"),
        F.col("end_date").alias(f"{name}_end_date"),
    )


def cdm(spark: SparkSession, sf_dir: str) -> Cdm:
    """The given tables as a bundle of clinical tables."""
    bundle = Cdm(spark, {name: _lazy(spark, sf_dir, name) for name in VIEWS if name in CLINICAL})
    bundle = bundle.with_tables(**{name: _kept(spark, sf_dir, name) for name in ("concept", "concept_ancestor")})
    return bundle.with_tables(**{name: _lazy_era(bundle, name) for name in ERAS})


def measured_cdm(spark: SparkSession, sf_dir: str) -> Cdm:
    """As ``cdm``, but persons are observed while they have measurements."""
    return cdm(spark, sf_dir).with_tables(observation_period=_lazy(spark, sf_dir, "measurement_period"))


def staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "staging")


# The vocabulary is small, derived in many steps and used by nearly every query:
# it is written once per application to the shared folder and read from there.
_WRITTEN: dict[tuple, str] = {}


def _kept(spark, sf_dir, name):
    def read():
        key = (spark.sparkContext.applicationId, sf_dir, name)
        if key not in _WRITTEN:
            path = f"{shared_folder(spark)}/vocabulary-{uuid.uuid4().hex}/{name}"
            view(spark, sf_dir, name).write.parquet(path)
            _WRITTEN[key] = path
        return spark.read.schema(CLINICAL[name]).parquet(_WRITTEN[key])

    return read


def _lazy(spark, sf_dir, name):
    return lambda: view(spark, sf_dir, name)


def _lazy_era(bundle, name):
    return lambda: era_view(bundle, name)


def stored_eras(bundle: Cdm, folder: str) -> Cdm:
    """The bundle with its eras stored under ``folder`` at first use, for work that reads them again."""

    def store(name):
        bundle[name].write.parquet(f"{folder}/{name}")
        return bundle.spark.read.schema(bundle[name].schema).parquet(f"{folder}/{name}")

    return bundle.with_tables(**{name: lambda name=name: store(name) for name in ERAS})


def sql_prelude() -> str:
    """All views as common table expressions for DuckDB."""
    plain = {table: table for table in BASE}
    parts = [f"{name} as ({text.format(**plain)})" for name, text in VIEWS.items()]
    for name, (table, concept, start, end) in ERAS.items():
        code = _day_code("start_date")
        parts.append(f"""{name}_row as (
            select person_id, {concept}, {start} as start_date, coalesce({end}, {start} + 1) as end_date from {table}
        )""")
        parts.append(f"{name}_collapsed as ({collapse_sql(f'{name}_row', f'person_id, {concept}', 30)})")
        parts.append(f"""{name} as (
            select (person_id * 262144 + {concept} % 262144) * 8192 + {code} as {name}_id, person_id, {concept},
                   start_date as {name}_start_date, end_date as {name}_end_date
            from {name}_collapsed)""")
    return "with " + ",\n".join(parts)


def collapse_sql(source: str, keys: str, pad: int) -> str:
    """Era collapse written another way.

    A day opens an era if an interval begins on it and no earlier interval,
    padded, reaches it; the era ends with the latest of the intervals that
    begin before the next era opens.
    """
    listed = [key.strip() for key in keys.split(",")]

    def same(a: str, b: str) -> str:
        return " and ".join(f"{a}.{key} = {b}.{key}" for key in listed)

    opening = f"""select *, lead(start_date) over (partition by {keys} order by start_date) as next_date
        from (select distinct {keys}, start_date from {source} s where not exists (select 1 from {source} p
              where {same("p", "s")} and p.start_date < s.start_date and p.end_date + {pad} >= s.start_date)) d"""
    return f"""
        select {", ".join("o." + key for key in listed)}, o.start_date, max(r.end_date) as end_date
        from ({opening}) o join {source} r on {same("o", "r")} and r.start_date >= o.start_date
            and (o.next_date is null or r.start_date < o.next_date)
        group by {", ".join("o." + key for key in listed)}, o.start_date"""
