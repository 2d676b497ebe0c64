"""Column names and types of every table the package reads or writes."""

from __future__ import annotations

# Clinical tables, only the columns the operators use.
CLINICAL = {
    "person": "person_id long, year_of_birth int, gender_concept_id long, race_concept_id long",
    "observation_period": "observation_period_id long, person_id long, "
    "observation_period_start_date date, observation_period_end_date date, period_type_concept_id long",
    "condition_occurrence": "condition_occurrence_id long, person_id long, condition_concept_id long, "
    "condition_source_concept_id long, condition_type_concept_id long, condition_start_date date, "
    "condition_end_date date, visit_occurrence_id long",
    "observation": "observation_id long, person_id long, observation_concept_id long, "
    "value_as_concept_id long, observation_date date, visit_occurrence_id long",
    "measurement": "measurement_id long, person_id long, measurement_concept_id long, value_as_number double, "
    "unit_concept_id long, value_as_concept_id long, measurement_date date, visit_occurrence_id long",
    "procedure_occurrence": "procedure_occurrence_id long, person_id long, procedure_concept_id long, "
    "procedure_date date, visit_occurrence_id long",
    "drug_exposure": "drug_exposure_id long, person_id long, drug_concept_id long, drug_source_concept_id long, "
    "drug_exposure_start_date date, drug_exposure_end_date date, days_supply int, visit_occurrence_id long",
    "device_exposure": "device_exposure_id long, person_id long, device_concept_id long, "
    "device_exposure_start_date date, device_exposure_end_date date, visit_occurrence_id long",
    "visit_occurrence": "visit_occurrence_id long, person_id long, visit_concept_id long, "
    "visit_start_date date, visit_end_date date",
    "death": "person_id long, death_date date, cause_concept_id long",
    "drug_era": "drug_era_id long, person_id long, drug_concept_id long, "
    "drug_era_start_date date, drug_era_end_date date",
    "condition_era": "condition_era_id long, person_id long, condition_concept_id long, "
    "condition_era_start_date date, condition_era_end_date date",
    "concept": "concept_id long, concept_name string, domain_id string, vocabulary_id string, "
    "concept_class_id string, standard_concept string, concept_code string, invalid_reason string",
    "concept_ancestor": "ancestor_concept_id long, descendant_concept_id long, min_levels_of_separation int",
    "vocabulary": "vocabulary_id string, vocabulary_version string",
}

# Settings, cohort and result tables.
STUDY = {
    "cohort": "cohort_definition_id long, subject_id long, cohort_start_date date, cohort_end_date date",
    "cohort_settings": "name string, full_name string, tool_id long, cohort_id long",
    "cohort_groups": "cohort_group string, file_name string, user_can_select boolean",
    "feature_windows": "window_id int, window_start int, window_end int, window_type string",
    "bulk_strata": "generation_script string, name string, lb_operator string, lb_strata_value string, "
    "ub_operator string, ub_strata_value string, cohort_id long",
    "target_strata_xref": "target_id long, strata_id long, cohort_id long, cohort_type string, name string",
    "feature_summary": "cohort_definition_id long, feature_cohort_definition_id long, window_id int, "
    "feature_count long",
    "cohort_inclusion": "cohort_definition_id long, rule_sequence int, name string, description string",
    "cohort_inclusion_result": "cohort_definition_id long, inclusion_rule_mask long, person_count long, mode_id int",
    "cohort_inclusion_stats": "cohort_definition_id long, rule_sequence int, person_count long, "
    "gain_count long, person_total long, mode_id int",
    "cohort_summary_stats": "cohort_definition_id long, base_count long, final_count long, mode_id int",
    "cohort_count": "cohort_id long, cohort_entries long, cohort_subjects long, database_id string",
    "covariate": "covariate_id long, covariate_name string, covariate_analysis_id long",
    "covariate_value": "cohort_id long, covariate_id long, mean double, sd double, database_id string",
    "database": "database_id string, database_name string, description string, vocabulary_version string, "
    "is_meta_analysis int",
    "ledger": "cohort_id long, task string, checksum string, time_stamp timestamp",
}

TABLES = {**CLINICAL, **STUDY}

# Normalised event: the same columns for every domain.
EVENT = (
    "person_id",
    "event_id",
    "start_date",
    "end_date",
    "target_concept_id",
    "visit_occurrence_id",
    "sort_date",
)
