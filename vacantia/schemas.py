"""Schemas of the platform's relations; the timestamps carry no zone."""

from __future__ import annotations

from pyspark.sql.types import StructType

_STATUS = ", ".join(f"{s}_status string, {s}_completed_at timestamp_ntz, {s}_attempts int, {s}_error string" for s in ("extraction", "enhancement", "embedding"))

_DDL = {
    "raw_jobs": "job_id string, portal string, country string, url string, title string, company string, location string, description string, requirements string, salary_raw string, contract_type string, remote_type string, posted_date date, scraped_at timestamp_ntz, content_hash string, raw_html string, is_processed boolean, "
    + _STATUS
    + ", analysis_status string, analysis_completed_at timestamp_ntz, is_usable boolean, unusable_reason string, is_duplicate boolean, duplicate_of string, duplicate_similarity_score float, duplicate_detection_method string, language string",
    "cleaned_jobs": "job_id string, title_cleaned string, description_cleaned string, requirements_cleaned string, combined_text string, cleaning_method string, cleaned_at timestamp_ntz, combined_word_count int, combined_char_count int",
    "extracted_skills": "extraction_id string, job_id string, skill_text string, skill_type string, extraction_method string, confidence_score double, source_section string, span_start int, span_end int, esco_uri string, extracted_at timestamp_ntz",
    "enhanced_skills": "enhancement_id string, job_id string, original_skill_text string, normalized_skill string, skill_type string, esco_concept_uri string, esco_preferred_label string, llm_confidence double, llm_reasoning string, is_duplicate boolean, duplicate_of_id string, enhanced_at timestamp_ntz, llm_model string, processing_time_seconds double, tokens_used int, esco_match_method string",
    "gold_standard_annotations": "id int, job_id string, skill_text string, skill_type string, annotator string, annotation_date timestamp_ntz, notes string, esco_concept_uri string, esco_preferred_label string, esco_match_method string, esco_match_score double",
    "skill_embeddings": "embedding_id string, skill_text string, embedding array<float>, model_name string, model_version string, created_at timestamp_ntz",
    "analysis_results": "analysis_id string, analysis_type string, country string, date_range_start date, date_range_end date, parameters string, results string, created_at timestamp_ntz",
    "esco_skills": "skill_uri string, skill_id string, preferred_label_es string, preferred_label_en string, description_es string, description_en string, skill_type string, skill_group string, skill_family string, is_active boolean, created_at timestamp_ntz",
    "esco_skill_labels": "label_id int, skill_uri string, language_code string, label string, label_type string",
    "esco_skill_relations": "relation_id int, source_skill_uri string, target_skill_uri string, relation_type string",
    "custom_skill_mappings": "mapping_id int, skill_text string, esco_skill_uri string, confidence_score double, mapping_reason string, created_by string, created_at timestamp_ntz",
    "esco_skill_groups": "group_id string, name_es string, name_en string, description string, parent_group_id string",
}


def schema(relation: str) -> StructType:
    """The schema of a relation; needs a session, as Spark parses it."""
    return StructType.fromDDL(_DDL[relation])


RELATIONS = tuple(_DDL)

#: Allowed values, kept as rules for quarantine rather than constraints.
ALLOWED = {
    "country": ("CO", "MX", "AR"),
    "status": ("pending", "processing", "completed", "failed", "skipped"),
    "skill_type": ("hard", "soft"),
    "label_type": ("preferred", "alternative", "hidden"),
    "relation_type": ("broader", "narrower", "related", "essential", "optional"),
}
