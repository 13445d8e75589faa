"""Schemas of the stored tables and of the corpus."""

from pyspark.sql import types as T

TABLES = {
    "training_samples": "sample_id long, dataset_source string, creation_date timestamp, model_type_intended string, sample_quality_score double, is_multiturn boolean",
    "conversation_turns": "turn_id long, sample_id long, turn_index int, role string, content string, is_label boolean, metadata_json string",
    "file_hashes": "file_path string, content_hash string, last_processed timestamp, sample_id long",
    "failed_files": "failed_id long, file_path string, reason string, failed_at timestamp",
    "pipeline_state": "key string, value string",
    "memo": "memo_key string, questions array<string>, answer string, made_at timestamp",
}
#: What a table's rows are replaced or deleted by; such tables are split into buckets by it.
KEYS = {"file_hashes": "file_path", "failed_files": "file_path", "pipeline_state": "key", "memo": "memo_key"}
FILE_LIST, FILE_CONTENTS = ("repo", "file_path", "size", "kept"), ("content_hash", "content", "error")
CORPUS = "repo string, file_path string, size long, kept boolean, content_hash string, content string, error string"


def struct(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])
