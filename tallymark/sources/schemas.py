"""Schemas of evidence documents, as DDL, and their file names; nothing is inferred."""

CONFIG = (
    "config_id string, plan_id string, run_key string, runner_revision string, repetition int, block_position long, protocol_id string, decoder_id string, requested_threads int, "
    "num_workers int, batch_size int, prefetch_factor int, persistent_workers boolean, multiprocessing_start_method string, support_policy string, output_contract string, "
    "logical_repeat_factor int, timed_passes_per_run int, warmup_passes int, minimum_timed_seconds double, package_id string, manifest_id string, selection_id string, schema_version string"
)
DATASET = (
    "manifest_id string, package_id string, selection_id string, workload_id string, ordered_item_ids array<string>, support_set_id string, support_policy string, "
    "support_audit_ids array<string>, support_process_context string, support_multiprocessing_start_method string"
)
ENVIRONMENT = (
    "environment_id string, dependency_group string, lock_sha256 string, project_sha256 string, runner_revision string, python map<string,string>, platform_tags array<string>, "
    "distributions array<struct<name:string,version:string>>, native_backends map<string,string>"
)
PLATFORM = "platform_id string, identity map<string,string>, runtime map<string,string>, provenance map<string,string>"
RUNTIME = (
    "effective_threads int, multiprocessing_start_method string, process_id long, persistent_workers_reused boolean, "
    "worker_handshakes array<struct<process_id:long,effective_threads:int,multiprocessing_start_method:string>>"
)
_STATISTIC = "struct<n:long,mean:double,median:double,minimum:double,maximum:double,sample_std:double,coefficient_of_variation:double>"
SUMMARY = (
    f"statistics struct<elapsed_seconds:{_STATISTIC},images_per_second:{_STATISTIC},microseconds_per_image:{_STATISTIC}>, "
    "num_unique_images long, logical_repeat_factor long, logical_decodes_per_pass long, status string, schema_version string"
)
MANIFEST = "bundle_id string, run_key string, schema_version string, files map<string,struct<bytes:long,sha256:string>>"
MARKER = "bundle_id string, run_key string, schema_version string, status string"
SAMPLE = "sample_index int, elapsed_seconds double, items_processed long, started_at_utc string"
EVENT = "event string, duration_seconds double, timestamp_utc string"
FAILURE = "item_id string, failure_type string, message string"
ITEM = (
    "item_id string, relative_path string, sha256 string, compressed_bytes long, width int, height int, components int, progressive boolean, subsampling string, has_exif boolean, parse_error string"
)
AUDIT = (
    "audit_id string, decoder_id string, requested_threads int, manifest_id string, selection_id string, process_context string, multiprocessing_start_method string, output_contract string, "
    "environment_id string, platform_id string, successful_item_ids array<string>, failures array<struct<item_id:string,failure_type:string,message:string>>"
)
SUPPORT_SET = (
    "support_set_id string, policy string, manifest_id string, selection_id string, item_ids array<string>, audit_ids array<string>, process_context string, multiprocessing_start_method string"
)
AUDIT_MARKER = "audit_id string, audit_key string, status string"
#: The files of a run's bundle, by the name that readers give their column.
DOCUMENTS = {"config": CONFIG, "dataset": DATASET, "environment": ENVIRONMENT, "platform": PLATFORM, "runtime": RUNTIME, "summary": SUMMARY, "bundle_manifest": MANIFEST}
LINES = ("samples", "failures", "events")
