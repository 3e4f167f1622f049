"""Fixed values the results depend on: word lists, lookup tables, limits."""

# Lifecycle words of a status block, two-word forms first.
LIFECYCLE_WORDS = (
    "IN PROGRESS",
    "NOT STARTED",
    "SHIPPED",
    "VETTED",
    "DRAFT",
    "PARTIAL",
    "SUPERSEDED",
    "OBSOLETE",
)
MISSING = "MISSING"
NO_WORD = "?"
NO_BLOCK = "DRAFT"
TERMINAL_WORDS = ("SUPERSEDED", "OBSOLETE")
FINISHED_WORDS = ("SHIPPED", "SUPERSEDED", "OBSOLETE")

# The shape of a work-item stem and the dependency marker.
STEM_PATTERN = r"\b\d{4}-\d{2}-\d{2}-[a-z0-9]+(?:-[a-z0-9]+)*\b"
DEPENDS_MARKER = "Depends-On:"

# Change classes with their severity rank.
SEVERITY = {
    "ok": 0,
    "unknown": 1,
    "benign_add": 2,
    "in_place_change": 3,
    "active_negation": 4,
}

# Resource types whose removal takes something live away.
SERVING_TYPES = (
    "aws_cloudwatch_log_group",
    "aws_db_instance",
    "aws_ecs_service",
    "aws_elasticache_replication_group",
    "aws_iam_role",
    "aws_iam_role_policy",
    "aws_iam_role_policy_attachment",
    "aws_lambda_function",
    "aws_lb",
    "aws_lb_listener",
    "aws_lb_listener_rule",
    "aws_lb_target_group",
    "aws_s3_bucket_public_access_block",
    "aws_s3_bucket_server_side_encryption_configuration",
    "aws_secretsmanager_secret",
    "aws_security_group_rule",
)

# Resource types whose plain creation is still a change.
SENSITIVE_CREATE_TYPES = (
    "aws_iam_role",
    "aws_iam_role_policy",
    "aws_iam_role_policy_attachment",
    "aws_lb_listener_rule",
    "aws_security_group",
    "aws_security_group_rule",
)

# Fixed values: (type, attribute) pairs whose in-place update is a negation.
# The explanations are ours; only the pairs decide a result.
NEGATING = {
    ("aws_db_instance", "allocated_storage"): "database storage resized, a shrink loses data",
    ("aws_db_instance", "backup_retention_period"): "database backup retention changed",
    ("aws_db_instance", "deletion_protection"): "database deletion protection changed",
    ("aws_db_instance", "engine_version"): "database engine upgrade is one-way",
    ("aws_db_instance", "instance_class"): "database size changed, possibly a downsize of production",
    ("aws_db_instance", "multi_az"): "database availability layout changed",
    ("aws_db_instance", "publicly_accessible"): "database exposure to the internet changed",
    ("aws_db_instance", "skip_final_snapshot"): "without a final snapshot a later destroy is final",
    ("aws_db_instance", "storage_encrypted"): "database encryption changed",
    ("aws_ecs_service", "desired_count"): "service task count changed, zero would be an outage",
    ("aws_elasticache_replication_group", "at_rest_encryption_enabled"): "cache encryption at rest changed",
    ("aws_elasticache_replication_group", "automatic_failover_enabled"): "cache failover changed",
    ("aws_elasticache_replication_group", "node_type"): "cache node size changed",
    ("aws_elasticache_replication_group", "num_cache_clusters"): "cache replica count changed",
    ("aws_elasticache_replication_group", "snapshot_retention_limit"): "cache snapshot retention changed",
    ("aws_elasticache_replication_group", "transit_encryption_enabled"): "cache encryption in transit changed",
    ("aws_iam_role", "assume_role_policy"): "who may assume the role changed",
    ("aws_iam_role_policy", "policy"): "granted permissions changed",
    ("aws_lambda_function", "environment"): "function environment changed, gates may be fail-open",
    ("aws_lb_listener_rule", "action"): "routing action changed",
    ("aws_lb_listener_rule", "condition"): "routing condition changed, it may guard an endpoint",
    ("aws_lb_listener_rule", "priority"): "routing order changed, a deny rule may become unreachable",
    ("aws_s3_bucket_public_access_block", "block_public_acls"): "bucket ACL exposure guard changed",
    ("aws_s3_bucket_public_access_block", "block_public_policy"): "bucket policy exposure guard changed",
    ("aws_s3_bucket_public_access_block", "ignore_public_acls"): "bucket ACL ignore guard changed",
    ("aws_s3_bucket_public_access_block", "restrict_public_buckets"): "bucket restriction guard changed",
    ("aws_security_group", "egress"): "outbound network rules changed",
    ("aws_security_group", "ingress"): "inbound network rules changed",
    ("aws_security_group_rule", "cidr_blocks"): "network rule address range changed",
    ("aws_security_group_rule", "from_port"): "network rule first port changed",
    ("aws_security_group_rule", "source_security_group_id"): "network rule source changed",
    ("aws_security_group_rule", "to_port"): "network rule last port changed",
}

# Which negating pair is reported first when several changed.
NEGATING_PRIORITY = (
    ("aws_db_instance", "instance_class"),
    ("aws_db_instance", "engine_version"),
    ("aws_db_instance", "publicly_accessible"),
    ("aws_lambda_function", "environment"),
    ("aws_iam_role_policy", "policy"),
    ("aws_iam_role", "assume_role_policy"),
    ("aws_lb_listener_rule", "condition"),
    ("aws_ecs_service", "desired_count"),
)

# The deploy job, not the infrastructure code, owns these.
DEPLOY_OWNED_TYPES = ("aws_ecs_task_definition",)
DEPLOY_OWNED_ATTRIBUTES = ("container_definitions",)

#: Largest batch of drift records one receiver call accepts.
DRIFT_BATCH_ROWS = 2000

# Providers whose verified e-mail may link to a native account.
TRUSTED_PROVIDERS = ("Google", "MicrosoftEntra")
EXTERNAL_TRIGGER = "PreSignUp_ExternalProvider"
ADMIN_TRIGGER = "PreSignUp_AdminCreateUser"

# Terms that must all occur in a log line, per log metric.
LOG_METRIC_TERMS = {
    "plan_ingest_scanned_zero": ("plan_ingest_worker: cycle", "(scanned=0 "),
    "pr_merge_hydration_down": ("pr_merge hydration has been DISABLED",),
    "worker_panic": ("panicked at",),
}

# The declared alarms. App metrics carry no dimensions.
ALARM_COLUMNS = (
    "alarm STRING, namespace STRING, metric STRING, dim_names ARRAY<STRING>, stat STRING, period_s INT, "
    "n INT, op STRING, threshold DOUBLE, missing STRING, notify_ok BOOLEAN"
)
_TARGET = ["LoadBalancer", "TargetGroup"]
_SERVICE = ["ClusterName", "ServiceName"]
ALARMS = (
    ("no-healthy-hosts", "AWS/ApplicationELB", "HealthyHostCount", _TARGET, "min", 60, 3, "<", 1.0, "breaching", True),
    ("5xx", "AWS/ApplicationELB", "HTTPCode_Target_5XX_Count", _TARGET, "sum", 300, 1, ">=", 5.0, "notBreaching", False),
    ("elb-5xx", "AWS/ApplicationELB", "HTTPCode_ELB_5XX_Count", ["LoadBalancer"], "sum", 300, 2, ">=", 100.0, "notBreaching", True),
    ("latency-p90", "AWS/ApplicationELB", "TargetResponseTime", _TARGET, "p90", 300, 1, ">", 2.0, "notBreaching", False),
    ("cpu", "AWS/ECS", "CPUUtilization", _SERVICE, "avg", 300, 1, ">", 80.0, "notBreaching", False),
    ("mem", "AWS/ECS", "MemoryUtilization", _SERVICE, "avg", 300, 1, ">", 80.0, "notBreaching", False),
    ("jetstream-err", "App", "jetstream_publish_err", [], "sum", 300, 1, ">", 100.0, "notBreaching", False),
    ("plan-ingest-inert", "App", "plan_ingest_scanned_zero", [], "sum", 3600, 1, ">=", 30.0, "notBreaching", True),
    ("pr-hydration-down", "App", "pr_merge_hydration_down", [], "sum", 300, 1, ">=", 1.0, "notBreaching", False),
    ("worker-panic", "App", "worker_panic", [], "sum", 300, 1, ">=", 10.0, "notBreaching", True),
)

# Probe thresholds, recovery target, hit-rate gate, budget.
HEALTHY_AFTER = 2
UNHEALTHY_AFTER = 3
RECOVERY_TTL_S = 30
HIT_RATE_GATE = 0.80
BUDGET_LIMIT_USD = "100"
BUDGET_ACTUAL_PERCENT = 80
BUDGET_FORECAST_PERCENT = 100

# Tier capacities in bytes.
HOT_TAIL_BYTES = 64 * 1024
WARM_SESSION_BYTES = 10 * 1024 * 1024
WARM_TENANT_BYTES = 1024**3
COLD_TENANT_BYTES = 10 * 1024**3

# Fixed values: (store, key prefix, unfinished upload, days, clock) expiry rules.
TTL_RULES = (
    ("warm", "", False, 7, "closed_at"),
    ("cold", "tenant/", False, 90, "created"),
    ("cold", "", True, 7, "created"),
    ("blob", "screenshots/", False, 90, "created"),
    ("blob", "", True, 7, "created"),
    ("cache", "", False, 30, "created"),
    ("cache", "", True, 1, "created"),
    ("logs", "", False, 14, "created"),
)

#: Newest image tags kept per image.
KEEP_TAGS = 2

# Span tags always sampled, and the base rate for the rest.
ALWAYS_SAMPLED_TAGS = ("auth-failure", "partition-event", "cache-miss-cold", "merge-conflict")
SAMPLE_RATE = 0.01

# Exported cache counters.
SCALAR_COUNTERS = (
    "compile_requests",
    "cache_writes",
    "cache_timeouts",
    "cache_read_errors",
    "non_cacheable_compilations",
    "forced_recaches",
    "cache_write_errors",
    "compile_fails",
)
MAP_COUNTERS = ("cache_hits", "cache_misses", "cache_errors")

# Gauges of a bucket in the exposition, with their help texts.
BUCKET_GAUGES = {
    "objects": ("sccache_bucket_objects", "Object count in the shared sccache MinIO bucket."),
    "size_bytes": ("sccache_bucket_size_bytes", "Total byte size of the shared sccache MinIO bucket."),
}

#: Lengths of the periods that declared alarms use, in seconds.
PERIODS_S = (60, 300, 3600)
