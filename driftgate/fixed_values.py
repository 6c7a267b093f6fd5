"""Lists, limits, prices and message formats that results depend on.

Nothing here is computed. Every operator takes these as defaults and lets the
caller pass others.
"""

# --- fixed values: personal-data column names ------------------------------
PII_TIER1_NAMES = [
    "email", "e_mail", "email_address", "user_email",
    "phone", "phone_number", "mobile", "telephone",
    "first_name", "last_name", "full_name", "display_name",
    "ssn", "social_security", "passport", "national_id",
    "date_of_birth", "dob", "birth_date",
    "credit_card", "card_number", "cvv",
    "address", "street_address", "home_address",
    "ip_address", "user_ip",
]
PII_TIER2_NAMES = [
    "zip", "zipcode", "zip_code", "postal_code",
    "city", "country", "state", "region",
    "birth_year", "age",
    "latitude", "longitude", "lat", "lon", "lng",
    "device_id", "session_id", "cookie_id",
]
PII_TIER3_TYPES = ["text", "mediumtext", "longtext", "tinytext", "json"]
PII_TIER3_MIN_LENGTH = 100

# --- fixed values: write classes -------------------------------------------
NON_CRITICAL_TABLES = [
    "analytics_events", "page_views", "search_logs",
    "audit_logs", "activity_logs",
    "deleted_records", "soft_deletes",
    "email_queue", "notification_queue",
]

# --- fixed values: change stream -------------------------------------------
CHANGE_OPS = ["c", "u", "d", "r"]
PK_NAMES = ["id", "uuid", "pk", "key"]
LEDGER_DAYS = 30
RETENTION_7_DAYS_MS = 604_800_000
RETENTION_ALERT_DAYS = 4

# --- fixed values: snapshot ------------------------------------------------
CHUNK_SIZE = 500_000
TOP_TIER_SHARE = 0.1
ARCHIVE_TIER_FROM = 0.7
DEADMAN_BYTES_PER_HOUR = 1_000_000_000
DEADMAN_HOURS = 4
MAX_RETRIES = 3
ROW_PARITY_PCT = 0.001

# --- fixed values: divergence messages -------------------------------------
MSG_BOTH_DELETED = "both deleted"
MSG_DELETE_LEFT_ON_TARGET = "deleted on edge but still present on target"
MSG_DELETE_EDGE_ONLY = "exists on edge but not target (CDC lag?)"
MSG_BOTH_MISSING = "row missing from both (possible rollback)"
MSG_MISSING_ON_TARGET = "exists on edge but missing from target"
MSG_MISSING_ON_EDGE = "missing from edge but present on target"
MSG_VALUES_PREFIX = "value divergence: "
MSG_SOFT_NULL = "null and empty string differ"
MSG_TIMING_FORMAT = "target P99 latency %.1fms > 2× edge %.1fms"
MSG_NO_DIVERGENCE = "no divergence"
MSG_SAMPLED_OUT = "sampled_out"
MSG_SETS_MATCH = "result sets match"
MSG_SET_COUNT_FORMAT = "row count mismatch: edge=%d target=%d"
MSG_SET_VALUES = "row sets equal size but different values (execution plan divergence)"
MSG_SET_TIMING_FORMAT = "timing divergence: edge=%.1fms target=%.1fms"
TIMING_FACTOR = 2.0
CLEAN_WINDOW_HOURS = 72

# --- fixed values: business paths ------------------------------------------
BUSINESS_PATHS = [
    ("PATH-001", "Booking transaction integrity"),
    ("PATH-002", "User account state transitions"),
    ("PATH-003", "Inventory availability calculations"),
    ("PATH-004", "Review aggregation"),
    ("PATH-005", "Price calculation"),
    ("PATH-006", "Search ranking"),
]

# --- fixed values: prices and routing --------------------------------------
BASELINE_PRICE_PER_GB = 0.09
SPIKE_MULTIPLIER = 1.5
BYTES_PER_GB = 1e9
DEADLINE_BUFFER_HOURS = 24
MIGRATION_DEADLINE_HOURS = 240
BUFFER_MAX_AGE_HOURS = 2.0
P50_ESTIMATE_USD = 500.0
OVERRUN_FACTOR = 1.5

# --- fixed values: rollback cost model -------------------------------------
EGRESS_PER_GB = 0.09
DOWNTIME_PER_HOUR = 5_000.0
ROLLBACK_GBPS = 0.5
ROLLBACK_FLOOR_GBPS = 0.005
BASE_DOWNTIME_SECONDS = 60.0
DIRTY_SHARE = 0.001
SIMULATIONS = 10_000
SLA_USD = 5_000.0
CAUTION_SHARE = 0.80
PROGRESS_CHECKPOINTS = [0.25, 0.50, 0.75, 0.90, 0.95, 1.00]

# --- fixed values: anomaly model -------------------------------------------
HEARTBEAT_FEATURES = [
    "p99_select_latency_ms",
    "p99_write_latency_ms",
    "replication_lag_seconds",
    "wal_write_rate_bytes_per_sec",
    "buffer_pool_hit_rate_pct",
    "conn_active",
    "conn_idle",
    "conn_waiting",
    "deadlock_count_per_min",
    "long_query_count",
]
FOREST_TREES = 100
FOREST_SUBSAMPLE = 256
CONTAMINATION = 0.05
ANOMALY_THRESHOLD = 0.7
MIN_TRAINING_ROWS = 2016
CALIBRATION_TOLERANCE = 0.20

# --- fixed values: replay throttle -----------------------------------------
THROTTLE_LAG_SECONDS = 120.0
FULL_MULTIPLIER = 5
THROTTLED_MULTIPLIER = 3

# --- fixed values: gates (check id, metric, comparison, limit) -------------
REPLAY_BENCHMARKS = [
    ("B-001", "peak_consumer_lag_seconds", "<=", 120.0),
    ("B-002", "p99_insert_latency_ms", "<=", 200.0),
    ("B-003", "p99_select_latency_ms", "<=", 150.0),
    ("B-004", "max_merkle_divergence_pct", "<=", 0.001),
    ("B-005", "risk_stability_pct", "<=", 20.0),
    ("B-006", "lease_renewal_success_rate_pct", ">=", 99.9),
]
PREFLIGHT_RULES = [
    ("PF-001", "replication_lag_seconds", "<=", 5.0),
    ("PF-002", "risk_p95_usd", "<", 5_000.0),
    ("PF-003", "anomaly_score", "<", 0.7),
    ("PF-004", "merkle_age_minutes", "<=", 30.0),
    ("PF-005", "quorum_nodes", ">=", 2.0),
    ("PF-006", "healthy_brokers", ">=", 1.0),
]
PREFLIGHT_MANUAL = ["PF-007", "PF-008", "PF-009", "PF-010"]
PREFLIGHT_SUSTAINED_HOURS = 4
POST_CUTOVER_RULES = [
    ("PC-001", "p99_latency_ms", "<=", 400.0),
    ("PC-002", "error_rate_pct", "<=", 0.1),
    ("PC-003", "merkle_divergence_pct", "<=", 0.0),
    ("PC-004", "anomaly_score", "<=", 0.5),
    ("PC-005", "conn_pool_pct", "<=", 60.0),
]
SOURCE_LOG_SETTINGS = [
    ("binlog_format", "ROW"),
    ("binlog_row_image", "FULL"),
    ("gtid_mode", "ON"),
    ("enforce_gtid_consistency", "ON"),
]
MIN_LOG_EXPIRE_DAYS = 7
# (alert, metric, comparison, limit, severity, ack minutes, sustained minutes)
ALERT_RULES = [
    ("anomaly", "anomaly_score", ">", 0.7, "HIGH", 15, 0),
    ("lag", "replication_lag_seconds", ">", 120.0, "HIGH", 15, 0),
    ("fencing", "fencing_violations_total", ">", 0.0, "CRITICAL", 5, 0),
    ("divergence", "merkle_divergence_pct", ">", 0.01, "CRITICAL", 5, 0),
    ("dead_letters", "sink_events_dlq_total", ">", 10.0, "HIGH", 15, 0),
    ("dead_man", "snapshot_deadman_triggered", ">=", 1.0, "CRITICAL", 5, 0),
    ("lease", "lease_healthy", "<=", 0.0, "CRITICAL", 5, 0),
    ("shadow_errors", "shadow_error_rate", ">", 0.01, "HIGH", 15, 0),
    ("scale_buffer_pool", "buffer_pool_hit_rate_pct", "<", 95.0, "MEDIUM", 60, 30),
    ("scale_connections", "conn_pool_pct", ">", 70.0, "MEDIUM", 60, 15),
    ("scale_inserts", "p99_insert_latency_ms", ">", 300.0, "MEDIUM", 60, 10),
]

# --- fixed values: resilience score ----------------------------------------
SCORE_PASS = 95
BENCHMARK_POINTS = 30.0
BENCHMARK_COUNT = 6
EXPERIMENT_POINTS = 50.0
EXPERIMENT_COUNT = 7
STABILITY_POINTS = 10.0
ANOMALY_POINTS = 10.0

# --- fixed values: report wording ------------------------------------------
ACCURACY_BANDS = [
    (10, "EXCELLENT — P95 within 10% of Phase 1 estimate"),
    (20, "GOOD — P95 within 20% of Phase 1 estimate"),
    (40, "ACCEPTABLE — P95 within 40% of Phase 1 estimate"),
    (None, "REVIEW REQUIRED — P95 deviated > 40% from estimate"),
]
DEVIATION_FACTORS = [
    (10, "Network variance higher than Phase 1 24h measurement window captured"),
    (20, "Write rate changed significantly between Phase 1 profile and cutover window"),
    (40, "One or more unmodelled factors — review Phase 1 traffic profile inputs"),
]
NO_FACTOR = "Model performed within expected bounds"
DAY_PHASES = [(3, "day_1_3"), (7, "day_4_7"), (10, "day_8_9"), (None, "day_10")]
