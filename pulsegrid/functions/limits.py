"""Schemas, limits, reason codes and messages of metric ingestion."""

from __future__ import annotations

from pyspark.sql import types as T

# Limits of a request and its points.
MAX_POINTS = 1000
MAX_NAME = 128
MAX_SOURCE = 200
MAX_UNIT = 32
MAX_LABELS = 8
MAX_LABEL_KEY = 64
MAX_LABEL_VALUE = 128
MAX_LABEL_TEXT = 256
FUTURE_SKEW = "INTERVAL 5 MINUTES"
MAX_AGE = "INTERVAL 7 DAYS"
RATE_PERMIT = 120
RATE_WINDOW_SECONDS = 60
RETENTION_DAYS = 7
WEEKS_AHEAD = 3
SPOOL_DEPTH = 2000
LOSS_IDS = 20

# What a sender reads for each reason.
MESSAGES = {
    "source": "Source must be given and may not exceed 200 characters.",
    "batch_empty": "A batch must contain at least one point.",
    "batch_too_large": "A batch may not exceed 1000 points.",
    "name": "Metric names must be lowercase, dot-separated segments of [a-z0-9_].",
    "unit": "Unit must be given and may not exceed 32 characters.",
    "value": "Values must be finite.",
    "ts_future": "Timestamp is too far in the future.",
    "ts_old": "Timestamp is older than the retention horizon.",
    "label_count": "At most 8 labels per point.",
    "label_length": "Label keys must be at most 64 characters and values at most 128 characters.",
    "label_total": "Label keys and values combined must be at most 256 characters per point.",
    "ts": "Timestamp is missing or cannot be read.",
    "labels_unstorable": "Labels may not contain control characters.",
}

# Codes of the stored enumerations, statuses of a publish attempt.
SCOPES = {0: "ingest", 1: "read", 2: "control"}
SOURCE_KINDS = {0: "host", 1: "httpprobe"}
ACCEPTED_STATUSES = [202]
REJECTED_STATUSES = [400, 401, 403, 404, 405, 413, 415]
TABLES = ["metric_points"]
WIDTHS = {"tenants": {"name": 200, "slug": 100}, "api_keys": {"key_hash": 64, "label": 200}, "sources": {"name": 200}}

LABELS = T.MapType(T.StringType(), T.StringType())
WIRE_POINT = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("unit", T.StringType()), T.StructField("ts", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("labels", LABELS)]
)
WIRE_REQUEST = T.StructType([T.StructField("source", T.StringType()), T.StructField("points", T.ArrayType(WIRE_POINT))])
REQUEST = "batch_id long, received_at timestamp, api_key string, source string, points array<struct<name:string,unit:string,ts:string,value:double,labels:map<string,string>>>"
TENANT = "id int, name string, slug string, created_at timestamp"
API_KEY = "id int, tenant_id int, key_hash string, label string, scope int, created_at timestamp, last_used_at timestamp, revoked_at timestamp"
SOURCE = "id int, tenant_id int, name string, kind int, config string, last_seen_at timestamp"
SERIES = "id int, tenant_id int, source_id int, name string, unit string, labels string, created_at timestamp"
ROLLUP = "series_id int, bucket timestamp, n long, total double, least double, most double, last double, version long, week date"
POINT = "series_id int, ts timestamp, value double"
REJECT = "batch_id long, pos int, reason string, n_points long"
