"""Schemas of all records (Spark DDL)."""

RAW = "event_id string, customer_id string, amount double, event_timestamp_ms bigint"
RAW_BATCH = RAW + ", event_timestamp timestamp, created_timestamp timestamp"
FEATURE = "customer_id string, total_amount_30d double, tx_count_30d bigint, window_start_ms bigint, window_end_ms bigint, event_timestamp string, created_timestamp string"
OFFLINE = "customer_id string, total_amount_30d double, tx_count_30d bigint, event_timestamp timestamp, created_timestamp timestamp"
LEDGER = "customer_id string, window_end_ms bigint"
DLQ = "reason string, source_topic string, source_partition int, source_offset bigint, value string"
RAW_FIELDS = ("event_id", "customer_id", "amount", "event_timestamp_ms")
PUSH_FIELDS = ("customer_id", "total_amount_30d", "tx_count_30d", "event_timestamp", "created_timestamp")
REQUIRED_AGGREGATE_FIELDS = ("created_timestamp", "customer_id", "event_timestamp", "total_amount_30d", "tx_count_30d", "window_end_ms")
