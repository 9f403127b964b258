"""Names, limits and declarations of features."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from datetime import timedelta

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS

# fixed values: topics, the push source and its target
RAW_TOPIC = "raw.transactions.v1"
FEATURE_TOPIC = "features.customer_30d.v1"
LATE_TOPIC = "transactions.late.v1"
INVALID_TOPIC = "transactions.invalid.v1"
PUSH_DLQ_TOPIC = "features.customer_30d.push-dlq.v1"
PUSH_SOURCE = "flink_customer_30d_push"
PUSH_TO = "online_and_offline"

WATERMARK_DELAY = timedelta(hours=1)
DEDUP_TTL = timedelta(days=32)
ONLINE_TTL = timedelta(days=31)
BATCH_RECORDS = 100
PUSH_ATTEMPTS = 5


@dataclass(frozen=True)
class Settings:
    """Where tables and topics are; the environment's values if it has them."""

    data_dir: str = field(default_factory=lambda: os.environ.get("DATA_DIR", "/data"))
    kafka_servers: str = field(default_factory=lambda: os.environ.get("KAFKA_BOOTSTRAP_SERVERS", "kafka:9092"))

    def path(self, *parts: str) -> str:
        return "/".join([self.data_dir.rstrip("/"), *parts])


@dataclass(frozen=True)
class Entity:
    name: str = "customer_id"
    join_key: str = "customer_id"
    kind: str = "string"


@dataclass(frozen=True)
class Aggregation:
    column: str
    function: str
    window: timedelta
    slide: timedelta
    name: str | None = None

    def resolved_name(self) -> str:
        """The declared name, else function, column and window, like sum_amount_2592000s."""
        return self.name or f"{self.function}_{self.column}_{int(self.window.total_seconds())}s"


@dataclass(frozen=True)
class FeatureView:
    """A set of aggregations of one source; `schema` declares types of outputs or of source columns."""

    name: str
    entity: Entity
    aggregations: tuple[Aggregation, ...]
    schema: tuple[tuple[str, str], ...] = ()
    ttl: timedelta = ONLINE_TTL
    online: bool = True
    offline: bool = False

    def output_schema(self) -> list[tuple[str, str]]:
        """(name, type) of each aggregate: as declared by its name, bigint for counts, else as the column it
        aggregates is declared. An aggregate without a type is an error."""
        declared = dict(self.schema)
        out = []
        for a in self.aggregations:
            kind = declared.get(a.resolved_name()) or ("bigint" if a.function in ("count", "count_distinct") else declared.get(a.column))
            if kind is None:
                raise ValueError(f"No declared type for aggregate output {a.resolved_name()}")
            out.append((a.resolved_name(), kind))
        return out


_WINDOW = {"window": timedelta(days=30), "slide": timedelta(hours=1)}
CUSTOMER_30D = FeatureView(
    "customer_30d",
    Entity(),
    (Aggregation("amount", "sum", name="total_amount_30d", **_WINDOW), Aggregation("amount", "count", name="tx_count_30d", **_WINDOW)),
    (("total_amount_30d", "double"), ("tx_count_30d", "bigint")),
)
