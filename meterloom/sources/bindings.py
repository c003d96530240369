"""The driver's tables read as serving telemetry and measurement rows.

Each binding is one list of SQL expressions that Spark and an ANSI engine read
alike; only timestamp and JSON access differ, so those two are parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK_MS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {0}) div 1000"
ANSI_MS = "epoch_us({0}) // 1000"
SPARK_K = "cast(get_json_object(props, '$.k') as bigint)"
ANSI_K = "cast(json_extract_string(props, '$.k') as bigint)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SERVICES = [
    "cast(n_nationkey as bigint) as service_id",
    "n_name as name",
    "cast(0 as bigint) as created_at",
    "case when n_nationkey % 4 = 3 then cast(1 as bigint) end as deleted_at",
]


def _request_metrics(ms: str, k: str) -> list[str]:
    return [
        "event_id as metric_id",
        "user_id % 30 as service_id",
        "user_id % 3 as run_id",
        f"cast({ms.format('ts')} as bigint) as timestamp_ms",
        "'/v1/chat/completions' as endpoint",
        "event_type as model",
        f"{k} as prompt_tokens",
        "case when event_type <> 'signup' then cast(floor(value) as bigint) end as completion_tokens",
        f"case when event_type = 'purchase' then {k} - {k} % 10 end as prompt_eval_tokens",
        "case when event_type <> 'click' then cast(floor(20 * value) as bigint) end as duration_ms",
        "case when event_type in ('view', 'purchase') then cast(floor(4 * value) as bigint) end as ttft_ms",
        "case when event_type = 'purchase' then cast(floor(3 * value) as bigint) end as prompt_ms",
        "case when event_type = 'purchase' then cast(floor(10 * value) as bigint) end as predicted_ms",
        f"case when event_type = 'purchase' then 10 * {k} end as draft_tokens",
        f"case when event_type = 'purchase' then (case when {k} % 5 = 0 then 0 else {k} end) end as draft_tokens_accepted",
        "case when event_type = 'error' then cast(500 as bigint) when event_type = 'signup' then cast(404 as bigint) else cast(200 as bigint) end as status_code",
    ]


def _device_samples(ms: str) -> list[str]:
    return [
        "event_id as sample_id",
        "'gpu:' || cast(user_id % 2 as string) as device",
        f"cast({ms.format('ts')} as bigint) as timestamp_ms",
        "cast(24576 as bigint) as total_bytes",
        "cast(24576 - floor(50 * value) as bigint) as free_bytes",
    ]


TRIGGERS = ["error_rate", "periodic", "ttft_stall", "generation_stall", "spec_collapse"]


def _service_restarts(ms: str) -> list[str]:
    named = " ".join(f"when event_id % 5 = {i} then '{name}'" for i, name in enumerate(TRIGGERS))
    return [
        "event_id as restart_id",
        "user_id % 30 as service_id",
        "user_id % 3 as run_id",
        f"cast({ms.format('ts')} as bigint) as at_ms",
        f"case {named} end as trigger_name",
        "'value ' || cast(cast(floor(value) as bigint) as string) as detail",
    ]


SERVICE_LOGS = [
    "conv_id % 5 as service_id",
    "conv_id as run_id",
    "cast(60000 * cast(floor(conv_id / 10) as bigint) + 1000 * turn as bigint) as timestamp_ms",
    "cast(turn as bigint) as seq",
    "role as stream",
    "text as line",
]

RESERVATIONS = [
    "s_suppkey as service",
    "cast(s_nationkey as bigint) as slot",
    "cast(floor(abs(s_acctbal)) as bigint) as mib",
]

RESTART_WHERE = "event_type = 'error' and value > 90"
SAMPLE_WHERE = "event_type = 'view'"


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(*SERVICES)


def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_request_metrics(SPARK_MS, SPARK_K))


def device_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(SAMPLE_WHERE).selectExpr(*_device_samples(SPARK_MS))


def service_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(RESTART_WHERE).selectExpr(*_service_restarts(SPARK_MS))


def service_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(*SERVICE_LOGS)


def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*RESERVATIONS)


def ansi_ctes() -> dict[str, str]:
    """The same bindings as common table expressions for the other engine."""

    def cte(exprs: list[str], source: str, where: str = "true") -> str:
        text = ", ".join(e.replace("as string)", "as varchar)") for e in exprs)
        return f"select {text} from {source} where {where}"

    return {
        "services": cte(SERVICES, "nation"),
        "rm": cte(_request_metrics(ANSI_MS, ANSI_K), "events"),
        "samples": f"select *, total_bytes - free_bytes as used_bytes from ({cte(_device_samples(ANSI_MS), 'events', SAMPLE_WHERE)})",
        "restarts": cte(_service_restarts(ANSI_MS), "events", RESTART_WHERE),
        "logs": cte(SERVICE_LOGS, "conversations"),
        "resv": cte(RESERVATIONS, "supplier"),
    }


def with_ctes(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a query with the bindings it reads."""
    known = ansi_ctes() | (extra or {})
    return "with " + ", ".join(f"{n} as ({known[n]})" for n in names) + " " + body
