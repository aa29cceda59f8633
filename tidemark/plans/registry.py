"""Register of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows if there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return put


#: Named parts of the SQL twins; `sql` puts those that are asked for before a final SELECT.
PARTS: dict[str, str] = {
    "frames": """frames AS (SELECT CAST(user_id AS VARCHAR) AS sequence_id, epoch_us(ts) / 1e6 AS timestamp,
        lpad(CAST(event_id AS VARCHAR), 9, '0') AS sample_id, CASE WHEN event_type = 'error' THEN 'hazard' ELSE 'benign' END AS label,
        event_type AS scenario_id, value AS score, props FROM events)""",
    "buckets": """buckets AS (SELECT sequence_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256(sequence_id), ''),
        lambda x: (instr('0123456789abcdef', x) - 1)::BIGINT)), lambda a, b: (a * 16 + b) % 1000) AS bucket
        FROM (SELECT DISTINCT sequence_id FROM frames))""",
    "splits": """splits AS (SELECT sequence_id, CASE WHEN bucket < 800 THEN 'train' WHEN bucket < 900 THEN 'val' ELSE 'test' END AS split FROM buckets)""",
    "cuts": """cuts AS (SELECT quantile_cont(score, 0.5) AS c1, quantile_cont(score, 0.75) AS c2, quantile_cont(score, 0.9) AS c3
        FROM frames JOIN splits USING (sequence_id) WHERE split = 'train' AND label = 'hazard')""",
    "regimes": """regimes AS (SELECT f.*, split, CASE WHEN score <= c1 THEN 'trusted' WHEN score <= c2 THEN 'ambiguous' WHEN score <= c3 THEN 'degraded' ELSE 'high_risk' END AS regime_label,
        least(greatest((score - c1) / greatest(c3 - c1, 1e-12), 0.0), 1.0) AS risk_score FROM frames f JOIN splits USING (sequence_id), cuts)""",
    "actions": """actions AS (SELECT sequence_id, timestamp, sample_id, label, split, risk_score AS score,
        CASE WHEN sum(CASE WHEN risk_score >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY sequence_id ORDER BY timestamp, sample_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 3 THEN 'CONFIRM'
             WHEN risk_score >= 0.5 THEN 'RESCAN' ELSE 'HOLD' END AS action FROM regimes)""",
    "islands": """islands AS (SELECT *, CASE WHEN action <> 'HOLD' THEN sum(opens) OVER (PARTITION BY sequence_id ORDER BY timestamp, sample_id) END AS island,
        lead(timestamp) OVER (PARTITION BY sequence_id ORDER BY timestamp, sample_id) AS next_time
        FROM (SELECT *, CASE WHEN action <> 'HOLD' AND coalesce(lag(action) OVER (PARTITION BY sequence_id ORDER BY timestamp, sample_id), 'HOLD') = 'HOLD' THEN 1 ELSE 0 END AS opens FROM actions))""",
    "alarms": """alarms AS (SELECT sequence_id, island, any_value(split) AS split, arg_min(sample_id, (timestamp, sample_id)) AS start_sample_id, arg_max(sample_id, (timestamp, sample_id)) AS end_sample_id,
        min(timestamp) AS start_timestamp, max(timestamp) AS end_timestamp, min(CASE WHEN action = 'CONFIRM' THEN timestamp END) AS confirm_timestamp,
        max(next_time) AS clear_timestamp, count(next_time) = count(*) AS cleared, max(score) AS event_score, bool_or(label = 'hazard') AS is_hazard
        FROM islands WHERE island IS NOT NULL GROUP BY sequence_id, island)""",
}
_NEEDS = {"buckets": ["frames"], "splits": ["buckets"], "cuts": ["splits"], "regimes": ["cuts"], "actions": ["regimes"], "islands": ["actions"], "alarms": ["islands"]}


def sql(part: str, final: str) -> str:
    """The final SELECT behind a named part and all that it needs."""
    need, todo = [], [part]
    while todo:
        p = todo.pop()
        if p not in need:
            need.append(p)
            todo += _NEEDS.get(p, [])
    ordered = [p for p in PARTS if p in need]
    return "WITH " + ",\n".join(PARTS[p] for p in ordered) + "\n" + final
