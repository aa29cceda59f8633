"""Reports from a one-row summary: templates, rendering, and checks that the text is grounded in the rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import float_text
from tidemark.operators.quantiles import attach, quantiles

FORBIDDEN = ("guaranteed", "certain threat", "100% accurate")
OPERATOR = "# Operator report\n\nRows: {{ n_rows }} in {{ n_sequences }} sequences, from {{ first_time }} to {{ last_time }}.\nConfirmed: {{ n_confirm }}. Rescans: {{ n_rescan }}.\nLatest action: {{ latest_action }} on {{ latest_sample }}.\n"
SUPERVISOR = "# Supervisor report\n\n{{ n_sequences }} sequences, {{ n_confirm }} confirmed rows, latest {{ latest_action }}.\n"


class ReportError(ValueError):
    """A report can't be rendered, or says what the rows don't."""


def summary(actions: DataFrame) -> DataFrame:
    order = F.struct("sequence_id", "timestamp", "sample_id")
    return actions.agg(
        F.count("*").alias("n_rows"), F.count_distinct("sequence_id").alias("n_sequences"),
        F.count_if(F.col("action") == "CONFIRM").alias("n_confirm"), F.count_if(F.col("action") == "RESCAN").alias("n_rescan"),
        float_text(F.min("timestamp")).alias("first_time"), float_text(F.max("timestamp")).alias("last_time"),
        F.max_by("action", order).alias("latest_action"), F.max_by("sample_id", order).alias("latest_sample"),
    )


def shift_summary(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, mean, median and deviation of a value by groups."""
    v = F.col(value)
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    out = attach(out, quantiles(rows, value, [0.5], by), by).withColumn("median", F.col("q")[0])
    return out.select(*by, "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")])


def render(template: str, values: dict) -> str:
    def put(m: re.Match) -> str:
        if m[1] not in values:
            raise ReportError(f"no value for {m[1]}")
        return str(values[m[1]])

    return re.sub(r"\{\{\s*(\w+)\s*\}\}", put, template)


def check(text: str, values: dict, forbidden: tuple[str, ...] = FORBIDDEN) -> None:
    """No forbidden phrase; the latest action and every count of the summary that the template shows stand in the text."""
    low = text.lower()
    if bad := [p for p in forbidden if p.lower() in low]:
        raise ReportError("forbidden phrases: " + ", ".join(bad))
    if str(values["latest_action"]) not in text or str(values["n_confirm"]) not in text:
        raise ReportError("report does not say the latest action or the confirmed count")
    known = {str(v) for v in values.values()}
    for n in re.findall(r"(?<![\w.])\d+(?:\.\d+)?(?![\w])", text):
        if not any(n in k for k in known):
            raise ReportError(f"{n} is not in the summary")


def reports(actions: DataFrame) -> dict[str, str]:
    values = summary(actions).first().asDict()
    out = {"operator": render(OPERATOR, values), "supervisor": render(SUPERVISOR, values)}
    for text in out.values():
        check(text, values)
    return out
