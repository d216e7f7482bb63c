"""Worker messages and telemetry lines as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESSAGE = (
    "type string, task_id string, duration_seconds double, sample_rate int, synth_wall_seconds double, output_path string, worker_pid int,"
    " worker_logs array<string>, runtime map<string,double>, effective_performance_mode string, k bigint, _corrupt string"
)
KINDS = ("ready", "result", "task_error", "fatal", "closed", "pong", "eof")


def parse_messages(lines: DataFrame, line: str) -> DataFrame:
    """``lines`` with ``m``, the parsed message, and ``route``: its kind, ``log`` for what is not JSON; blank lines go."""
    m = F.from_json(F.trim(line), MESSAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.filter(F.trim(line) != "").withColumn("m", m)
    return rows.withColumn("route", F.when(F.col("m._corrupt").isNotNull(), "log").when(F.col("m.type").isin(*KINDS), F.col("m.type")).otherwise("other"))


def parse_gpu(lines: DataFrame, line: str, strict: bool = False) -> DataFrame:
    """``lines`` with the sample's name, load, power and memory in GB; lines short of a field go, or are an error if ``strict``."""
    fields = F.split(line, " *, *")
    short = F.raise_error(F.concat(F.lit("a telemetry line is short of a field: "), F.col(line))).cast("boolean") if strict else F.lit(False)
    rows = lines.filter(F.when(F.size(fields) >= 5, True).otherwise(short)).withColumn("f", fields)
    gb = lambda i: F.round(F.col("f")[i].cast("double") / 1024, 2)
    return rows.select(
        *(c for c in lines.columns if c != line), F.trim(F.col("f")[0]).alias("gpu_name"), F.col("f")[1].cast("double").cast("int").alias("util_percent"),
        F.rint(F.col("f")[2].cast("double")).cast("int").alias("power_w"), gb(3).alias("used_gb"), gb(4).alias("total_gb"),
    )
