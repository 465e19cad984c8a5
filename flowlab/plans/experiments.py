"""Telemetry to the tables of an experiment report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.metrics import convergence, overhead_pct, summarise_experiments
from ..sources.telemetry import read_telemetry


@dataclass
class ExperimentReport:
    """Summary per condition and metric, accuracy curves, overhead of one condition over another."""

    summary: DataFrame
    curves: DataFrame
    overhead: DataFrame


def experiment_report(
    spark: SparkSession, paths: str | list[str], base: str = "A_baseline", other: str = "B_pqc_only"
) -> ExperimentReport:
    """Read telemetry files of any number of runs and summarise them."""
    rows = read_telemetry(spark, paths)
    return ExperimentReport(
        summarise_experiments(rows), convergence(rows), overhead_pct(rows, base, other, ["train_time_ms"])
    )
