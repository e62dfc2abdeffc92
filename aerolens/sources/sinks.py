"""Batch sinks (S5, S7 helpers).

All writes go through Spark writers, so any Hadoop-compatible shared path
works; nothing is staged on a machine-local folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from aerolens.streaming.job import alerts, format_alert


def console_lines(scored: DataFrame) -> DataFrame:
    """Formatted alert lines (use ``.show(truncate=False)`` or a console stream)."""
    return format_alert(alerts(scored))


def write_metric_tables(global_df: DataFrame, per_scenario_df: DataFrame,
                        per_profile_df: DataFrame, out_dir: str) -> None:
    """The three metric tables as header CSV folders.

    The tables have one row per layer / type / profile, so one output file
    each (``coalesce(1)`` on a tiny table) keeps them readable.
    """
    for name, df in (("metrics_global", global_df), ("metrics_per_scenario", per_scenario_df),
                     ("metrics_per_profile", per_profile_df)):
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out_dir}/{name}")
