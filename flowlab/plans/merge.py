"""Raw logs of several scenarios to one merged table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import quoted
from ..operators.clean import default_values, stringify, text_cols
from ..operators.joins import HEAVY_ROWS, merge_logs
from ..sources.zeek import name_label_column, read_optional, typed_time

COMPANIONS = ("http", "dns", "ssl")


CORRUPT = "_corrupt"


def merge_scenario(
    spark: SparkSession, labelled: str, companions: dict[str, str], key: str = "uid", heavy_rows: int = HEAVY_ROWS
) -> DataFrame | None:
    """One scenario: labelled connection log plus the companion logs that exist.

    Rows of the connection log with too many fields are kept with their text in
    ``_corrupt`` and NULL in every other column; those of companions belong to no
    connection and are left out.
    """
    base = read_optional(spark, labelled, "conn", CORRUPT)
    if base is None:
        return None
    logs = {name: read_optional(spark, path, name, CORRUPT) for name, path in companions.items()}
    found = {name: log.filter(quoted(CORRUPT).isNull()).drop(CORRUPT) for name, log in logs.items() if log is not None}
    merged = merge_logs(typed_time(name_label_column(base)), found, key, heavy_rows=heavy_rows)
    whole = quoted(CORRUPT).isNull()
    return merged.select(*[
        quoted(c) if c == CORRUPT else F.when(whole, e).alias(c) for c, e in default_values(merged).items()
    ])


def merge_scenarios(
    spark: SparkSession,
    scenarios: dict[str, tuple[str, dict[str, str]]],
    key: str = "uid",
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """All scenarios as one table; columns a scenario lacks are NULL there."""
    parts = [merge_scenario(spark, base, logs, key, heavy_rows) for base, logs in scenarios.values()]
    tables = [p for p in parts if p is not None]
    if not tables:
        raise ValueError("no scenario has a labelled connection log")
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return stringify(merged, text_cols(merged))
