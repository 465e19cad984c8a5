"""Zeek text logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import null_sentinels, quoted, strip, to_ts
from ..scratch import materialize

FIELDS = "#fields\t"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path)


_FILE, _FIELDS_OF = "_file", "_fields"


def zeek_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(_file, _fields)``: the field names in the first ``#fields`` line of every file that has one."""
    head = _lines(spark, path).filter(F.col("value").startswith(FIELDS)).select(
        F.col("_metadata.file_path").alias(_FILE), "value", F.monotonically_increasing_id().alias("at"))
    names = F.split(F.substring(strip(F.col("first")), len(FIELDS) + 1, 1_000_000), "\t")
    return head.groupBy(_FILE).agg(F.min_by("value", "at").alias("first")).select(_FILE, names.alias(_FIELDS_OF))


def read_zeek_log(
    spark: SparkSession, path: str | list[str], prefix: str = "col", corrupt: str | None = "_corrupt"
) -> DataFrame:
    """All columns of a Zeek log as text; ``-`` and ``(empty)`` become NULL.

    Lines starting with ``#`` and blank lines are skipped.  Every file is read by its
    own header; columns that another file has are NULL, and come in the order in
    which headers, sorted, name them.  Files without a header take the only header
    there is, or have the columns ``{prefix}_0`` and so on, after the first data
    line.  Short rows are padded with NULL.  A row with too many fields keeps its
    text in ``corrupt`` and NULL elsewhere; ``corrupt=None`` leaves the extra fields
    out.
    """
    data = _lines(spark, path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    headers = materialize(zeek_headers(spark, path), "headers")
    kinds = sorted(r[0] for r in headers.select(_FIELDS_OF).distinct().collect())  # few, however many files
    if len(kinds) > 1:
        data = data.withColumn(_FILE, F.col("_metadata.file_path")).join(headers, _FILE, "left")
    if len(kinds) != 1:
        bare = data.filter(F.col(_FIELDS_OF).isNull()) if kinds else data
        first = bare.first()
        width = len(first["value"].strip().split("\t")) if first else 0
        generic = [f"{prefix}_{i}" for i in range(width)]
        kinds = [*kinds, *([generic] if generic else [])]
    names = list(dict.fromkeys(n for kind in kinds for n in kind))
    parts = data.withColumn("_p", F.split(strip(F.col("value")), "\t"))
    if len(kinds) > 1:
        own = F.coalesce(F.col(_FIELDS_OF), F.array(*map(F.lit, generic)).cast("array<string>"))
        places = [F.nullif(F.array_position(own, n), F.lit(0)) - 1 for n in names]
        width_of = F.size(own)
    else:
        places, width_of = [F.lit(i) for i in range(len(names))], F.lit(len(names))
    fits = F.size("_p") <= width_of
    cells = [F.get("_p", place.cast("int")) for place in places]
    if corrupt:
        cells = [F.when(fits, c) for c in cells]
    out = [null_sentinels(c).alias(n) for n, c in zip(names, cells)]
    if corrupt:
        out.append(F.when(~fits, F.col("value")).alias(corrupt))
    return parts.select(*out)


def read_optional(
    spark: SparkSession, path: str | list[str], prefix: str = "col", corrupt: str | None = "_corrupt"
) -> DataFrame | None:
    """A Zeek log, or None when the file is missing or holds no data line."""
    try:
        log = read_zeek_log(spark, path, prefix, corrupt)
        return None if not log.columns or log.isEmpty() else log
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def name_label_column(log: DataFrame, corrupt: str = "_corrupt") -> DataFrame:
    """Rename the last field of a labelled log to ``label``."""
    last = [c for c in log.columns if c != corrupt][-1]
    return log.withColumnRenamed(last, "label")


def typed_time(log: DataFrame, col: str = "ts") -> DataFrame:
    """Epoch-second text to a timestamp column."""
    return log.select(*[to_ts(quoted(c)).alias(c) if c == col else quoted(c) for c in log.columns])
