"""Column choice, pruning, missing values and quality counts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import BENIGN
from ..functions.scalars import clean_number, null_sentinels, quoted

# Columns that name or time a flow and are no features.
IDENTIFIERS = (
    "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p",
    "ts", "time", "DatetimeIndex",
    "id.orig_h_http", "id.orig_p_http", "id.resp_h_http", "id.resp_p_http",
    "ts_http",
)

# Numeric fields of a connection log.
FLOW_NUMBERS = (
    "duration", "orig_bytes", "resp_bytes", "missed_bytes",
    "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes",
    "local_orig", "local_resp",
)

# Names a label column may have, in order of preference.
LABEL_COLUMNS = ("label", "Label", "attack_cat", "type", "class", "target")

JOIN_SUFFIXES = ("_http", "_dns", "_ssl")


def find_label_column(df: DataFrame, candidates: Sequence[str] = LABEL_COLUMNS) -> str:
    """The first known label column; an error names the columns there are."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"no label column among {df.columns}")


def numeric_cols(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Names of numeric columns, by schema."""
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def text_cols(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Names of string columns, by schema."""
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]


def drop_identifiers(
    df: DataFrame, suffixes: Sequence[str] = JOIN_SUFFIXES, names: Sequence[str] = IDENTIFIERS
) -> DataFrame:
    """Drop flow identifiers and their joined copies; ``suffixes=()`` takes the list literally."""
    gone = set(names) | {n + s for n in names for s in suffixes}
    return df.select(*[quoted(c) for c in df.columns if c not in gone])


def select_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Project the known features that exist, in list order, plus ``keep``."""
    have = set(df.columns)
    return df.select(*[quoted(c) for c in [*keep, *names] if c in have])


def drop_incomplete(df: DataFrame, cols: Sequence[str], how: str = "any") -> DataFrame:
    """Drop rows where any (or all) of ``cols`` is NULL or NaN."""
    types = dict(df.dtypes)

    def missing(c: str) -> Column:
        test = quoted(c).isNull()
        return test | F.isnan(quoted(c)) if types[c] in ("double", "float") else test

    lost = [missing(c) for c in cols]
    joined = lost[0]
    for test in lost[1:]:
        joined = (joined | test) if how == "any" else (joined & test)
    return df.filter(~joined)


def null_text_sentinels(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Sentinel marks become NULL in text columns."""
    chosen = set(cols if cols is not None else text_cols(df))
    return df.select(*[null_sentinels(quoted(c)).alias(c) if c in chosen else quoted(c) for c in df.columns])


def clean_numeric(df: DataFrame, cols: Sequence[str], fill: float | None = 0.0) -> DataFrame:
    """Features as float32, with NULL, NaN and infinities replaced."""
    chosen = set(cols)
    return df.select(*[clean_number(quoted(c), fill).alias(c) if c in chosen else quoted(c) for c in df.columns])


def default_values(df: DataFrame, label: str = "label", text: str = "None") -> dict[str, Column]:
    """Every column with its default for missing values."""
    fills = {}
    for f in df.schema:
        c = quoted(f.name)
        if f.name == label:
            fills[f.name] = F.coalesce(c, F.lit(BENIGN)) if isinstance(f.dataType, T.StringType) else c
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            fills[f.name] = F.coalesce(F.nanvl(c, F.lit(0).cast(f.dataType)), F.lit(0).cast(f.dataType))
        elif isinstance(f.dataType, T.NumericType):
            fills[f.name] = F.coalesce(c, F.lit(0).cast(f.dataType))
        elif isinstance(f.dataType, T.StringType):
            fills[f.name] = F.coalesce(c, F.lit(text))
        else:
            fills[f.name] = c
    return fills


def fill_defaults(df: DataFrame, label: str = "label", text: str = "None") -> DataFrame:
    """Missing numbers become 0, texts ``'None'``, labels ``'Benign'``."""
    return df.select(*[expr.alias(name) for name, expr in default_values(df, label, text).items()])


def stringify(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cast columns to text before saving."""
    chosen = set(cols)
    return df.select(*[quoted(c).cast("string").alias(c) if c in chosen else quoted(c) for c in df.columns])


def _profile(df: DataFrame, cols: Sequence[str], view: Callable[[Column], Column]) -> DataFrame:
    aggs = [F.count("*").alias("rows")]
    for c in cols:
        x = view(quoted(c))
        aggs.append(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).alias(c))
    return df.agg(*aggs)


def constant_profile(
    df: DataFrame, cols: Sequence[str], view: Callable[[Column], Column] = lambda c: c
) -> DataFrame:
    """``(col, non_null, is_constant)`` from one aggregate; NULL counts as a value.

    Minimum, maximum and count replace one exact distinct count per column.
    ``view`` maps a column to the value compared.
    """
    profile = _profile(df, cols, view)

    def entry(c: str) -> Column:
        low, high, n = F.col(f"`{c}`.lo"), F.col(f"`{c}`.hi"), F.col(f"`{c}`.n")
        same = (n == 0) | ((n == F.col("rows")) & low.eqNullSafe(high))
        return F.struct(F.lit(c).alias("col"), n.alias("non_null"), same.alias("is_constant"))

    return profile.select(F.inline(F.array(*[entry(c) for c in cols])))


def constant_columns(
    df: DataFrame, cols: Sequence[str], view: Callable[[Column], Column] = lambda c: c
) -> list[str]:
    """Names of constant columns (one small result per schema column)."""
    if not cols:
        return []
    rows = constant_profile(df, cols, view).filter("is_constant").select("col").collect()
    constant = {r["col"] for r in rows}
    return [c for c in cols if c in constant]


def class_profile(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """Row count and range of every column per class: sizes and constants from one pass."""
    aggs = [F.count("*").alias("_rows")]
    for c in cols:
        x = quoted(c)
        aggs.append(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).alias(f"_p_{c}"))
    return df.groupBy(quoted(label)).agg(*aggs)


def constant_in_profile(profile: DataFrame, cols: Sequence[str]) -> list[str]:
    """Names of the columns that hold one value over all classes of a ``class_profile``."""
    if not cols:
        return []
    cells = []
    for c in cols:
        low, high, n = (quoted(f"_p_{c}")[k] for k in ("lo", "hi", "n"))
        same = (F.sum(n) == 0) | ((F.sum(n) == F.sum("_rows")) & F.min(low).eqNullSafe(F.max(high)))
        cells.append(same.alias(c))
    row = profile.agg(*cells).first()
    return [c for c, same in zip(cols, row) if same]


def drop_constant_columns(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Drop columns that hold a single value, and say which."""
    gone = constant_columns(df, [c for c in df.columns if c not in set(exclude)])
    return df.select(*[quoted(c) for c in df.columns if c not in gone]), gone


def assert_varying(df: DataFrame, cols: Sequence[str]) -> None:
    """Raise when a feature of the finished table is constant."""
    left = constant_columns(df, cols)
    if left:
        raise ValueError(f"constant feature columns remain: {left}")


def distinct_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact ``(col, distinct_values)`` where NULL counts as one value.

    Distinct pairs are formed first, so a frequent value is reduced before the
    shuffle and counting is a plain aggregate over what remains.
    """
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("col"), quoted(c).cast("string").alias("value")) for c in cols])
    )
    return (
        df.select(pairs.alias("p"))
        .select("p.col", "p.value")
        .distinct()
        .groupBy("col")
        .agg(F.count("*").alias("distinct_values"))
    )


def quality_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(col, missing, infinite)`` over all features from one aggregate."""
    aggs = []
    for c in cols:
        x = quoted(c).cast("double")
        aggs.append(
            F.struct(
                F.lit(c).alias("col"),
                F.count_if(x.isNull() | F.isnan(x)).alias("missing"),
                F.count_if(F.abs(x) == F.lit(float("inf"))).alias("infinite"),
            ).alias(c)
        )
    return df.agg(*aggs).select(F.inline(F.array(*[quoted(c) for c in cols])))
