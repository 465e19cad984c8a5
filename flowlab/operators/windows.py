"""Tumbling-window features and labels, in batch or on a stream."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import BENIGN
from ..functions.scalars import quoted

START = "window_start"


def windowed(df: DataFrame, size: str, ts: str = "ts") -> DataFrame:
    """Add the start of the left-closed tumbling window a row falls in."""
    return df.withColumn(START, F.window(quoted(ts), size)["start"])


def numeric_features(cols: Sequence[str]) -> list[Column]:
    """min, max and mean of every column, named ``{col}_{stat}``."""
    return [
        f(quoted(c)).alias(f"{c}_{stat}")
        for c in cols
        for stat, f in (("min", F.min), ("max", F.max), ("mean", F.avg))
    ]


def traffic_counts(uid: str | None = "uid", approximate: bool = False) -> list[Column]:
    """``flow_count`` = distinct flow ids, ``packet_count`` = rows."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    flows = [distinct(quoted(uid)).alias("flow_count")] if uid else []
    return [*flows, F.count("*").alias("packet_count")]


def _distinct(cols: Sequence[str], approximate: bool) -> list[Column]:
    return [F.approx_count_distinct(quoted(c)).alias(f"{c}_nunique") for c in cols] if approximate else []


def value_counts(rows: DataFrame, cols: Sequence[str], key: str = START) -> DataFrame:
    """``(key, col, value, n)``: how often every text occurs in a window.

    One row per window, column and text leaves each task, however many columns
    there are; distinct counts and modes are read off this small table.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("col"), quoted(c).cast("string").alias("value")) for c in cols])
    return (
        rows.select(key, F.inline(cells)).filter("value is not null")
        .groupBy(key, "col", "value").agg(F.count("*").alias("n"))
    )


def distinct_counts(counts: DataFrame, cols: Sequence[str], key: str = START) -> DataFrame:
    """``{col}_nunique`` per window from the counts of values."""
    return counts.groupBy(key).agg(*[F.count_if(F.col("col") == c).alias(f"{c}_nunique") for c in cols])


def edge_values(rows: DataFrame, cols: Sequence[str], order: Sequence[str], key: str = START) -> DataFrame:
    """First and last non-NULL value of every column by ``order``, per window.

    The ends of the order, which have a fixed width, are found first; only rows at
    an end are looked at for their text.  Rows that tie give their smallest text.
    """
    when = F.struct(*[quoted(o) for o in order])
    has = [F.when(quoted(c).isNotNull(), when) for c in cols]
    ends = rows.groupBy(key).agg(*[
        f(h).alias(f"_{side}_{i}") for i, h in enumerate(has) for side, f in (("lo", F.min), ("hi", F.max))
    ])
    at = rows.select(key, when.alias("_at"), *[quoted(c).alias(f"_v_{i}") for i, c in enumerate(cols)]).join(ends, key)
    hits = [(F.col("_at") == F.col(f"_{side}_{i}")) & F.col(f"_v_{i}").isNotNull()
            for i in range(len(cols)) for side in ("lo", "hi")]
    some = reduce(lambda a, b: a | b, hits)
    return at.filter(some).groupBy(key).agg(*[
        F.min(F.when(F.col("_at") == F.col(f"_{side}_{i}"), F.col(f"_v_{i}"))).alias(f"{c}_{name}")
        for i, c in enumerate(cols) for side, name in (("lo", "first"), ("hi", "last"))
    ])


def window_features(
    df: DataFrame,
    size: str,
    numeric: Sequence[str] = (),
    text: Sequence[str] = (),
    edges: Sequence[str] = (),
    ts: str = "ts",
    uid: str | None = None,
    order: Sequence[str] = (),
    extra: Sequence[Column] = (),
    approximate: bool = False,
) -> DataFrame:
    """One row per non-empty window with the chosen features.

    Fixed-width features come from one hash aggregate.  Exact distinct counts come
    from counts of values, and edge values from the rows at the ends of a window;
    both are small tables beside it, joined by window.  With ``approximate`` the
    distinct counts join the first aggregate.
    """
    rows = windowed(df, size, ts)
    named = list(dict.fromkeys([*text, *edges]))
    aggs = [
        *numeric_features(numeric),
        *[F.count(quoted(c)).alias(f"{c}_count") for c in text],
        *_distinct(named, approximate),
    ]
    if uid:
        aggs += [F.count("*").alias("packet_count")]
        aggs += [F.approx_count_distinct(quoted(uid)).alias("flow_count")] if approximate else []
    table = rows.groupBy(START).agg(*(aggs or [F.count("*").alias("_rows")]), *extra)
    exact = [] if approximate else [*named, *([uid] if uid else [])]
    if exact:
        seen = distinct_counts(value_counts(rows, exact), exact)
        if uid:
            seen = seen.withColumn("flow_count", quoted(f"{uid}_nunique"))
            seen = seen if uid in named else seen.drop(f"{uid}_nunique")
        table = table.join(seen, START, "left")
    if edges:
        table = table.join(edge_values(rows, edges, order or [ts]), START, "left")
    wanted = [f"{c}_{s}" for c in numeric for s in ("min", "max", "mean")]
    wanted += [f"{c}_{s}" for c in text for s in ("count", "nunique")]
    wanted += [f"{c}_{s}" for c in edges for s in ("first", "last", "nunique") if f"{c}_{s}" not in wanted]
    wanted += ["flow_count", "packet_count"] if uid else []
    others = [c for c in table.columns if c not in (*wanted, START, "_rows")]
    zero = {c for c in wanted if c.endswith("_nunique") or c == "flow_count"}
    return table.select(
        START, *[F.coalesce(quoted(c), F.lit(0)).alias(c) if c in zero else quoted(c) for c in [*wanted, *others]]
    )


def any_attack(is_attack: Column) -> Column:
    """1 when any row of the window is an attack, else 0."""
    return F.max(F.coalesce(is_attack, F.lit(False)).cast("int"))


def first_attacks(rows: DataFrame, label: str, order: Sequence[str], benign: str = BENIGN, key: str = START) -> DataFrame:
    """The first label other than benign by ``order`` of every window that has one.

    Only attack rows take part, so windows of benign traffic cost nothing here.
    """
    attacks = rows.filter(quoted(label) != benign)
    return edge_values(attacks, [label], order, key).select(key, quoted(f"{label}_first").alias(label))


def with_first_attack(table: DataFrame, attacks: DataFrame, label: str = "label", benign: str = BENIGN) -> DataFrame:
    """Put the first attack beside window features; benign where a window has none."""
    return table.join(attacks, START, "left").withColumn(label, F.coalesce(quoted(label), F.lit(benign)))


def mode_labels(df: DataFrame, size: str, label: str = "label", ts: str = "ts") -> DataFrame:
    """The most frequent label of every window; the smallest name on ties.

    Labels are counted per window first, so the shuffle carries one row per window,
    label and task, and no task holds a dictionary of labels.
    """
    counts = (
        windowed(df, size, ts)
        .filter(quoted(label).isNotNull())
        .groupBy(START, quoted(label).alias("_label"))
        .agg(F.count("*").alias("_n"))
    )
    return counts.groupBy(START).agg(F.min_by("_label", F.struct(-F.col("_n"), F.col("_label"))).alias(label))


def window_label(
    df: DataFrame,
    size: str,
    how: str,
    label: str = "label",
    ts: str = "ts",
    is_attack: Column | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """Label per window: ``any`` (0/1), ``first_attack`` or ``mode``."""
    if how == "mode":
        return mode_labels(df, size, label, ts)
    if how == "any":
        value = any_attack(is_attack if is_attack is not None else quoted(label) != BENIGN)
    elif how == "first_attack":
        rows = windowed(df, size, ts)
        return with_first_attack(rows.select(START).distinct(), first_attacks(rows, label, order or [ts]), label)
    else:
        raise ValueError(f"unknown window label rule: {how}")
    return windowed(df, size, ts).groupBy(START).agg(value.alias(label))


def densify_windows(
    table: DataFrame, size: str, fill: float | None = None, counts: Sequence[str] = (), block: int = 100_000
) -> DataFrame:
    """Add the empty windows between the first and the last one.

    Counters in ``counts`` become 0, other numbers ``fill`` (NULL when not given),
    texts stay NULL.  Windows are numbered in steps of ``size`` from the first one,
    ``block`` numbers to a task, so any size keeps every start on its grid.
    """
    step = F.expr(f"interval {size}")
    bounds = table.agg(F.min(START).alias("lo"), F.max(START).alias("hi"))
    last = F.expr(f"(hi - lo) div interval {size}")
    blocks = bounds.where("lo is not null").select(
        "lo", last.alias("last"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / block))).alias("part")
    ).repartition(F.col("part"))
    numbers = F.sequence(F.col("part") * block, F.least(F.col("last"), (F.col("part") + 1) * block - 1))
    starts = blocks.select("lo", F.explode(numbers).alias("number")).select(
        (F.col("lo") + step * F.col("number")).alias(START)
    )
    dense = starts.join(table, START, "left")
    numbers = {f.name for f in table.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short")}
    out = []
    for c in table.columns:
        if c in counts:
            out.append(F.coalesce(quoted(c), F.lit(0)).alias(c))
        elif fill is not None and c in numbers:
            out.append(F.coalesce(quoted(c), F.lit(fill).cast(table.schema[c].dataType)).alias(c))
        else:
            out.append(quoted(c))
    return dense.select(*out)


def with_mode_label(features: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Put window labels beside window features; both are grouped by the window already."""
    return features.join(labels.select(START, quoted(label)), START, "left")
