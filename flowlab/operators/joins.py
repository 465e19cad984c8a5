"""Log merges, dictionary joins and planned-versus-done differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import quoted, strip
from ..scratch import materialize

HEAVY_ROWS = 1_000_000
NULL_PARTS = 1_024

_KEY, _OTHER, _PART, _OTHER_PART, _COPY, _FOUND = "_key", "_other_key", "_part", "_other_part", "_copy", "_found"


def _same(a: Column, b: Column, null_safe: bool) -> Column:
    return a.eqNullSafe(b) if null_safe else a == b


def _frequent(key: str, keep: int):
    """Misra-Gries summary of a partition's keys with ``keep`` counters, merged batch by batch.

    A key with more than ``rows / (keep + 1)`` rows in the partition stays in it.
    """

    def run(batches):
        import pandas as pd

        held = None
        for batch in batches:
            counts = batch[key].value_counts()
            held = counts if held is None else held.add(counts, fill_value=0)
            if len(held) > keep:
                cut = held.nlargest(keep + 1).iloc[-1]
                held = held[held > cut] - cut
        if held is not None and len(held):
            yield pd.DataFrame({key: held.index, "_c": held.to_numpy(dtype="int64")})

    return run


def candidate_keys(df: DataFrame, key: str, bar: float) -> DataFrame:
    """Keys that may have more than ``bar`` rows: a superset of them, from mergeable summaries.

    With ``keep = rows / bar`` counters per partition, a key above the bar overall is
    above ``partition rows / (keep + 1)`` in some partition, so its summary holds it.
    """
    rows = df.select(quoted(key).alias(_KEY)).filter(F.col(_KEY).isNotNull())
    total = rows.count()
    keep = max(1, int(total / max(bar, 1.0)))
    schema = f"{_KEY} {rows.schema[_KEY].dataType.simpleString()}, _c long"
    return rows.mapInPandas(_frequent(_KEY, keep), schema).select(_KEY).distinct()


def hot_keys(base: DataFrame, logs: list[DataFrame], key: str, null_safe: bool, heavy_rows: int) -> DataFrame:
    """``(_key, n0, m0, n1, m1, ...)`` for keys with more than ``heavy_rows`` rows on a side of some join.

    ``n{i}`` are the rows of the key in log i, ``m{i}`` those of everything merged
    before it.  A key whose rows are at most ``heavy_rows ** (1 / tables)`` in every
    table cannot pass ``heavy_rows``, fan-out included, so candidates are the keys
    that a Misra-Gries summary per partition finds above that bar in some table;
    only they are counted exactly.  No table is grouped by all its keys.  The NULL
    key is always a candidate when ``null_safe``.
    """
    tables = [base, *logs]
    bar = heavy_rows ** (1.0 / len(tables))
    found = reduce(DataFrame.unionByName, [candidate_keys(t, key, bar) for t in tables]).distinct()
    if null_safe:
        found = found.unionByName(base.sparkSession.range(1).select(F.lit(None).cast(found.schema[_KEY].dataType).alias(_KEY)))
    found = materialize(found, "candidates")

    def counts(df: DataFrame, name: str, as_key: str) -> DataFrame:
        rows = df.select(quoted(key).alias(as_key))
        rows = rows if null_safe else rows.filter(F.col(as_key).isNotNull())
        rows = rows.join(found.withColumnRenamed(_KEY, "_cand"), _same(F.col(as_key), F.col("_cand"), null_safe), "left_semi")
        return rows.groupBy(as_key).agg(F.count("*").alias(name))

    tally = counts(base, "m0", _KEY)
    for i, log in enumerate(logs):
        tally = tally.join(counts(log, f"n{i}", f"_k{i}"), _same(F.col(_KEY), F.col(f"_k{i}"), null_safe), "left").drop(f"_k{i}")
        tally = tally.withColumn(f"n{i}", F.coalesce(f"n{i}", F.lit(0))).withColumn(
            f"m{i + 1}", F.col(f"m{i}") * F.greatest(F.lit(1), F.col(f"n{i}")))
    hot = [(F.col(f"n{i}") > 0) & (F.greatest(f"n{i}", f"m{i}") > heavy_rows) for i in range(len(logs))]
    return materialize(tally.filter(reduce(lambda a, b: a | b, hot)), "hot_keys")


def left_join_on(
    base: DataFrame, other: DataFrame, key: str, hot: DataFrame, null_safe: bool = False, heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """Left outer many-to-many join on one key that stands hot and NULL keys on either side.

    ``other`` has no other column name in common with ``base``; ``hot`` has
    ``(_key, m, n)``, the rows of hot keys in ``base`` and in ``other``.  The join is
    on (key, part).  A hot key's larger side is dealt out over as many parts as it
    has multiples of ``heavy_rows``, and the smaller side is repeated in each.  A
    row's part follows from its content and its input partition, so a task that runs
    again deals alike, and copies of one row are spread too.  Base rows with a NULL key match nothing
    and are spread.  A repeated base row meets its matches in some parts only, so
    its copies without a match are dropped; a hot key occurs in ``other``, so no row
    is lost.
    """
    size = F.greatest("m", "n")
    parts = F.ceil(size / heavy_rows).cast("int")
    plan = hot.filter((F.col("n") > 0) & (size > heavy_rows)).select(
        F.col(_KEY).alias("_hot"), parts.alias("_parts"), (F.col("m") >= F.col("n")).alias("_deal_base"))

    def any_part(columns: list[str]) -> Column:
        dealt = F.xxhash64(F.spark_partition_id(), *[quoted(c) for c in columns])
        return F.pmod(dealt, F.coalesce("_parts", F.lit(NULL_PARTS))).cast("int")

    all_parts = F.sequence(F.lit(0), F.col("_parts") - 1)
    deal_base = F.coalesce("_deal_base", F.lit(True))

    left = base.join(plan, _same(quoted(key), F.col("_hot"), null_safe), "left")
    spread = F.col("_parts").isNotNull() if null_safe else F.col("_parts").isNotNull() | quoted(key).isNull()
    alone = F.when(spread, any_part(base.columns)).otherwise(0)
    left = left.withColumn(_COPY, ~deal_base).withColumn(
        _PART, F.explode(F.when(deal_base, F.array(alone)).otherwise(all_parts)))
    left = left.drop("_hot", "_parts", "_deal_base")
    right = other.withColumnRenamed(key, _OTHER)
    right = right if null_safe else right.filter(F.col(_OTHER).isNotNull())
    right = right.join(plan, _same(F.col(_OTHER), F.col("_hot"), null_safe), "left")
    one = F.when(F.col("_parts").isNull(), 0).otherwise(any_part([_OTHER, *[c for c in other.columns if c != key]]))
    dealt = F.col("_parts").isNull() | ~deal_base
    right = right.withColumn(_OTHER_PART, F.explode(F.when(dealt, F.array(one)).otherwise(all_parts)))
    right = right.drop("_hot", "_parts", "_deal_base").withColumn(_FOUND, F.lit(True))
    on = _same(quoted(key), F.col(_OTHER), null_safe) & (F.col(_PART) == F.col(_OTHER_PART))
    joined = left.join(right, on, "left")
    return joined.filter(~F.col(_COPY) | F.col(_FOUND).isNotNull()).drop(_PART, _OTHER_PART, _COPY, _FOUND, _OTHER)


def merge_logs(
    base: DataFrame, logs: dict[str, DataFrame], key: str = "uid", null_safe: bool = False, heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """Left-join companion logs onto the connection log by ``key``.

    Columns that clash with what is already there get the suffix ``_{log}``.  One
    base row fans out to every matching log row.  A NULL key matches nothing unless
    ``null_safe``.  Keys are counted first; those with more than ``heavy_rows`` rows
    on a side, fan-out included, are spread over tasks.
    """
    if not logs:
        return base
    hot = hot_keys(base, list(logs.values()), key, null_safe, heavy_rows)
    merged = base
    for i, (name, log) in enumerate(logs.items()):
        taken = set(merged.columns) - {key}
        side = log.select(*[quoted(c).alias(f"{c}_{name}") if c in taken else quoted(c) for c in log.columns])
        of = hot.select(_KEY, F.col(f"m{i}").alias("m"), F.col(f"n{i}").alias("n"))
        merged = left_join_on(merged, side, key, of, null_safe, heavy_rows)
    return merged


def _label_key(col: str) -> Column:
    return F.upper(strip(quoted(col)))


def map_labels(df: DataFrame, dim: DataFrame, col: str, out: str = "label_str") -> DataFrame:
    """Coarse class from a dictionary table ``(fine, coarse)``; '' when unknown.

    Labels are matched on trimmed upper-case text.  The planner broadcasts the
    dictionary while its size allows.
    """
    side = dim.select(F.upper(strip(F.col("fine"))).alias("_fine"), F.col("coarse").alias("_coarse"))
    joined = df.join(side, _label_key(col) == F.col("_fine"), "left")
    return joined.withColumn(out, F.coalesce("_coarse", F.lit(""))).drop("_fine", "_coarse")


def unmapped_labels(df: DataFrame, dim: DataFrame, col: str) -> DataFrame:
    """``(label, rows)`` of labels the dictionary does not know.

    Labels are counted before the anti join, so it sees one row per label.
    """
    counts = df.groupBy(quoted(col).alias("label")).agg(F.count("*").alias("rows"))
    known = dim.select(F.upper(strip(F.col("fine"))).alias("_fine"))
    return counts.join(known, _label_key("label") == F.col("_fine"), "left_anti")


def keep_mapped(df: DataFrame, dim: DataFrame, col: str) -> DataFrame:
    """Only rows whose label the dictionary knows."""
    known = dim.select(F.upper(strip(F.col("fine"))).alias("_fine"))
    return df.join(known, _label_key(col) == F.col("_fine"), "left_semi")


def planned_sessions(conditions: DataFrame, runs: int) -> DataFrame:
    """Every run number of every condition: the sessions an experiment asks for."""
    return conditions.select("condition", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))


def missing_sessions(plan: DataFrame, log: DataFrame, rounds: int) -> DataFrame:
    """Planned sessions whose log does not reach the last round."""
    done = (
        log.groupBy("condition", "run")
        .agg(F.max("server_round").alias("last_round"))
        .filter(F.col("last_round") >= rounds)
    )
    on = reduce(lambda a, b: a & b, [plan[c] == done[c] for c in ("condition", "run")])
    return plan.join(done, on, "left_anti")
