"""Distributions, weighted averages, experiment summaries and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import quoted, to_num
from .ordering import running_total

# Metrics of an experiment summary; the last three named here are
# taken from the final round of a run.
ROUND_METRICS = (
    "train_time_ms",
    "pqc_total_overhead_ms",
    "pqc_encap_ms",
    "sym_enc_ms",
    "encrypted_payload_bytes",
    "plaintext_payload_bytes",
    "eval_accuracy",
)
FINAL_METRICS = ("epsilon_consumed", "global_accuracy", "global_loss")

AGGREGATE = "aggregate"


def class_distribution(df: DataFrame, col: str) -> DataFrame:
    """``(col, rows, percent)`` per class; sort the small result as needed."""
    counts = df.groupBy(quoted(col)).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    return counts.withColumn("percent", F.try_divide(F.col("rows") * F.lit(100.0), total))


def attack_ratio(df: DataFrame, is_attack: Column) -> DataFrame:
    """One row: attacks, normal rows and the attack percentage (NULL when empty)."""
    hit = F.coalesce(is_attack, F.lit(False))
    return df.agg(F.count_if(hit).alias("attacks"), F.count_if(~hit).alias("normal")).withColumn(
        "attack_percent", F.try_divide(F.col("attacks") * F.lit(100.0), F.col("attacks") + F.col("normal"))
    )


VECTOR_BLOCK = 1 << 16
_PARTS = "_block int, total array<double>, weight array<double>, count array<long>"


def _vector_partials(keys: list[str]):
    """Per partition: weighted sums of whole vectors per group, cut into blocks of positions."""

    def run(batches):
        import numpy as np
        import pandas as pd

        held: dict[tuple, list] = {}
        for batch in batches:
            groups = batch.groupby(keys, dropna=False, sort=False) if keys else [((), batch)]
            for key, part in groups:
                key = key if isinstance(key, tuple) else (key,)
                vecs = part["_v"].tolist()
                width = max((len(v) for v in vecs if v is not None), default=0)
                if width == 0:
                    continue
                m = np.full((len(vecs), width), np.nan)
                for i, v in enumerate(vecs):
                    if v is not None and len(v):
                        m[i, :len(v)] = np.asarray(v, dtype=float)
                w = part["_w"].to_numpy(dtype=float, na_value=np.nan)
                present = ~np.isnan(m)
                used = present & ~np.isnan(w)[:, None]
                add = [np.where(used, m * w[:, None], 0.0).sum(0), np.where(used, w[:, None], 0.0).sum(0),
                       present.sum(0).astype(np.int64)]
                old = held.get(key)
                if old is None:
                    held[key] = add
                    continue
                size = max(len(old[0]), width)
                held[key] = [np.pad(a, (0, size - len(a))) + np.pad(b, (0, size - len(b))) for a, b in zip(old, add)]
        rows = []
        for key, (total, weight, count) in held.items():
            for b in range(0, len(total), VECTOR_BLOCK):
                rows.append((*key, b // VECTOR_BLOCK, total[b:b + VECTOR_BLOCK].tolist(),
                             weight[b:b + VECTOR_BLOCK].tolist(), count[b:b + VECTOR_BLOCK].tolist()))
        yield pd.DataFrame(rows, columns=[*keys, "_block", "total", "weight", "count"])

    return run


def _merge_blocks(keys: list[str]):
    def run(rows):
        import numpy as np
        import pandas as pd

        size = max(len(v) for v in rows["total"])
        out = {k: [rows[k].iloc[0]] for k in [*keys, "_block"]}
        for name, kind in (("total", float), ("weight", float), ("count", np.int64)):
            out[name] = [np.sum([np.pad(np.asarray(v, dtype=kind), (0, size - len(v))) for v in rows[name]],
                                axis=0).tolist()]
        return pd.DataFrame(out)

    return run


def vector_sums(df: DataFrame, group: Sequence[str], vec: Column, weight: Column) -> DataFrame:
    """``(group, total, weight, count)``: position-wise weighted sums of whole vectors per group.

    Each partition adds up its vectors per group in numpy and sends one row per
    group and block of ``VECTOR_BLOCK`` positions; these are added up per group and
    block, then blocks are put back in order.  Rows shuffled are groups times
    partitions times blocks, never one per element.  ``weight`` sums the weights of
    the rows that hold an element at a position, ``count`` counts them; a null or NaN
    element and a null weight add nothing.
    """
    keys = [g for g in group]
    staged = df.select(*[quoted(g).alias(g) for g in keys], vec.alias("_v"), weight.cast("double").alias("_w"))
    key_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in staged.schema.fields if f.name in keys)
    schema = f"{key_fields}, {_PARTS}" if key_fields else _PARTS
    parts = staged.mapInPandas(_vector_partials(keys), schema)
    merged = parts.groupBy(*[quoted(g) for g in keys], "_block").applyInPandas(_merge_blocks(keys), schema)
    ordered = F.array_sort(F.collect_list(F.struct("_block", "total", "weight", "count")))
    return merged.groupBy(*[quoted(g) for g in keys]).agg(ordered.alias("_s")).select(
        *[quoted(g) for g in keys], F.flatten("_s.total").alias("total"), F.flatten("_s.weight").alias("weight"),
        F.flatten("_s.count").alias("count"))


def present_means(total: Column, weight: Column, count: Column) -> Column:
    """Total over weight at the positions some vector holds, in order."""
    held = F.filter(F.arrays_zip(total.alias("t"), weight.alias("w"), count.alias("c")), lambda z: z["c"] > 0)
    return F.transform(held, lambda z: F.try_divide(z["t"], z["w"]))


def weighted_vector_mean(df: DataFrame, group: Sequence[str], vec: str, weight: str) -> DataFrame:
    """Element-wise mean of model vectors weighted by example counts, one array per group."""
    sums = vector_sums(df, group, quoted(vec), quoted(weight))
    return sums.select(*[quoted(g) for g in group], present_means(F.col("total"), F.col("weight"), F.col("count")).alias(vec))


def weighted_metrics(
    df: DataFrame, by: Sequence[str], loss: str = "loss", accuracy: str = "accuracy", n: str = "num_examples"
) -> DataFrame:
    """Loss and accuracy per round weighted by examples; a missing accuracy counts as 0."""
    w = quoted(n).cast("double")
    return df.groupBy(*[quoted(b) for b in by]).agg(
        F.try_divide(F.sum(quoted(loss) * w), F.sum(w)).alias("global_loss"),
        F.try_divide(F.sum(F.coalesce(quoted(accuracy), F.lit(0.0)) * w), F.sum(w)).alias("global_accuracy"),
        F.sum(quoted(n)).alias("num_examples"),
    )


def summarise_experiments(telemetry: DataFrame, include_aggregate: bool = False) -> DataFrame:
    """``(condition, metric, n, mean, std)`` over the rounds and runs of an experiment.

    Unreadable numbers are skipped.  Loss, accuracy and epsilon of the global model
    are taken from the last round of each run that has them, and an epsilon below
    0 (protection off) is left out.  ``eval_accuracy`` averages client rows only,
    unless ``include_aggregate``.

    Rows are reduced where they are read, by hash aggregates over fixed-width
    numbers; only the few rows of conditions and rounds are unpivoted.
    """
    client = F.coalesce(F.col("eval_client_id") != AGGREGATE, F.lit(True))
    rows = telemetry.select(
        "condition", "run", F.col("server_round").try_cast("int").alias("server_round"),
        *[to_num(quoted(m)).alias(m) for m in (*ROUND_METRICS, *FINAL_METRICS) if m != "eval_accuracy"],
        (to_num(quoted("eval_accuracy")) if include_aggregate
         else F.when(client, to_num(quoted("eval_accuracy")))).alias("eval_accuracy"),
    ).filter("server_round is not null")

    def unpivoted(df: DataFrame, metrics: Sequence[str], parts: Sequence[str], keys: Sequence[str]) -> DataFrame:
        cells = [F.struct(F.lit(m).alias("metric"), *[F.col(f"{m}_{p}").alias(p) for p in parts]) for m in metrics]
        return df.select(*keys, F.inline(F.array(*cells)))

    stats = rows.groupBy("condition").agg(*[
        f(m).alias(f"{m}_{part}") for m in ROUND_METRICS
        for part, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp))
    ])
    per_round = unpivoted(stats, ROUND_METRICS, ["n", "mean", "std"], ["condition"]).filter("n > 0")
    largest = rows.groupBy("condition", "run", "server_round").agg(*[F.max(m).alias(f"{m}_value") for m in FINAL_METRICS])
    final = (
        unpivoted(largest, FINAL_METRICS, ["value"], ["condition", "run", "server_round"]).filter("value is not null")
        .groupBy("condition", "run", "metric")
        .agg(F.max_by("value", "server_round").alias("value"))
        .filter("metric <> 'epsilon_consumed' or value >= 0")
        .groupBy("condition", "metric")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    )
    return per_round.unionByName(final)


def convergence(telemetry: DataFrame) -> DataFrame:
    """Mean and standard deviation of global accuracy per condition and round, with the band."""
    return (
        telemetry.filter(F.col("client_id") == AGGREGATE)
        .select("condition", F.col("server_round").try_cast("int").alias("server_round"),
                to_num(F.col("global_accuracy")).alias("accuracy"))
        .groupBy("condition", "server_round")
        .agg(
            F.avg("accuracy").alias("mean"),
            F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0)).alias("std"),
        )
        .select("condition", "server_round", "mean", "std",
                (F.col("mean") - F.col("std")).alias("low"), (F.col("mean") + F.col("std")).alias("high"))
    )


def overhead_pct(df: DataFrame, base: str, other: str, metrics: Sequence[str], condition: str = "condition") -> DataFrame:
    """``(metric, base_mean, other_mean, overhead_percent)``; NULL when the base is 0."""
    aggs = []
    for m in metrics:
        x = to_num(quoted(m))
        aggs.append(
            F.struct(
                F.lit(m).alias("metric"),
                F.avg(F.when(quoted(condition) == base, x)).alias("base_mean"),
                F.avg(F.when(quoted(condition) == other, x)).alias("other_mean"),
            ).alias(m)
        )
    wide = df.filter(quoted(condition).isin(base, other)).agg(*aggs)
    gap = (F.col("other_mean") - F.col("base_mean")) * F.lit(100.0)
    return wide.select(F.inline(F.array(*[quoted(m) for m in metrics]))).withColumn(
        "overhead_percent", F.try_divide(gap, F.col("base_mean"))
    )


def binary_metrics(df: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """One row: confusion counts, accuracy, precision, recall, false-positive rate, F1."""
    truth, hit = quoted(label) == 1, quoted(score) > threshold
    counts = df.filter(quoted(label).isNotNull() & quoted(score).isNotNull()).agg(
        F.count_if(truth & hit).alias("tp"),
        F.count_if(~truth & hit).alias("fp"),
        F.count_if(truth & ~hit).alias("fn"),
        F.count_if(~truth & ~hit).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "tp", "fp", "fn", "tn",
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(fp, fp + tn).alias("false_positive_rate"),
        F.try_divide(tp * 2, tp * 2 + fp + fn).alias("f1"),
    )


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: area under the ROC curve, ties counted half.

    Rows are reduced to one per distinct score; positives below each score come
    from running totals over range blocks, so no task sorts all scores.
    """
    groups = (
        df.filter(quoted(label).isNotNull() & quoted(score).isNotNull())
        .groupBy(quoted(score).cast("double").alias("score"))
        .agg(F.count_if(quoted(label) == 1).alias("pos"), F.count_if(quoted(label) != 1).alias("neg"))
    )
    ranked = running_total(groups, ["score"], {"neg_upto": F.col("neg")})
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    wins = F.sum(pos * (F.col("neg_upto") - F.col("neg")) + pos * neg / 2)
    return ranked.agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.try_divide(wins, F.sum(pos) * F.sum(neg)).alias("auc"),
    )


def payload_stats(df: DataFrame, by: Sequence[str], plain: str = "plain", sealed: str = "sealed") -> DataFrame:
    """Payload counts and bytes per round, plain against sealed."""
    return df.groupBy(*[quoted(b) for b in by]).agg(
        F.count("*").alias("payloads"),
        F.sum(F.octet_length(quoted(plain)).cast("bigint")).alias("plain_bytes"),
        F.sum(F.octet_length(quoted(sealed)).cast("bigint")).alias("sealed_bytes"),
    ).withColumn("overhead_bytes", F.col("sealed_bytes") - F.col("plain_bytes"))


def valid_payloads(df: DataFrame, parts: str = "parts") -> DataFrame:
    """Payloads that have exactly three parts, none of them missing."""
    p = quoted(parts)
    return df.filter((F.size(p) == 3) & ~F.exists(p, lambda x: x.isNull()))
