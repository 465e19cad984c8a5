"""Federated training of a softmax classifier on client shards.

How many shards a client's rows are dealt into is part of the training definition
and never follows from the size of the data.  With one shard, the default, a client
trains exactly as if alone.  With more, each shard trains by itself, in as many
tasks, and weights are averaged by rows.  A task holds the rows of one shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hash_order, quoted
from ..functions.vectors import assemble
from ..scratch import materialize, scratch_path
from ..sources.telemetry import append_telemetry, round_metrics, to_telemetry
from .encode import apply_scaler, fit_scaler
from .metrics import AGGREGATE, weighted_metrics, weighted_vector_mean
from .ordering import lookup
from .privacy import privacy_ledger
from .sample import stratified_split

UPDATE = "client_id int, shard int, num_examples bigint, weights array<double>, loss double, train_ns bigint"
PARTIAL = "client_id int, shard int, n bigint, loss double, g array<double>"
CLIENT_UPDATE = "client_id int, num_examples bigint, weights array<double>, loss double, train_ns bigint"


def initial_weights(features: int, classes: int) -> list[float]:
    """All-zero class weights, each class followed by its intercept."""
    return [0.0] * (classes * (features + 1))


def prepare_shards(df: DataFrame, features: Sequence[str], label: str, key: str, shards: int = 1) -> DataFrame:
    """``(client_id, shard, order, label, x)``; every client is dealt into ``shards`` by key hash."""
    return df.select(
        F.col("client_id").cast("int").alias("client_id"),
        F.pmod(F.xxhash64(quoted(key)), F.lit(shards)).cast("int").alias("shard"),
        hash_order("order", quoted(key)).alias("order"),
        quoted(label).cast("int").alias("label"),
        assemble(list(features)).alias("x"),
    )


@dataclass(frozen=True)
class Noise:
    """Gaussian noise on clipped example gradients, and the delta of its budget.

    Whoever knows the seed can subtract the noise: draw it with ``secret_seed``.
    """

    seed: int
    sigma: float = 1.1
    clip: float = 1.0
    delta: float = 1e-5


def _stream_trainer(
    held: dict[tuple[int, int], list[float]], weights: Sequence[float], classes: int, rate: float, batch: int,
    mu: float, noise: Noise | None, number: int, steps_before: dict[tuple[int, int], int],
) -> Callable[[tuple, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """One epoch of whole mini-batches over a unit's rows, read as a stream of Arrow batches.

    Rows arrive in their training order; rows left over from one Arrow batch are
    carried into the next, so memory holds one Arrow batch and one mini-batch.
    """
    start = list(weights)
    sigma, clip, seed = (noise.sigma, noise.clip, noise.seed) if noise else (0.0, 0.0, 0)

    def train(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time as clock

        import numpy as np

        began = clock.perf_counter_ns()
        unit = (int(key[0]), int(key[1]))
        anchor = np.asarray(start).reshape(classes, -1)
        w = np.asarray(held.get(unit, start), dtype=float).reshape(classes, -1)
        draw = np.random.default_rng([seed, number, unit[0], unit[1]])
        if sigma > 0:
            for _ in range(steps_before.get(unit, 0)):  # the draws of earlier epochs
                draw.normal(0.0, sigma * clip, w.shape)
        carry_x = np.empty((0, w.shape[1]))
        carry_y = np.empty((0, classes))
        n, loss_sum, steps = 0, 0.0, 0
        for part in batches:
            n += len(part)
            x = np.vstack([carry_x, np.column_stack([np.stack(part["x"].to_numpy()), np.ones(len(part))])])
            y = np.vstack([carry_y, np.eye(classes)[part["label"].to_numpy()]])
            whole = len(x) - len(x) % batch
            for at in range(0, whole, batch):
                xb, yb = x[at:at + batch], y[at:at + batch]
                scores = xb @ w.T
                scores -= scores.max(axis=1, keepdims=True)
                p = np.exp(scores)
                p /= p.sum(axis=1, keepdims=True)
                loss_sum += float(-np.log(np.clip((p * yb).sum(axis=1), 1e-12, None)).mean())
                steps += 1
                error = p - yb
                if clip > 0:
                    # an example's gradient is an outer product, so its length is too
                    length = np.linalg.norm(error, axis=1) * np.linalg.norm(xb, axis=1)
                    error = error / np.maximum(1.0, length / clip)[:, None]
                step = error.T @ xb
                if sigma > 0:
                    step = step + draw.normal(0.0, sigma * clip, step.shape)
                w = w - rate * (step / batch + mu * (w - anchor))
            carry_x, carry_y = x[whole:], y[whole:]
        yield pd.DataFrame({
            "client_id": [unit[0]], "shard": [unit[1]], "num_examples": [n], "weights": [w.ravel().tolist()],
            "loss_sum": [loss_sum], "steps": [steps], "train_ns": [clock.perf_counter_ns() - began],
        })

    return train


EPOCH = "client_id int, shard int, num_examples bigint, weights array<double>, loss_sum double, steps bigint, train_ns bigint"


def minibatch_update(
    shards: DataFrame,
    weights: Sequence[float],
    classes: int,
    epochs: int,
    rate: float,
    batch: int,
    mu: float = 0.0,
    noise: Noise | None = None,
    number: int = 0,
    prepared: bool = False,
) -> DataFrame:
    """Mini-batch training of every unit, one streamed pass per epoch.

    A unit's rows meet in one task, in order, but are read batch by batch, so a
    unit of any size trains in bounded memory.  ``prepared`` says that ``shards``
    is already partitioned by unit and sorted by ``order`` within it.  The weights
    of each unit, units times the model size, go through the driver between epochs.
    """
    if not prepared:
        shards = shards.repartition("client_id", "shard").sortWithinPartitions("client_id", "shard", "order")
    rows = shards.select("client_id", "shard", "order", "label", "x")
    held: dict[tuple[int, int], list[float]] = {}
    done: dict[tuple[int, int], list] = {}
    for _ in range(epochs):
        steps_before = {u: d[3] for u, d in done.items()}
        trained = rows.groupBy("client_id", "shard").applyInPandas(
            _stream_trainer(held, weights, classes, rate, batch, mu, noise, number, steps_before), EPOCH).collect()
        for r in trained:
            unit = (r["client_id"], r["shard"])
            held[unit] = list(r["weights"])
            d = done.setdefault(unit, [r["num_examples"], 0.0, 0, 0])
            d[1] += r["loss_sum"]
            d[2] += r["train_ns"]
            d[3] += r["steps"]
    made = [(u[0], u[1], d[0], held[u], d[1] / d[3] if d[3] else None, d[2]) for u, d in sorted(done.items())]
    return shards.sparkSession.createDataFrame(made, UPDATE)


def _partial_gradients(
    held: dict[tuple[int, int], list[float]], start: Sequence[float], classes: int, clip: float
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per partition: the summed (clipped) example gradients of each unit at its current weights."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        anchor = np.asarray(start, dtype=float).reshape(classes, -1)
        weights = {u: np.asarray(w, dtype=float).reshape(classes, -1) for u, w in held.items()}
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            if batch.empty:
                continue
            x = np.column_stack([np.stack(batch["x"].to_numpy()), np.ones(len(batch))])
            y = np.eye(classes)[batch["label"].to_numpy()]
            keys = batch["client_id"].to_numpy().astype(np.int64) * (1 << 32) + batch["shard"].to_numpy()
            for key in np.unique(keys):
                rows = keys == key
                unit = (int(key >> 32), int(key & 0xFFFFFFFF))
                w = weights.get(unit, anchor)
                xb, yb = x[rows], y[rows]
                scores = xb @ w.T
                scores -= scores.max(axis=1, keepdims=True)
                p = np.exp(scores)
                p /= p.sum(axis=1, keepdims=True)
                loss = float(-np.log(np.clip((p * yb).sum(axis=1), 1e-12, None)).sum())
                error = p - yb
                if clip > 0:
                    length = np.linalg.norm(error, axis=1) * np.linalg.norm(xb, axis=1)
                    error = error / np.maximum(1.0, length / clip)[:, None]
                acc = sums.setdefault(unit, [0, 0.0, np.zeros_like(anchor)])
                acc[0] += int(rows.sum())
                acc[1] += loss
                acc[2] += error.T @ xb
        if not sums:  # a partition without rows: an empty column has no type that Arrow takes for a list
            return
        yield pd.DataFrame({
            "client_id": [u[0] for u in sums], "shard": [u[1] for u in sums],
            "n": [a[0] for a in sums.values()], "loss": [a[1] for a in sums.values()],
            "g": [a[2].ravel().tolist() for a in sums.values()],
        })

    return run


def _merge_partials() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One unit's partial sums, one row per partition, added up.

    An inner function travels whole to the executors, which need not hold this package.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        return pd.DataFrame({
            "client_id": [int(rows["client_id"].iloc[0])], "shard": [int(rows["shard"].iloc[0])],
            "n": [int(rows["n"].sum())], "loss": [float(rows["loss"].sum())],
            "g": [np.sum(np.stack(rows["g"].to_numpy()), axis=0).tolist()],
        })

    return run


def full_batch_update(
    shards: DataFrame,
    weights: Sequence[float],
    classes: int,
    epochs: int = 2,
    rate: float = 0.1,
    mu: float = 0.0,
    noise: Noise | None = None,
    number: int = 0,
) -> DataFrame:
    """Full-batch local training of every unit (client and shard) as distributed aggregates.

    Each step, every partition sums the (clipped) example gradients of the units it
    holds at their current weights, one row per unit; a grouped merge adds these
    rows up per unit (as many rows as partitions), and the weights of each unit
    move once.  Rows stay where they are, so a client of any size trains in as many
    tasks as it has partitions.  Only the units' weights and summed gradients,
    units times the model size, pass through the driver.  Noise is drawn per unit
    and step from ``(seed, round, client, shard)``, as the grouped trainer does.
    """
    import time as clock

    import numpy as np

    began = clock.perf_counter_ns()
    spark = shards.sparkSession
    anchor = np.asarray(weights, dtype=float).reshape(classes, -1)
    sigma, clip, seed = (noise.sigma, noise.clip, noise.seed) if noise else (0.0, 0.0, 0)
    current: dict[tuple[int, int], np.ndarray] = {}
    losses: dict[tuple[int, int], list[float]] = {}
    sizes: dict[tuple[int, int], int] = {}
    draws: dict[tuple[int, int], np.random.Generator] = {}
    rows = shards.select("client_id", "shard", "label", "x")
    for _ in range(epochs):
        held = {u: w.ravel().tolist() for u, w in current.items()}
        summed = (rows.mapInPandas(_partial_gradients(held, list(weights), classes, clip), PARTIAL)
                  .groupBy("client_id", "shard").applyInPandas(_merge_partials(), PARTIAL).collect())
        for row in summed:
            unit = (row["client_id"], row["shard"])
            w = current.get(unit, anchor)
            step = np.asarray(row["g"], dtype=float).reshape(classes, -1)
            if sigma > 0:
                draw = draws.setdefault(unit, np.random.default_rng([seed, number, unit[0], unit[1]]))
                step = step + draw.normal(0.0, sigma * clip, step.shape)
            current[unit] = w - rate * (step / row["n"] + mu * (w - anchor))
            losses.setdefault(unit, []).append(row["loss"] / row["n"])
            sizes[unit] = row["n"]
    spent = clock.perf_counter_ns() - began
    clients: dict[int, list] = {}
    for unit, w in current.items():
        acc = clients.setdefault(unit[0], [0, 0.0, 0.0, np.zeros_like(anchor)])
        n = sizes[unit]
        acc[0] += n
        acc[1] += float(np.mean(losses[unit])) * n
        acc[2] += n
        acc[3] += w * n
    made = [(c, a[0], (a[3] / a[0]).ravel().tolist(), a[1] / a[2], spent) for c, a in sorted(clients.items())]
    return spark.createDataFrame(made, CLIENT_UPDATE)


def local_update(
    shards: DataFrame,
    weights: Sequence[float],
    classes: int,
    epochs: int = 2,
    rate: float = 0.1,
    batch: int | None = 32,
    mu: float = 0.0,
    noise: Noise | None = None,
    number: int = 0,
    prepared: bool = False,
) -> DataFrame:
    """One training round per client from the given global weights.

    ``shards`` comes from ``prepare_shards``.  Whole mini-batches only, as the step
    counts of the privacy ledger assume: a shard of fewer rows than ``batch`` takes
    no step and has no loss.  ``batch=None`` makes each step over the whole shard;
    such steps run as distributed aggregates (``full_batch_update``), while
    mini-batches stream a shard's rows through one task in bounded memory
    (``minibatch_update``; ``prepared``: rows already dealt by unit and sorted).
    ``mu`` pulls local weights towards the global ones (proximal term); ``noise``
    clips example gradients and adds Gaussian noise to each step.  Returns
    ``(client_id, num_examples, weights, loss, train_ns)``, one row per client.
    """
    if batch is None:
        return full_batch_update(shards, weights, classes, epochs, rate, mu, noise, number)
    trained = minibatch_update(shards, weights, classes, epochs, rate, batch, mu, noise, number, prepared)
    # one aggregate for model and notes, so that shards train once
    n = F.col("num_examples")
    heard = F.when(F.col("loss").isNotNull(), n)
    elements = trained.select("client_id", "num_examples", "loss", "train_ns", F.posexplode("weights").alias("pos", "w"))
    means = elements.groupBy("client_id", "pos").agg(
        (F.sum(F.col("w") * n) / F.sum(n)).alias("x"),
        (F.sum(F.col("loss") * heard) / F.sum(heard)).alias("loss"),
        F.sum(n).alias("num_examples"),
        F.max("train_ns").alias("train_ns"),
    )
    return (
        means.groupBy("client_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_cells"),
            F.max("num_examples").alias("num_examples"),
            F.max("loss").alias("loss"),
            F.max("train_ns").alias("train_ns"),
        )
        .select("client_id", "num_examples", F.col("_cells.x").alias("weights"), "loss", "train_ns")
    )


def class_scores(x: str, weights: Column, classes: int, features: int) -> list[Column]:
    """Linear class scores of the feature array in column ``x`` for one array of all weights."""
    width = features + 1
    out = []
    for c in range(classes):
        row = F.slice(weights, c * width + 1, features)
        products = F.zip_with(quoted(x), row, lambda a, b: a * b)
        out.append(F.aggregate(products, F.get(weights, F.lit(c * width + features)), lambda total, v: total + v))
    return out


def weight_array(spark: SparkSession, weights: Sequence[float]) -> Column:
    """The weights as a scalar subquery on a one-row table, which keeps them out of the query text."""
    return spark.createDataFrame([([float(w) for w in weights],)], "weights array<double>").scalar()


def evaluate_clients(
    df: DataFrame, weights: Sequence[float], classes: int, features: int, label: str = "label", x: str = "x"
) -> DataFrame:
    """``(client_id, loss, accuracy, num_examples)`` of fixed weights, from expressions only."""
    scored = df.withColumn("_held", weight_array(df.sparkSession, weights)).select(
        "client_id",
        quoted(label).alias("_y"),
        F.array(*class_scores(x, F.col("_held"), classes, features)).alias("_s"),
    )
    top = F.array_max("_s")
    total = F.aggregate("_s", F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    loss = top + F.ln(total) - F.get("_s", F.col("_y"))
    hit = (F.array_position("_s", top) - 1) == F.col("_y")
    return (
        scored.select("client_id", loss.alias("_loss"), hit.cast("double").alias("_hit"))
        .groupBy("client_id")
        .agg(
            F.avg("_loss").alias("loss"),
            F.avg("_hit").alias("accuracy"),
            F.count("*").alias("num_examples"),
        )
    )


def secret_seed(secret: DataFrame) -> int:
    """A seed for noise from a one-row table with the column ``secret``."""
    return secret.select(F.xxhash64(F.sha2(F.concat(F.col("secret"), F.lit(":noise")), 256))).first()[0] & (1 << 63) - 1


def federated_fit(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    classes: int,
    key: str,
    rounds: int,
    epochs: int = 2,
    rate: float = 0.1,
    batch: int | None = 32,
    mu: float = 0.0,
    noise: Noise | None = None,
    test: float = 0.0,
    condition: str = "A_baseline",
    run: int = 1,
    shards: int = 1,
) -> tuple[list[float], DataFrame]:
    """Federated rounds: local updates, weighted average, evaluation, telemetry.

    ``mu`` switches on the proximal term and ``noise`` private steps, whose budget
    is logged per client and round; a client of several shards is charged for the
    costliest, as each row is in one of them.  The model is evaluated on the
    training rows, or on a stratified share ``test`` that no client trains on.

    Shards are partitioned and sorted once and kept, so rounds neither shuffle nor
    sort the rows again.  A round writes its updates and its scores; telemetry is
    made of them once, after the last round.  Only the averaged model, whose size
    the feature list fixes, returns to the driver.  Gives the final weights and a
    telemetry table.
    """
    spark = df.sparkSession
    marked = stratified_split(df, label, test, [key]) if test > 0 else df
    train = marked.filter("not is_test") if test > 0 else marked
    dealt = prepare_shards(train, features, label, key, shards)
    if batch is not None:
        # a mini-batch trainer holds a shard in one task
        dealt = dealt.repartition("client_id", "shard").sortWithinPartitions("client_id", "shard", "order")
    dealt = dealt.persist()
    # filled here, so that every round sees the partitioning
    sizes = materialize(dealt.groupBy("client_id", "shard").agg(F.count("*").alias("n")), "shards")
    judged = dealt
    if test > 0:
        judged = marked.filter("is_test").select(
            F.col("client_id").cast("int").alias("client_id"),
            quoted(label).cast("int").alias("label"),
            assemble(list(features)).alias("x"),
        ).persist()
    weights = initial_weights(len(features), classes)
    updates, scores = [], []
    try:
        for number in range(1, rounds + 1):
            made = local_update(dealt, weights, classes, epochs, rate, batch, mu, noise, number, prepared=True)
            updates.append(materialize(made.withColumn("server_round", F.lit(number)), "updates"))
            weights = list(weighted_vector_mean(updates[-1], ["server_round"], "weights", "num_examples").first()["weights"])
            found = evaluate_clients(judged, weights, classes, len(features))
            scores.append(materialize(found.withColumn("server_round", F.lit(number)), "scores"))
    finally:
        dealt.unpersist()
        judged.unpersist()
    path = scratch_path(spark, "rounds")
    stamp = [F.lit(condition).alias("condition"), F.lit(run).alias("run")]
    sent = reduce(DataFrame.unionByName, updates)
    if noise:
        plan = sizes.select(
            F.struct("client_id", "shard").alias("client_id"), "n", F.lit(noise.sigma).alias("sigma"),
            F.lit(noise.delta).alias("delta"), F.lit(True).alias("dp_enabled"))
        spent = privacy_ledger(plan, rounds, epochs, batch).groupBy(
            F.col("client_id.client_id").alias("client_id"), "server_round").agg(F.max("epsilon").alias("epsilon"))
        sent = lookup(sent, materialize(spent, "budget"), ["client_id", "server_round"], ["epsilon"])
    else:
        sent = sent.withColumn("epsilon", F.lit(None).cast("double"))
    append_telemetry(_round_rows(sent, reduce(DataFrame.unionByName, scores), stamp), path)
    return weights, spark.read.schema(to_telemetry(df.limit(0).select()).schema).parquet(path)


def _round_rows(sent: DataFrame, scores: DataFrame, stamp: list[Column]) -> DataFrame:
    """Telemetry of all rounds: a fit row and a score row per client, a joint row per round."""
    clock = F.lit(None).cast("bigint")
    fit_rows = round_metrics(sent.select(
        *stamp, "server_round", "client_id", "train_ns",
        F.octet_length(F.to_json("weights")).cast("bigint").alias("plain_bytes"), clock.alias("sealed_bytes"), "epsilon",
        clock.alias("encap_ns"), clock.alias("sym_enc_ns"),
    ))
    total = weighted_metrics(scores, ["server_round"])
    joint = total.select(
        *stamp, "server_round", F.lit(AGGREGATE).alias("client_id"), "global_loss", "global_accuracy",
        F.lit(AGGREGATE).alias("eval_client_id"),
        F.col("global_loss").alias("eval_loss"), F.col("global_accuracy").alias("eval_accuracy"),
    )
    own = scores.join(total.select("server_round", "global_loss", "global_accuracy"), "server_round").select(
        *stamp, "server_round", "client_id", "global_loss", "global_accuracy",
        F.col("client_id").alias("eval_client_id"),
        F.col("loss").alias("eval_loss"), F.col("accuracy").alias("eval_accuracy"),
    )
    return fit_rows.unionByName(to_telemetry(joint)).unionByName(to_telemetry(own))


def fit_baseline(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    test: float = 0.2,
    seed: int = 42,
    hidden: Sequence[int] | None = None,
    save_to: str | None = None,
) -> DataFrame:
    """Central baseline: split, scale on the training rows, train, score the test rows.

    Logistic regression, or a multilayer perceptron when ``hidden`` layer sizes are
    given.  Returns ``(key, label, score)`` with the probability of class 1.
    """
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    needed = df.select(quoted(key), quoted(label), *[quoted(f) for f in features])
    # written once: scaling, training and scoring each read it again
    marked = materialize(stratified_split(needed, label, test, [key], seed), "marked")
    stats = materialize(fit_scaler(marked.filter("not is_test"), features), "scaler")
    scaled = apply_scaler(marked, stats, features).withColumn("label_", quoted(label).cast("double"))
    rows = VectorAssembler(inputCols=list(features), outputCol="x").transform(scaled)
    if hidden is None:
        learner = LogisticRegression(featuresCol="x", labelCol="label_", maxIter=50, regParam=0.01)
    else:
        learner = MultilayerPerceptronClassifier(
            featuresCol="x", labelCol="label_", layers=[len(features), *hidden, 2], seed=seed, maxIter=50
        )
    model = learner.fit(rows.filter("not is_test"))
    if save_to:
        model.write().overwrite().save(save_to)
    scored = model.transform(rows.filter("is_test"))
    return scored.select(
        quoted(key), quoted(label), F.get(vector_to_array("probability"), F.lit(1)).alias("score")
    )
