"""Privacy budget, clipped noisy means and sealed payload columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bind, quoted
from ..functions.vectors import clip_l2
from ..scratch import materialize
from .metrics import present_means, vector_sums

# The orders a budget is taken over
TENTH_ORDERS = tuple(range(11, 110))  # 1.1 to 10.9
WHOLE_ORDERS = (*range(11, 64), 128, 256, 512, 1024)
_POINTS = 500


def _log_sum(logs: Column) -> Column:
    """log of the sum of exponentials of an array."""
    return bind(logs, lambda ts: bind(F.array_max(ts), lambda peak: peak + F.ln(
        F.aggregate(ts, F.lit(0.0), lambda acc, t: acc + F.exp(t - peak)))))


def _whole_divergence(q: Column, s: Column, order: Column, factorials: Column) -> Column:
    """Binomial sum of Mironov, Talwar and Zhang (2019) for a whole order, in log space."""
    def term(k: Column) -> Column:
        log_choose = F.get(factorials, order) - F.get(factorials, k) - F.get(factorials, order - k)
        # 0 * log(0) counts as 0
        stay = F.when(k == order, F.lit(0.0)).otherwise((order - k) * F.log1p(-q))
        take = F.when(k == 0, F.lit(0.0)).otherwise(k * F.ln(q))
        return log_choose + stay + take + (k * k - k) / (2 * s * s)

    terms = F.filter(F.transform(F.sequence(F.lit(0), order), term), lambda t: t.isNotNull())
    return _log_sum(terms) / (order - 1)


def _tenth_divergence(q: Column, s: Column, tenths: Column) -> Column:
    """The same at a tenth order, by the trapezoid rule over one normal variable.

    The grid covers both peaks of the integrand in steps well below its width.
    """
    a = tenths / F.lit(10.0)

    def at(step: Column) -> Column:
        def point(i: Column) -> Column:
            t = i * step - 15 * s
            shift = (2 * t - 1) / (2 * s * s)
            # log((1 - q) + q * exp(shift)) without overflow
            mixed = F.when(shift > 0, shift + F.ln(q + (1 - q) * F.exp(-shift))).otherwise(
                F.ln((1 - q) + q * F.exp(shift)))
            return -(t * t) / (2 * s * s) - F.ln(s * F.lit(math.sqrt(2 * math.pi))) + a * mixed + F.ln(step)

        return _log_sum(F.transform(F.sequence(F.lit(0), F.lit(_POINTS)), point))

    return bind((a + 30 * s) / F.lit(float(_POINTS)), at) / (a - 1)


def renyi_curve(configs: DataFrame) -> DataFrame:
    """Renyi divergence of one noisy sampled step: ``(q, sigma, curve)`` per distinct setting.

    ``curve`` holds ``(alpha, rdp)`` for all orders; it is made inside its row.
    """
    q, s = F.col("q"), F.col("sigma")
    factorials = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(max(WHOLE_ORDERS) + 1)])
    settings = configs.select("q", "sigma").distinct().withColumn("_lf", factorials)
    whole = F.transform(F.array(*map(F.lit, WHOLE_ORDERS)), lambda a: F.struct(
        a.cast("double").alias("alpha"), _whole_divergence(q, s, a, F.col("_lf")).alias("rdp")))
    tenth = F.transform(F.array(*map(F.lit, TENTH_ORDERS)), lambda a: F.struct(
        (a / F.lit(10.0)).alias("alpha"), _tenth_divergence(q, s, a).alias("rdp")))
    return settings.select("q", "sigma", F.concat(tenth, whole).alias("curve"))


def privacy_ledger(clients: DataFrame, rounds: int, epochs: int = 1, batch: int | None = 32) -> DataFrame:
    """Cumulative epsilon per client and round: ``(client_id, server_round, steps, epsilon)``.

    ``clients`` has ``client_id, n, sigma, delta, dp_enabled``; ``n`` is the number
    of rows that train together.  With sampling rate ``batch / n`` and whole batches
    only, or one step per epoch over all rows for ``batch=None``, step counts grow
    linearly with rounds, so the divergence is computed once per distinct (q, sigma).
    Fewer rows than a batch take no step and cost nothing.  Epsilon is -1 when the
    protection is off, and infinite for steps without noise.  One set of orders serves every sigma.
    """
    n = F.col("n")
    rate = F.least(F.lit(1.0), F.lit(float(batch)) / n) if batch else F.lit(1.0)
    each = F.floor(n / batch) if batch else F.when(n > 0, 1).otherwise(0)
    plan = (
        clients.withColumn("q", rate)
        .withColumn("server_round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
        .withColumn("steps", (F.col("server_round") * epochs * each).cast("bigint"))
    )
    protected = F.coalesce(F.col("dp_enabled"), F.lit(False)) & (n > 0)
    per_setting = materialize(renyi_curve(clients.filter(protected & (each > 0) & (F.col("sigma") > 0)).withColumn("q", rate)), "curve")

    # conversion of Canonne, Kamath and Steinke (2020)
    def bound(p: Column) -> Column:
        a = p["alpha"]
        return F.col("steps") * p["rdp"] + F.log1p(-1 / a) - (F.ln(F.col("delta")) + F.ln(a)) / (a - 1)

    priced = plan.filter(protected).join(per_setting, ["q", "sigma"], "left").select(
        "client_id", "server_round", "steps",
        F.when(F.col("steps") == 0, 0.0).when(F.col("sigma") <= 0, float("inf")).otherwise(
            F.greatest(F.lit(0.0), F.array_min(F.transform("curve", bound)))).alias("epsilon"),
    )
    off = plan.filter(~protected).select(
        "client_id", "server_round", "steps", F.lit(-1.0).alias("epsilon")
    )
    return priced.unionByName(off)


def dp_vector_mean(
    df: DataFrame,
    group: Sequence[str],
    vec: str,
    clip: float,
    sigma: float,
    seed: int,
) -> DataFrame:
    """Mean of per-row clipped vectors with Gaussian noise of scale ``sigma * clip`` on the sum.

    The noise of an element is drawn from its group, position and seed, so a task
    that is run again draws the same noise; whoever knows the seed can subtract it.
    """
    clipped = df.withColumn("_clipped", clip_l2(quoted(vec), clip))
    sums = vector_sums(clipped, group, F.col("_clipped"), F.lit(1.0))
    keys = [quoted(g) for g in group]
    noisy = F.transform("total", lambda x, pos: x + F.lit(float(sigma * clip)) * hash_gaussian(seed, *keys, pos))
    return sums.select(*keys, present_means(noisy, F.col("weight"), F.col("count")).alias(vec))


def hash_gaussian(seed: int, *keys: Column) -> Column:
    """A standard normal draw fixed by seed and keys (Box-Muller on two hashes)."""
    def uniform(part: int) -> Column:
        bits = F.xxhash64(F.lit(seed), F.lit(part), *keys)
        return (F.pmod(bits, F.lit(2**53)).cast("double") + 0.5) / F.lit(float(2**53))

    return F.sqrt(-2 * F.ln(uniform(1))) * F.cos(F.lit(2 * math.pi) * uniform(2))


def round_key(secret: DataFrame, server_round: Column, keep_from: int | None = None) -> Column:
    """The AES-256 key of a round, derived from a one-row secret table; NULL without a round.

    With ``keep_from`` earlier rounds have no key, so their payloads stay closed.
    The secret is read from its table by a scalar subquery and is never part of the
    plan text.
    """
    master = secret.select("secret").scalar()
    key = F.unhex(F.sha2(F.concat(master, F.lit(":"), server_round.cast("string")), 256))
    return key if keep_from is None else F.when(server_round >= keep_from, key)


def seal(df: DataFrame, col: str, key: Column, out: str = "sealed") -> DataFrame:
    """AES-GCM encrypt a binary or text column with the key of its row.

    Adds ``out`` (nonce, body and tag; 28 bytes more than the input) and
    ``plain_bytes``, and drops the plain column.  Rows without a key get NULL.
    """
    plain = quoted(col).cast("binary")
    return (
        df.withColumn(out, F.aes_encrypt(plain, key, F.lit("GCM")))
        .withColumn("plain_bytes", F.octet_length(plain).cast("bigint"))
        .drop(col)
    )


def open_sealed(df: DataFrame, col: str, key: Column, out: str = "plain") -> DataFrame:
    """Decrypt a sealed column; NULL where the row has no key or the body was changed."""
    return df.withColumn(out, F.try_aes_decrypt(quoted(col), key, F.lit("GCM")))
