"""Merged flows to tumbling-window features with a label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from ..functions.scalars import quoted, to_num
from ..operators.clean import FLOW_NUMBERS
from ..operators.sample import fraction_sample
from ..operators.windows import (
    START,
    any_attack,
    densify_windows,
    first_attacks,
    mode_labels,
    window_features,
    windowed,
    with_first_attack,
    with_mode_label,
)


def window_table(
    flows: DataFrame,
    size: str = "5 minutes",
    numbers: Sequence[str] = FLOW_NUMBERS,
    text: Sequence[str] = (),
    edges: Sequence[str] = (),
    label: str = "label",
    rule: str = "any",
    is_attack: Column | None = None,
    uid: str | None = "uid",
    order: Sequence[str] = (),
    fraction: float = 1.0,
    key: Sequence[str] = (),
    densify: bool = False,
    fill: float | None = None,
    seed: int = 42,
    approximate: bool = False,
) -> DataFrame:
    """One row per window: ``{col}_min/max/mean``, counts, text features and the label.

    Unreadable numbers count as 0.  The label rule is ``any``, ``first_attack`` or
    ``mode``.  ``any`` shares the features' aggregate; the others read labels in a
    second, narrow pass.  ``approximate`` estimates distinct counts.
    """
    source = fraction_sample(flows, fraction, key, seed) if fraction < 1.0 else flows
    have = [c for c in numbers if c in source.columns]
    typed = source.select(*[to_num(quoted(c), 0.0).alias(c) if c in have else quoted(c) for c in source.columns])
    extra: list[Column] = []
    if rule == "any":
        extra = [any_attack(is_attack if is_attack is not None else quoted(label) != "Benign").alias(label)]
    elif rule not in ("first_attack", "mode"):
        raise ValueError(f"unknown window label rule: {rule}")
    table = window_features(typed, size, have, text, edges, uid=uid, order=order, extra=extra, approximate=approximate)
    if rule == "first_attack":
        table = with_first_attack(table, first_attacks(windowed(typed, size), label, order or ["ts"]), label)
    if rule == "mode":
        table = with_mode_label(table, mode_labels(typed, size, label), label)
    if densify:
        counters = [c for c in table.columns if c in ("flow_count", "packet_count") or c.endswith(("_count", "_nunique"))]
        counters += [label] if rule == "any" else []
        table = densify_windows(table, size, fill, counters)
    return table.select(START, *[quoted(c) for c in table.columns if c != START])
