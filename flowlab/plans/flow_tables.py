"""From raw flows to a balanced feature table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.labels import COARSE_CLASSES, coarse_label, parse_zeek_label
from ..functions.scalars import clean_number, quoted, to_num
from ..operators.clean import (
    FLOW_NUMBERS,
    IDENTIFIERS,
    JOIN_SUFFIXES,
    assert_varying,
    class_profile,
    constant_columns,
    constant_in_profile,
    find_label_column,
    text_cols,
)
from ..operators.encode import (
    apply_ordinal_encoder,
    apply_scaler,
    encode_labels,
    fit_ordinal_encoder,
    fit_scaler,
    number_labels,
    restrict_dictionary,
)
from ..operators.ordering import class_sizes
from ..operators.sample import stratified_sample
from ..scratch import materialize


@dataclass
class FeatureTable:
    """A finished table with its label dimension and what was left out."""

    table: DataFrame
    labels: DataFrame
    features: list[str]
    constant: list[str]

    def verify(self) -> None:
        """Raise when sampling left a feature with a single value."""
        assert_varying(self.table, self.features)


def prepare_flows(
    flows: DataFrame,
    key: Sequence[str],
    label: str | None = None,
    target: int = 10_000,
    minimum: int = 500,
    seed: int = 42,
    numbers: Sequence[str] = FLOW_NUMBERS,
    numeric_strings: str = "numbers",
    exclude: Sequence[str] = (),
    keep: Sequence[str] = (),
    suffixes: Sequence[str] = JOIN_SUFFIXES,
) -> FeatureTable:
    """Flow table to a balanced table of float32 features and a class code.

    Labels are parsed, identifiers dropped, text columns coded by the order of all
    their values, gaps filled with 0 and columns pruned that are constant over the
    whole input; then a stratified sample is drawn.  Text columns holding the known
    ``numbers`` are read as numbers, or coded like other text with
    ``numeric_strings="codes"``.

    Coding a row needs only the dictionaries, so rows are sampled first and coded
    afterwards: wide rows pass once, as a filter against the cut of their class.
    ``key`` names the columns that identify a row; ``keep`` are passed through.
    """
    raw = label or find_label_column(flows)
    gone = {raw, *exclude, *IDENTIFIERS, *[i + s for i in IDENTIFIERS for s in suffixes]}
    features = [c for c in flows.columns if c not in gone]
    texts = set(text_cols(flows)) & set(features)
    if numeric_strings == "numbers":
        texts -= {c for c in numbers}
    read = [
        quoted(c) if c in texts
        else clean_number(to_num(quoted(c))).alias(c) if dict(flows.dtypes)[c] in ("string", "boolean")
        else clean_number(quoted(c)).alias(c)
        for c in features
    ]
    extra = [c for c in dict.fromkeys([*key, *keep]) if c not in features]
    typed = flows.select(*[quoted(c) for c in extra], *read, parse_zeek_label(quoted(raw)).alias("label_str"))

    # sizes and constants in one pass over the rows
    profile = materialize(class_profile(typed, "label_str", features), "profile")
    sizes = profile.select("label_str", "_rows")
    labels = materialize(number_labels(sizes), "labels")
    constant = constant_in_profile(profile, features)
    features = [c for c in features if c not in constant]
    coded = [c for c in features if c in texts]
    # key columns may be features that turned out constant, so they are kept apart
    keyed = typed.select(
        *[quoted(k).alias(f"_key_{i}") for i, k in enumerate(key)],
        *[quoted(c) for c in keep if c not in features],
        *[quoted(c) for c in features],
        "label_str",
    )
    keys = [f"_key_{i}" for i in range(len(key))]
    sample = stratified_sample(keyed, "label_str", target, minimum, keys, seed, sizes)
    if coded:
        sample = materialize(sample, "sample")
        dictionary = restrict_dictionary(fit_ordinal_encoder(typed, coded), sample, coded)
        sample = apply_ordinal_encoder(sample, dictionary, coded)
    table = encode_labels(sample, labels, "label_str")
    return FeatureTable(
        table.select(
            *[quoted(c) for c in keep if c not in features],
            *[quoted(c).cast("float").alias(c) for c in features],
            "label",
        ),
        labels,
        features,
        constant,
    )


def prepare_csv_flows(
    flows: DataFrame,
    key: Sequence,
    label: str = "Label",
    classes: dict[str, str] = COARSE_CLASSES,
    target: int = 10_000,
    minimum: int = 500,
    seed: int = 42,
    exclude: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> FeatureTable:
    """CSV flows to a balanced, standardised table of float32 features and a class code.

    Rows with unmapped labels are left out.  Coding, pruning and scaling look at the
    sample, which is written once; its size is bounded by classes times target.
    ``key`` are the columns, or expressions, that identify a row; a key column is a
    feature like any other unless it is in ``exclude`` or passed through by ``keep``.
    """
    mapped = flows.withColumn("label_str", coarse_label(quoted(label), classes)).filter("label_str <> ''")
    sample = stratified_sample(mapped, "label_str", target, minimum, key, seed)
    # a sample of any size holds every class, so it names them all
    named = sample if max(target, minimum) > 0 else mapped
    labels = materialize(number_labels(class_sizes(named, ["label_str"])), "labels")
    features = [c for c in sample.columns if c not in {label, "label_str", *exclude, *keep}]
    texts = [c for c in text_cols(sample) if c in features]
    coded = apply_ordinal_encoder(sample, fit_ordinal_encoder(sample, texts), texts) if texts else sample
    clean = materialize(
        coded.select(*[quoted(c) for c in keep], *[clean_number(quoted(c)).alias(c) for c in features], "label_str"),
        "clean",
    )
    constant = constant_columns(clean, features)
    features = [c for c in features if c not in constant]
    scaled = apply_scaler(clean, fit_scaler(clean, features), features)
    table = encode_labels(scaled, labels, "label_str")
    return FeatureTable(
        table.select(*[quoted(c) for c in keep], *[quoted(c).cast("float").alias(c) for c in features], "label"),
        labels,
        features,
        constant,
    )
