"""The user-level jobs: build a dictionary, train, evaluate, export."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from clicktide.operators.blocks import block_stats, pack
from clicktide.operators.encode import encode
from clicktide.operators.evaluate import accuracy, auc_roc, weights_by_feature
from clicktide.operators.histogram import (
    DEFAULT_THRESHOLD,
    feature_histogram,
    frequent,
    frequent_sketched,
    number_features,
)
from clicktide.operators.objective import (
    PACKED_MAX_DIM,
    margins_join,
    weights_vector,
    with_margin,
)
from clicktide.operators.stats import dictionary_dim
from clicktide.plans.cg import Fit, train_blocks, train_cg
from clicktide.plans.params import CGParams
from clicktide.session import cached
from clicktide.sources.dictionary import last_wins
from clicktide.sources.sinks import write_feature_weights, write_weights


# Digits of a score that do not depend on the order in which weights were added up.
SCORE_DIGITS = 12


def build_dictionary(
    impressions: DataFrame,
    threshold: int = DEFAULT_THRESHOLD,
    histogram=feature_histogram,
    sketched: bool = False,
) -> DataFrame:
    """`(fid, n, dim)` of features shown more than `threshold` times.

    `sketched` reads the impressions twice and shuffles few of the rarer features
    (`frequent_sketched`); it is worth it where most features are rare. It goes with the plain rule.

    For the replacing count rule pass `histogram=last_write_histogram`, or better, for logs, the
    result of `parse_requests` with `histogram=last_write_request_histogram`.
    """
    if sketched:
        if histogram is not feature_histogram:
            raise ValueError("sketched counts go with feature_histogram only")
        return number_features(frequent_sketched(impressions, threshold))
    return number_features(frequent(histogram(impressions), threshold))


def margins_of(
    examples: DataFrame,
    weights: DataFrame,
    keys: Sequence[str] = ("req", "seg"),
    packed_max_dim: int = PACKED_MAX_DIM,
) -> DataFrame:
    """Examples with their margin `z`; looks weights up in a broadcast vector if it is short
    enough, by join otherwise."""
    top = weights.agg(F.max("idx")).first()[0]
    if top is not None and top < packed_max_dim:
        return with_margin(examples, weights_vector(weights, max_dim=packed_max_dim))
    return margins_join(examples, weights, keys)


def evaluate(
    examples: DataFrame,
    weights: DataFrame,
    keys: Sequence[str] = ("req", "seg"),
    digits: int | None = SCORE_DIGITS,
) -> DataFrame:
    """One row: `accuracy` and `auc` of a model on counted examples or packed blocks.

    Scores that agree in `digits` digits tie. Sums in another order differ in the last bits, so
    without rounding the AUC would not be repeatable.
    """
    with cached(margins_of(examples, weights, keys).select("pos", "neg", "z")) as margins:
        a = accuracy(margins).first()["accuracy"]
        u = auc_roc(margins, digits).first()["auc"]
    return examples.sparkSession.createDataFrame([(a, u)], "accuracy DOUBLE, auc DOUBLE")


@dataclass
class Trained:
    fit: Fit
    metrics: DataFrame


def fit(
    impressions: DataFrame,
    dictionary: DataFrame,
    params: CGParams = CGParams(),
    method: str = "auto",
    keys: Sequence[str] = ("req", "seg"),
) -> Trained:
    """Encode once, train, and measure on the training data. `method` as in `train_cg`."""
    if method not in ("auto", "packed", "join"):
        raise ValueError("method must be 'auto', 'packed' or 'join'")
    examples = encode(impressions, dictionary, keys)
    # No example has a dimension that the dictionary has not.
    fits = dictionary_dim(dictionary).first()["dict_d"] <= PACKED_MAX_DIM
    if method == "packed" and not fits:
        raise ValueError(f"more than {PACKED_MAX_DIM} dimensions, use method='join'")
    if method != "join" and fits:
        with cached(pack(examples)) as blocks:
            n, d = block_stats(blocks)
            trained = train_blocks(blocks, n, d, params)
            return Trained(trained, evaluate(blocks, trained.weights))
    with cached(examples):
        trained = train_cg(examples, params, "join", keys)
        return Trained(trained, evaluate(examples, trained.weights, keys))


def test(
    impressions: DataFrame,
    dictionary: DataFrame,
    weights: DataFrame,
    keys: Sequence[str] = ("req", "seg"),
) -> DataFrame:
    """Accuracy and AUC on other data, encoded with the dictionary used in training."""
    return evaluate(encode(impressions, dictionary, keys), weights, keys)


def export_model(weights: DataFrame, dictionary: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Writes `<path>/model` by index and `<path>/modelMap` by feature id."""
    write_weights(weights, f"{path}/model", fmt)
    write_feature_weights(named_weights(weights, dictionary), f"{path}/modelMap", fmt)


def named_weights(weights: DataFrame, dictionary: DataFrame) -> DataFrame:
    """`weights_by_feature` with one id per dimension: of several the one that comes last.

    Last is by `place` if the dictionary has it, as parsed text has, else the largest id.
    """
    place = "place" if "place" in dictionary.columns else "fid"
    entries = dictionary.select("fid", "dim", F.col(place).alias("place"))
    return weights_by_feature(weights, last_wins(entries, "dim"))
