"""Shapes of physical plans: what is read, what moves, what runs where."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from clicktide.operators import objective as ob, tiles as tiling
from clicktide.operators.blocks import pack
from clicktide.operators.encode import encode
from clicktide.operators.evaluate import auc_roc
from clicktide.operators.histogram import feature_histogram
from clicktide.operators.objective import with_margin
from clicktide.operators.samples import weighted_samples
from clicktide.operators.tiles import in_tiles
from clicktide.plans import jobs
from clicktide.plans.cg import train_cg
from clicktide.plans.cg_tables import (
    _MARGINS,
    _along,
    _at_start,
    _residual,
    _weights,
    minimise_tables,
    total_loss,
    weight_rows,
    zero_state,
)
from clicktide.plans.params import CGParams
from clicktide.session import Written
from clicktide.sources.impressions import parse_impressions, read_impressions
from checks.fixtures import impressions


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def clicks(spark, small):
    imps = impressions(spark, small)
    return encode(imps, jobs.build_dictionary(imps, 60)).persist()


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("log")
    (path / "a").write_text("9 0 11:a\t2 1 21:c\t4 0 22:c\n")
    return str(path)


def test_parsing_is_narrow_and_runs_once(spark, log):
    text = plan(read_impressions(spark, log))
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text
    # the two branches of the one cleaning step
    assert text.count("regexp_replace(") <= 4


def test_histogram_moves_partial_sums_once(spark, log):
    text = plan(feature_histogram(read_impressions(spark, log)))
    assert text.count("Exchange") == 1 and "partial_sum" in text


def test_histogram_reads_needed_columns_only(spark, small):
    text = plan(feature_histogram(impressions(spark, small, numbered=False)))
    assert "Window" not in text
    assert "l_extendedprice" not in text and "o_totalprice" not in text and "p_name" not in text


def test_broadcast_encoding_and_scoring_do_not_shuffle(spark, log):
    dictionary = spark.createDataFrame([(11, 1), (22, 2)], "fid LONG, dim INT")
    examples = encode(read_impressions(spark, log), dictionary, method="broadcast")
    for df in (examples, with_margin(examples, [0.1, 0.2, 0.3]), weighted_samples(examples)):
        assert "Exchange" not in plan(df)


def test_join_encoding_moves_tail_tokens_of_open_rows(spark, log):
    """Rows are filtered where they are read; behind that, only written rows with open ids move."""
    dictionary = spark.createDataFrame([(11, 1, 9), (22, 2, 1)], "fid LONG, dim INT, n LONG")
    text = plan(encode(read_impressions(spark, log), dictionary, method="join", head_dims=1))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # One branch reads the log and moves nothing; the other one reads what was written.
    assert text.count("MapInArrow look_up_and_filter") == 1 and text.count("Scan text") == 1
    done = text[: text.index("_row#")]
    assert "look_up_and_filter" in done and "Exchange" not in done


def test_auc_merges_ties_before_ranging(spark):
    rows = spark.createDataFrame([(1, 2, 0.5)], "pos LONG, neg LONG, z DOUBLE")
    text = plan(auc_roc(rows))
    assert text.index("rangepartitioning") < text.rindex("partial_sum(")


def test_bad_mode(spark, log):
    with pytest.raises(ValueError):
        parse_impressions(spark.read.text(log), "LENIENT")


def test_a_round_on_tiles_moves_no_tokens(spark, clicks):
    """Exchanges carry weights, residuals and margins; tiles and blocks are read where they lie."""
    tiles = in_tiles(clicks, columns=16)
    try:
        state = zero_state(tiles)
        sent = tiles.at_tiles(_weights(state))
        first = Written(tiles.at_blocks(sent, None, _at_start, _MARGINS))
        gradient = tiles.transposed(tiles.to_tiles(first.rows, _residual(0.0)))
        margins = tiles.at_blocks(sent, first.rows.select("r", "z", "xm"), _along(0.0), _MARGINS)
        for df in (gradient, margins):
            text = plan(df)
            moved = re.findall(r"Exchange hashpartitioning\((\w+)#", text)
            assert moved and set(moved) <= {"tile", "r", "key", "_r"}
            # Below an exchange come weights, residuals or margins, not the columns of tokens.
            for line in re.findall(r"Exchange[^\n]*\n[^\n]*", text):
                assert "idx#" not in line and "sizes#" not in line and "rows#" not in line
            assert "Bucketed: true" in text
        assert tiles.tiles.rows.select("key").distinct().count() > 3
    finally:
        tiles.drop()


@pytest.mark.parametrize("columns, block_rows, tile_tokens", [(25, 1500, 4000), (1 << 20, 1 << 16, 1 << 24)])
def test_tiles_of_any_size_train_alike(spark, clicks, columns, block_rows, tile_tokens, monkeypatch):
    monkeypatch.setattr(tiling, "LEAST_TOKENS", 40)
    params = CGParams(max_iter=3)
    expected = ob.weights_vector(train_cg(clicks, params, "packed").weights)
    for rows in (clicks.repartition(3), pack(clicks)):
        tiles = in_tiles(rows, None, columns, block_rows, tile_tokens)
        state, trace = minimise_tables(tiles, zero_state(tiles), params, 3)
        got = ob.weights_vector(weight_rows(state.rows, columns))
        assert np.allclose(got, expected, atol=1e-9) and len(trace) == 3
        assert total_loss(tiles, state.rows) == pytest.approx(ob.PackedObjective(clicks, len(got)).loss(got))
        sizes = tiles.tiles.rows.groupBy("tile").agg(F.count("*")).count()
        assert sizes > 6 if columns == 25 else 1 <= sizes <= 4
        tiles.drop()


def test_tiles_of_no_or_empty_examples(spark):
    schema = "pos LONG, neg LONG, idx ARRAY<INT>"
    with pytest.raises(ValueError):
        in_tiles(spark.createDataFrame([], schema))
    rows = spark.createDataFrame([(1, 0, []), (0, 2, None)], schema)
    for examples, loss in ((rows, 3 * np.log(2)), (rows.limit(0), 0.0)):
        tiles = in_tiles(examples, 5)
        state, trace = minimise_tables(tiles, zero_state(tiles), CGParams(), 2)
        assert not ob.weights_vector(weight_rows(state.rows, tiles.columns)).any() and len(trace) == 1
        assert total_loss(tiles, zero_state(tiles)) == pytest.approx(loss)
        tiles.drop()
    with pytest.raises(ValueError, match="beyond"):
        in_tiles(spark.createDataFrame([(1, 0, [7])], schema), 5)
