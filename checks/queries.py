"""Registered queries: every operator of the library on the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks.fixtures import (
    SCALED_DIGITS,
    SLOT_ORDER,
    STOP_EPS,
    STOP_ROUNDS,
    check_weights,
    document_dictionary,
    document_examples,
    documents,
    impressions,
    log_lines,
    table,
)
from clicktide.functions.numbering import number_rows
from clicktide.functions.scalar import format_unsigned, log_loss, parse_unsigned, sigmoid
from clicktide.functions.vectors import dot, norm2
from clicktide.operators import evaluate as ev
from clicktide.operators import histogram as hg
from clicktide.operators import objective as ob
from clicktide.operators.encode import combine_segments, encode, sample_counts
from clicktide.operators.batches import assign_batches, batch_count
from clicktide.operators.samples import count_samples, expanded_samples, weighted_samples
from clicktide.operators.stats import data_stats, dictionary_dim
from clicktide.plans import jobs
from clicktide.plans.cg import train_cg, train_store
from clicktide.plans.minibatch import train_cg_minibatch
from clicktide.plans.params import CGParams
from clicktide.session import cached, ensure_checkpoint_dir, materialise
from clicktide.sources import sinks
from clicktide.sources.blockstore import BlockStore, write_store
from clicktide.sources.dictionary import last_wins, parse_dictionary
from clicktide.sources.impressions import (
    explode_slots,
    parse_impressions,
    parse_requests,
    read_impressions,
    read_lines,
)
from clicktide.sources.libsvm import parse_examples


def _r(value: Column, digits: int) -> Column:
    """Rounded for comparison, with minus zero turned into zero."""
    r = F.round(value, digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def _text(ids: str) -> Column:
    return F.array_join(F.col(ids).cast("array<string>"), " ")


def _show_impressions(imps: DataFrame) -> DataFrame:
    return imps.select(
        "req", "seg", "show", "click", _text("feats").alias("feats"), _text("common").alias("common")
    )


def q_impressions(spark, sf):
    return _show_impressions(impressions(spark, sf))


def q_imp_parse(spark, sf):
    return _show_impressions(explode_slots(parse_requests(log_lines(impressions(spark, sf)))))


def q_imp_parse_offsets(spark, sf):
    """A log of files read in small and in large ranges: requests keep their numbers."""
    place = _new_place(spark)
    log_lines(impressions(spark, sf)).select("value").write.text(place)
    small, large = (read_impressions(spark, place, by_offset=True, split_bytes=n) for n in (60_001, 1 << 27))
    columns = small.columns
    both = small.join(large.withColumnsRenamed({c: f"{c}_2" for c in columns}), [F.col(c).eqNullSafe(F.col(f"{c}_2")) for c in columns])
    shown = _show_impressions(both.select(columns)).drop("req")
    return shown.groupBy(*shown.columns).agg(F.count("*").alias("n"))


# Orders for which a log has one more file.
FILE_ORDERS = 1_000_000


def q_imp_parse_partitions(spark, sf):
    """A log read with a hint for the number of tasks."""
    place = _new_place(spark)
    # A small log is one file; of a large one no task writes the whole.
    files = 1 + table(spark, sf, "orders").count() // FILE_ORDERS
    log_lines(impressions(spark, sf)).repartition(files, "req").select("value").write.text(place)
    shown = _show_impressions(read_impressions(spark, place, min_partitions=12)).drop("req")
    tasks = F.spark_partition_id().alias("_task")
    seen = read_lines(spark, place, 12).select(tasks).distinct().count()
    return shown.groupBy(*shown.columns).agg(F.count("*").alias("n")).withColumn("n_tasks", F.lit(seen).cast("bigint"))


def q_segment_combine(spark, sf):
    rows = combine_segments(impressions(spark, sf))
    return rows.select("req", "seg", "show", "click", _text("fids").alias("fids"))


def q_feature_hist(spark, sf):
    return hg.feature_histogram(impressions(spark, sf, numbered=False))


def q_feature_hist_lines(spark, sf):
    return hg.feature_histogram(parse_impressions(log_lines(impressions(spark, sf))))


def q_feature_hist_parity(spark, sf):
    return hg.last_write_histogram(impressions(spark, sf))


def q_feature_hist_parity_lines(spark, sf):
    return hg.last_write_request_histogram(parse_requests(log_lines(impressions(spark, sf))))


def q_feature_dict(spark, sf):
    return jobs.build_dictionary(impressions(spark, sf, numbered=False))


def q_feature_dict_sketched(spark, sf):
    return jobs.build_dictionary(impressions(spark, sf, numbered=False), sketched=True)


def _dictionary_entries(spark, sf):
    """Dictionary text with repeated keys, and three-token lines that do not count."""
    fid = (4000000 + F.col("l_suppkey")).cast("string")
    extra = F.when(F.col("l_linenumber") == 7, F.lit("x"))
    value = F.concat_ws(" ", fid, F.col("l_partkey").cast("string"), extra)
    lines = table(spark, sf, "lineitem").select("l_orderkey", *SLOT_ORDER, value.alias("value"))
    return parse_dictionary(lines, ["l_orderkey", *SLOT_ORDER])


def q_dict_load(spark, sf):
    return last_wins(_dictionary_entries(spark, sf), "fid")


def q_dict_load_reverse(spark, sf):
    return last_wins(_dictionary_entries(spark, sf), "dim")


def _examples(spark, sf, method="auto", **options):
    """(examples, dictionary) of the order-derived impressions."""
    dictionary = q_feature_dict(spark, sf)
    return encode(impressions(spark, sf), dictionary, method=method, **options), dictionary


def _encoded(method, **options):
    def query(spark, sf):
        examples, _ = _examples(spark, sf, method, **options)
        return examples.select("req", "seg", "pos", "neg", _text("idx").alias("dims"))

    return query


def _counted(spark, sf):
    pos, neg = sample_counts(F.col("show"), F.col("click"))
    return impressions(spark, sf).select("req", "seg", pos.alias("pos"), neg.alias("neg"))


def q_samples_weighted(spark, sf):
    return weighted_samples(_counted(spark, sf))


def q_samples_expanded(spark, sf):
    return expanded_samples(_counted(spark, sf))


def q_data_stats(spark, sf):
    examples, dictionary = _examples(spark, sf)
    one = F.lit(1).alias("one")
    stats = data_stats(examples).select("n", "d", one)
    return stats.join(dictionary_dim(dictionary).select("dict_d", one), "one").drop("one")


def q_sigmoid(spark, sf):
    z = (F.col("l_quantity") - 25.5) * 2
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        z.alias("z"),
        _r(sigmoid(z), 12).alias("sigma"),
        _r(F.log(sigmoid(z)), 9).alias("ln_sigma"),
        _r(log_loss(z), 9).alias("loss"),
    )


def _margins(spark, sf):
    examples, dictionary = _examples(spark, sf)
    weights = check_weights(dictionary)
    return ob.with_margin(examples, ob.weights_vector(weights)), weights


def _margins_join(spark, sf):
    examples, dictionary = _examples(spark, sf)
    examples = ob.with_rows(examples)
    weights = check_weights(dictionary)
    sums = {"w": "z", "mu": "xm"}
    return examples, ob.margins_join(examples, weights, sums=sums, head_dims=50)


def q_margin(spark, sf):
    return _margins(spark, sf)[0].select("req", "seg", _r(F.col("z"), 6).alias("z"))


def q_margin_join(spark, sf):
    return _margins_join(spark, sf)[1].select("req", "seg", _r(F.col("z"), 6).alias("z"))


def q_score(spark, sf):
    return ev.predict(_margins(spark, sf)[0]).select("req", "seg", _r(F.col("p"), 9).alias("p"))


def q_predict_label(spark, sf):
    # Sums that are zero up to float noise must be zero before their sign is read.
    margins = _margins(spark, sf)[0].withColumn("z", F.round("z", 9))
    return ev.predict(margins).select("req", "seg", "label")


def q_log_loss(spark, sf):
    return ob.loss_join(_margins(spark, sf)[0]).select(_r(F.col("loss"), 4).alias("loss"))


def q_log_loss_join(spark, sf):
    return ob.loss_join(_margins_join(spark, sf)[1]).select(_r(F.col("loss"), 4).alias("loss"))


def q_objective(spark, sf):
    margins, weights = _margins(spark, sf)
    return ev.objective(margins, weights, 0.1).select(
        _r(F.col("objective"), 9).alias("objective"), _r(F.col("loss"), 4).alias("loss")
    )


def q_gradient(spark, sf):
    examples, dictionary = _examples(spark, sf)
    w = ob.weights_vector(check_weights(dictionary))
    shared = spark.sparkContext.broadcast(w)
    rows = ob.PackedObjective(examples, len(w)).gradient_rows(shared)
    return rows.filter(F.col("idx") >= 0).select("idx", _r(F.col("v"), 4).alias("g"))


def q_gradient_join(spark, sf):
    examples, margins = _margins_join(spark, sf)
    return ob.gradient_join(examples, margins).select("idx", _r(F.col("g"), 4).alias("g"))


def q_curvature(spark, sf):
    examples, dictionary = _examples(spark, sf)
    weights = check_weights(dictionary)
    vectors = (ob.weights_vector(weights), ob.weights_vector(weights, "mu"))
    shared = spark.sparkContext.broadcast(vectors)
    row = ob.PackedObjective(examples, len(vectors[0])).curvature_row(shared)
    return row.select(_r(F.col("curvature"), 4).alias("curvature"))


def q_curvature_join(spark, sf):
    rows = ob.curvature_join(_margins_join(spark, sf)[1])
    return rows.select(_r(F.col("curvature"), 4).alias("curvature"))


def _document_margins(spark, sf):
    docs = documents(spark, sf)
    dictionary = document_dictionary(docs)
    w = ob.weights_vector(check_weights(dictionary))
    margins = ob.with_margin(encode(docs, dictionary, ["id"]), w)
    return margins.withColumn("z", F.round("z", 9))


def q_accuracy(spark, sf):
    return ev.accuracy(_document_margins(spark, sf)).select(_r(F.col("accuracy"), 9).alias("accuracy"))


def q_accuracy_weighted(spark, sf):
    margins = _margins(spark, sf)[0].withColumn("z", F.round("z", 9))
    return ev.accuracy(margins).select(_r(F.col("accuracy"), 9).alias("accuracy"))


def q_auc_roc(spark, sf):
    return ev.auc_roc(_document_margins(spark, sf), 9).select(_r(F.col("auc"), 9).alias("auc"))


def q_auc_roc_weighted(spark, sf):
    return ev.auc_roc(_margins(spark, sf)[0], 9).select(_r(F.col("auc"), 9).alias("auc"))


def q_weight_norms(spark, sf):
    weights = check_weights(q_feature_dict(spark, sf))
    one = F.lit(1).alias("one")
    w = norm2(weights).select(_r(F.col("norm"), 9).alias("w_norm"), one)
    mu = norm2(weights, "mu").select(_r(F.col("norm"), 9).alias("mu_norm"), one)
    both = dot(weights, weights, "w", "mu").select(_r(F.col("dot"), 9).alias("w_mu"), one)
    return w.join(mu, "one").join(both, "one").drop("one")


def q_weights_by_fid(spark, sf):
    dictionary = q_feature_dict(spark, sf)
    named = ev.weights_by_feature(check_weights(dictionary).select("idx", "w"), dictionary)
    return named.select("fid", _r(F.col("w"), 9).alias("w"), "is_bias")


def _weights_after(rounds, method):
    def query(spark, sf):
        examples = document_examples(spark, sf)
        fit = train_cg(examples, CGParams(max_iter=rounds), method, ["id"])
        return fit.weights.select("idx", _r(F.col("w"), 6).alias("w"))

    return query


def q_cg_trace(spark, sf):
    fit = train_cg(document_examples(spark, sf), CGParams(max_iter=5), keys=["id"])
    columns = [c for c in fit.trace.columns if c not in ("iter", "rtime")]
    return fit.trace.select("iter", *(_r(F.col(c), 5).alias(c) for c in columns))


def _new_place(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/fit-{uuid.uuid4()}"


def q_cg_trace_resumed(spark, sf):
    """A fit that is stopped after two rounds, and goes on."""
    examples, place = document_examples(spark, sf), _new_place(spark)
    train_cg(examples, CGParams(max_iter=2), rounds_at=place)
    trace = train_cg(examples, CGParams(max_iter=5), rounds_at=place).trace
    columns = [c for c in trace.columns if c not in ("iter", "rtime")]
    return trace.select("iter", *(_r(F.col(c), 5).alias(c) for c in columns))


def q_cg_iter2_store(spark, sf):
    """A store of blocks is written, fitted for a round, opened again and fitted on, in tables."""
    place = _new_place(spark)
    write_store(document_examples(spark, sf), f"{place}/store")
    rounds = f"{place}/rounds"
    train_store(BlockStore(spark, f"{place}/store"), CGParams(max_iter=1), "packed", rounds_at=rounds)
    fit = train_store(BlockStore(spark, f"{place}/store"), CGParams(max_iter=2), "join", rounds_at=rounds)
    return fit.weights.select("idx", _r(F.col("w"), 6).alias("w"))


def _fit_metrics(examples, weights, keys=("id",)):
    # Written once, since three measures read them.
    margins = materialise(jobs.margins_of(examples, weights, keys).select("pos", "neg", "z"))
    one = F.lit(1).alias("one")
    rows = (
        ev.accuracy(margins)
        .select(_r(F.col("accuracy"), 6).alias("accuracy"), one)
        .join(ev.auc_roc(margins, 9).select(_r(F.col("auc"), 6).alias("auc"), one), "one")
        .join(
            ev.objective(margins, weights, 0.1).select(
                _r(F.col("objective"), 6).alias("objective"), one
            ),
            "one",
        )
    )
    return rows.drop("one")


def q_cg_fit_metrics(spark, sf):
    examples = document_examples(spark, sf)
    return _fit_metrics(examples, train_cg(examples, CGParams(max_iter=5), keys=["id"]).weights)


def q_cg_fit_clicks(spark, sf):
    with cached(_examples(spark, sf)[0]) as examples:
        weights = train_cg(examples, CGParams(max_iter=3)).weights
        return _fit_metrics(examples, weights, ["req", "seg"])


def q_minibatch_sizes(spark, sf):
    """What a seeded split must keep: each sample once, batch numbers in range."""
    docs = document_examples(spark, sf)
    total = docs.agg(F.sum(F.col("pos") + F.col("neg"))).first()[0]
    batches = batch_count(int(total or 0), 100)
    split = assign_batches(docs, batches, ["id"], seed=3)
    return split.agg(
        F.count("*").alias("n"),
        F.countDistinct("id").alias("n_ids"),
        F.count(F.when(~F.col("batch").between(0, batches - 1), 1)).alias("n_outside"),
        F.lit(batches).cast("bigint").alias("n_batches"),
    )


def _minibatch(spark, sf, method, track=False, anchor="previous"):
    return train_cg_minibatch(
        document_examples(spark, sf),
        CGParams(max_iter=1, inner_iter=2),
        keys=["id"],
        batch=F.pmod("id", F.lit(3)),
        n_batches=3,
        track_objective=track,
        method=method,
        anchor=anchor,
    )


def q_minibatch_fit_metrics(spark, sf):
    return _fit_metrics(document_examples(spark, sf), _minibatch(spark, sf, "packed").weights)


def q_minibatch_fit_metrics_join(spark, sf):
    return _fit_metrics(document_examples(spark, sf), _minibatch(spark, sf, "join").weights)


def q_minibatch_zero_metrics(spark, sf):
    """The penalty is on the weights of each batch, not on their distance to those before."""
    return _fit_metrics(document_examples(spark, sf), _minibatch(spark, sf, "packed", anchor="zero").weights)


def q_minibatch_trace(spark, sf):
    trace = _minibatch(spark, sf, "packed", True).trace
    return trace.select("batch", "iter", *(_r(F.col(c), 6).alias(c) for c in ("loglik", "avg_objective")))


def _line_impressions(spark, sf):
    """Impressions under keys that repeat, and with ids that are NULL or close to each other."""
    lines = table(spark, sf, "lineitem")
    near = F.lit(2**60).cast("bigint") + F.col("l_suppkey")
    return lines.select(
        F.when(F.col("l_linenumber") != 7, F.col("l_orderkey")).alias("req"),
        F.col("l_linenumber").cast("int").alias("seg"),
        F.lit(3).alias("show"),
        (F.col("l_partkey") % 3).cast("int").alias("click"),
        F.array(near, F.when(F.col("l_linenumber") > 2, 5000000 + F.col("l_linenumber")).cast("bigint")).alias("feats"),
        F.array().cast("array<bigint>").alias("common"),
    )


def _line_examples(spark, sf, method):
    imps = _line_impressions(spark, sf)
    fids = imps.select(F.explode("feats").alias("fid")).filter("fid is not null and fid % 2 = 0").distinct()
    dictionary = number_rows(fids, [F.col("fid")], "dim").select("fid", F.col("dim").cast("int"))
    return encode(imps, dictionary, method=method, head_dims=5)


def _line_encoded(method):
    def query(spark, sf):
        rows = _line_examples(spark, sf, method).select("req", "seg", "pos", "neg", _text("idx").alias("dims"))
        return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))

    return query


def _line_weights(method):
    def query(spark, sf):
        fit = train_cg(_line_examples(spark, sf, "broadcast"), CGParams(max_iter=2), method)
        return fit.weights.select("idx", _r(F.col("w"), 6).alias("w"))

    return query


def q_score_beyond_model(spark, sf):
    """Dimensions that the model does not have count nothing."""
    examples, dictionary = _examples(spark, sf)
    known = check_weights(dictionary).filter("idx < 10")
    margins = ob.with_margin(examples, ob.weights_vector(known))
    return margins.select("req", "seg", _r(F.col("z"), 6).alias("z"))


def _damaged_lines(spark, sf):
    """Log lines of which every fifth request is damaged, in one of three ways."""
    lines = log_lines(impressions(spark, sf))
    kind = F.pmod("req", F.lit(15))
    value = (
        F.when(kind == 0, F.concat(F.lit("x "), F.col("value")))
        .when(kind == 5, F.concat(F.lit("1:5 "), F.col("value")))
        .when(kind == 10, F.lit("1"))
        .otherwise(F.col("value"))
    )
    return lines.select("req", value.alias("value"))


def q_imp_parse_dropmalformed(spark, sf):
    return _show_impressions(explode_slots(parse_requests(_damaged_lines(spark, sf), "DROPMALFORMED")))


def q_imp_parse_permissive(spark, sf):
    rows = parse_requests(_damaged_lines(spark, sf), "PERMISSIVE")
    return rows.select("req", F.col("_corrupt_record").isNotNull().alias("corrupt"), F.size("segs").alias("n_segments"))


def q_libsvm_minibatch(spark, sf):
    """Text examples to counted samples to batches."""
    samples = parse_examples(_libsvm_lines(spark, sf))
    batches = assign_batches(count_samples(samples.select("id", "y", "idx")), 4, ["id"], seed=1)
    return batches.agg(
        F.count("*").alias("n"),
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.countDistinct("batch").alias("n_batches"),
    )


def _document_model(spark, sf, **params):
    docs = documents(spark, sf)
    dictionary = document_dictionary(docs)
    return docs, dictionary, jobs.fit(docs, dictionary, CGParams(**params), keys=["id"])


def _shown_metrics(metrics):
    return metrics.select(*(_r(F.col(c), 6).alias(c) for c in ("accuracy", "auc")))


def q_jobs_fit(spark, sf):
    return _shown_metrics(_document_model(spark, sf, max_iter=5)[2].metrics)


def q_jobs_test(spark, sf):
    docs, dictionary, model = _document_model(spark, sf, max_iter=5)
    return _shown_metrics(jobs.test(docs, dictionary, model.fit.weights, ["id"]))


def q_export_tables(spark, sf):
    _, dictionary, model = _document_model(spark, sf, max_iter=2)
    rows = jobs.named_weights(model.fit.weights, dictionary)
    return rows.select("fid", _r(F.col("w"), 6).alias("w"), "is_bias")


def q_dictionary_text(spark, sf):
    return sinks.dictionary_lines(q_feature_dict(spark, sf))


def q_histogram_text(spark, sf):
    return sinks.histogram_lines(q_feature_hist(spark, sf))


def q_weights_text(spark, sf):
    """Only features of the slots have a weight; dimensions of shared ones are written as zero."""
    dims = q_feature_dict(spark, sf).filter("fid >= 4000000")
    return sinks.weights_lines(dims.select(F.col("dim").alias("idx"), (F.col("dim") % 7).cast("double").alias("w")))


def q_feature_weights_text(spark, sf):
    dictionary = q_feature_dict(spark, sf)
    weights = check_weights(dictionary).select("idx", (F.col("idx") % 7).cast("double").alias("w"))
    return sinks.feature_weights_lines(ev.weights_by_feature(weights, dictionary))


def q_samples_text(spark, sf):
    return sinks.samples_lines(weighted_samples(_examples(spark, sf)[0]))


def q_cg_stops(spark, sf):
    """Rounds until the weights move by less than the bound, with sums scaled by the samples."""
    params = CGParams(max_iter=STOP_ROUNDS, eps=STOP_EPS, scale=0)
    fit = train_cg(document_examples(spark, sf), params, keys=["id"])
    return fit.trace.agg(F.count("*").alias("rounds"))


def q_cg_trace_scaled(spark, sf):
    """What scaling by the samples changes in a trace, and what it leaves."""
    fit = train_cg(document_examples(spark, sf), CGParams(max_iter=3, scale=0), keys=["id"])
    return fit.trace.select(
        "iter",
        *(_r(F.col(c), digits).alias(c) for c, digits in SCALED_DIGITS.items()),
    )


def q_unsigned_roundtrip(spark, sf):
    # Ids from the top of the unsigned range on odd lines, small ones on even lines.
    key = (F.col("l_orderkey") * 10_000_000 + F.col("l_partkey")).cast("decimal(20,0)")
    top = F.lit("18446744073709551615").cast("decimal(20,0)") - key
    u = F.when(F.col("l_linenumber") % 2 == 1, top).otherwise(key)
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", parse_unsigned(u.cast("string")).alias("bits")
    )
    return rows.withColumn("text", format_unsigned(F.col("bits")))


def _libsvm_lines(spark, sf):
    """Example lines with TABs and blanks around them, and blank ones in between."""
    y = F.when(F.col("l_discount") > 0.05, F.lit("+1")).otherwise(F.lit("-1"))
    pairs = [
        F.concat(F.col(c).cast("string"), F.lit(":0.5"))
        for c in ("l_partkey", "l_suppkey", "l_linenumber")
    ]
    around = F.when(F.col("l_linenumber") % 2 == 0, F.lit("\t")).otherwise(F.lit(" "))
    full = F.concat(around, F.concat_ws(" ", y, *pairs), around)
    value = F.when(F.col("l_linenumber") == 7, F.concat(around, around)).otherwise(full)
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), value.alias("value"))


def q_libsvm_binary_load(spark, sf):
    return parse_examples(_libsvm_lines(spark, sf)).select("id", "y", _text("idx").alias("idx"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {
        name[2:]: function
        for name, function in globals().items()
        if name.startswith("q_") and callable(function)
    }
    return {
        **named,
        "encode_examples": _encoded("broadcast"),
        "encode_examples_join": _encoded("join", head_dims=50, bloom_bits=0),
        "encode_examples_bloom": _encoded("join", head_dims=50),
        "encode_line_keys": _line_encoded("broadcast"),
        "encode_line_keys_join": _line_encoded("join"),
        "cg_iter2_line_keys": _line_weights("packed"),
        "cg_iter2_line_keys_join": _line_weights("join"),
        "cg_iter1": _weights_after(1, "packed"),
        "cg_iter1_join": _weights_after(1, "join"),
        "cg_iter2": _weights_after(2, "packed"),
        "cg_iter2_join": _weights_after(2, "join"),
    }
