"""Headline timings as one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import re
import statistics
import tempfile
import time

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.mllib.classification import LogisticRegressionWithSGD
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.regression import LabeledPoint
from pyspark.sql import functions as F

from checks.fixtures import impressions, log_lines
from clicktide.functions.scalar import label01
from clicktide.operators import evaluate as ev
from clicktide.operators import histogram as hg
from clicktide.operators import objective as ob
from clicktide.operators.blocks import block_stats, few_tasks, pack
from clicktide.operators.encode import encode
from clicktide.operators.samples import expanded_samples, weighted_samples
from clicktide.operators.tiles import in_tiles
from clicktide.plans import jobs
from clicktide.plans.cg import train_blocks, train_cg
from clicktide.plans.cg_tables import minimise_tables, zero_state
from clicktide.plans.minibatch import train_cg_minibatch
from clicktide.plans.params import CGParams
from clicktide.session import local_session
from clicktide.sources.impressions import parse_requests, read_impressions, read_lines


# Length of the wide model, and rounds after which the objective no longer moves.
WIDE, OPTIMUM_ROUNDS = 1 << 21, 120


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    times: dict[str, float] = {}
    notes: dict[str, float] = {}

    def timed(name, action, repeat=1):
        spent = []
        for _ in range(repeat):
            began = time.monotonic()
            result = action()
            spent.append(time.monotonic() - began)
        times[name] = round(statistics.median(spent), 3)
        return result

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    work = tempfile.mkdtemp(prefix="clicktide-bench-")
    timed("impressions", lambda: drain(impressions(spark, sf)), 3)
    impressions(spark, sf).write.parquet(f"{work}/imps")
    imps = spark.read.parquet(f"{work}/imps")
    n_imps = imps.count()
    log_lines(imps).select("value").write.text(f"{work}/log")

    timed("imp_parse", lambda: drain(read_impressions(spark, f"{work}/log")), 3)
    timed("feature_hist", lambda: drain(hg.feature_histogram(imps)), 3)
    requests = parse_requests(read_lines(spark, f"{work}/log"))
    timed("feature_hist_lines", lambda: drain(hg.feature_histogram(read_impressions(spark, f"{work}/log"))), 3)
    timed("feature_hist_parity", lambda: drain(hg.last_write_histogram(imps)), 3)
    timed("feature_hist_parity_lines", lambda: drain(hg.last_write_request_histogram(requests)), 3)
    timed("feature_dict", lambda: drain(jobs.build_dictionary(imps)), 3)
    timed("feature_dict_sketched", lambda: drain(jobs.build_dictionary(imps, sketched=True)), 3)
    # A dictionary of every feature makes for longer examples and a larger model.
    jobs.build_dictionary(imps, 0).write.parquet(f"{work}/dict")
    dictionary = spark.read.parquet(f"{work}/dict")
    timed("encode_examples", lambda: drain(encode(imps, dictionary, method="broadcast")), 3)
    timed("encode_examples_join", lambda: drain(encode(imps, dictionary, method="join")), 3)
    timed("encode_examples_bloom", lambda: drain(encode(imps, dictionary, method="join", head_dims=1000)), 3)
    notes["encode_rows_per_sec"] = round(n_imps / times["encode_examples"])

    encode(imps, dictionary).write.parquet(f"{work}/examples")
    examples = spark.read.parquet(f"{work}/examples")
    blocks = pack(examples).persist()
    n, d = timed("pack_and_stats", lambda: block_stats(blocks))
    merged, tasks = few_tasks(blocks)
    passes, w = ob.PackedObjective(merged, d, tasks), np.full(d, 0.01)
    timed("gradient", lambda: passes.gradient(w), 5)
    timed("curvature", lambda: passes.curvature(w, w), 5)
    notes["cg_round_sec"] = round(times["gradient"] + times["curvature"], 3)
    weights = ob.weights_table(spark, w)
    rows = ob.with_rows(examples)
    joined = ob.margins_join(rows, weights)
    timed("margin", lambda: drain(ob.with_margin(examples, w)), 3)
    timed("margin_join", lambda: drain(joined))
    timed("gradient_join", lambda: drain(ob.gradient_join(rows, joined)))
    fit = timed("cg_fit_20", lambda: train_blocks(blocks, n, d, CGParams(max_iter=20)))
    tiles = timed("tiles", lambda: in_tiles(examples))
    joined = timed("cg_join_rounds_4", lambda: minimise_tables(tiles, zero_state(tiles), CGParams(), 4))[1]
    notes["cg_join_round_sec"] = round(statistics.median(r["rtime"] for r in joined), 3)
    tiles.drop()
    timed("cg_fit_join_2", lambda: train_cg(examples, CGParams(max_iter=2), "join"))
    # A model of over a million dimensions: each line's parts and orders are features of their own.
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    hashed = [F.pmod(F.xxhash64(*c), F.lit(WIDE - 1)) + 1 for c in (["l_orderkey"], ["l_partkey", "l_suppkey"], ["l_orderkey", "l_partkey"])]
    wide = lines.select(
        (F.col("l_quantity") > 25).cast("int").alias("pos"), (F.col("l_quantity") <= 25).cast("int").alias("neg"),
        F.array_sort(F.array(F.lit(0), *(h.cast("int") for h in hashed))).alias("idx"),
    )
    wide.write.parquet(f"{work}/wide")
    wide = spark.read.parquet(f"{work}/wide")
    fits = {m: timed(f"cg_fit_wide_{m}_2", lambda m=m: train_cg(wide, CGParams(max_iter=2), m)) for m in ("packed", "join")}
    notes["d_wide"] = fits["join"].d
    notes["wide_round_sec"] = {m: round(f.trace.agg(F.max("rtime")).first()[0], 3) for m, f in fits.items()}
    timed("minibatch_fit", lambda: train_cg_minibatch(
        examples, CGParams(max_iter=1, inner_iter=2, batch_size=n // 4 + 1), track_objective=False
    ))
    margins = ob.with_margin(blocks, ob.weights_vector(fit.weights)).persist()
    margins.count()
    timed("accuracy", lambda: ev.accuracy(margins).first(), 3)
    auc = timed("auc_roc", lambda: ev.auc_roc(margins).first().auc, 3)

    # Yardstick: MLlib on the same examples, same penalty. The optimum is that of many more rounds.
    reached = fit.trace.agg(F.min("loglik")).first()[0]
    more = train_blocks(blocks, n, d, CGParams(max_iter=OPTIMUM_ROUNDS, eps=1e-9)).trace
    best = more.agg(F.min("loglik")).first()[0]
    sparse = F.udf(
        lambda idx: SparseVector(d, [(i, 1.0) for i in sorted(set(idx))]), VectorUDT()
    )
    labelled = weighted_samples(examples).select(
        label01(F.col("y")).alias("label"), F.col("wt").cast("double").alias("wt"),
        sparse("idx").alias("features"),
    ).persist()
    labelled.count()
    lr = LogisticRegression(
        regParam=0.1 / n, fitIntercept=False, standardization=False, maxIter=20, weightCol="wt"
    )
    model = timed("mllib_lbfgs_20", lambda: lr.fit(labelled))
    notes |= {"train_auc": round(auc, 6), "objective": round(reached, 8), "optimum": round(best, 8), "n": n, "d": d}
    notes["mllib_objective"] = round(model.summary.objectiveHistory[-1], 8)
    long = [r.loglik for r in more.orderBy("iter").collect()]
    for digits in (3, 4, 6):
        notes[f"rounds_to_1e-{digits}"] = next(i for i, v in enumerate(long) if v - best <= 10.0**-digits * best)
    notes["mllib_over_optimum"] = round(notes["mllib_objective"] / best - 1, 8)
    history = [r.loglik for r in fit.trace.orderBy("iter").collect()]

    # The other yardstick: MLlib's gradient descent, 50 full-batch iterations on single samples.
    points = (
        expanded_samples(examples)
        .select(label01(F.col("y")).alias("label"), sparse("idx").alias("features"))
        .rdd.map(lambda r: LabeledPoint(r.label, Vectors.fromML(r.features)))
        .persist()
    )
    timed("mllib_sgd_convert", points.count)
    sgd = timed("mllib_sgd_50", lambda: LogisticRegressionWithSGD.train(
        points, iterations=50, step=1.0, regParam=0.1 / n, convergenceTol=0.0
    ))
    v = sgd.weights.toArray()
    reached = (0.05 * float(v @ v) + passes.loss(v)) / n
    needed = next((i for i, x in enumerate(history) if x <= reached), len(history))
    seconds = [r.rtime for r in fit.trace.orderBy("iter").collect()]
    notes |= {"sgd_objective": round(reached, 8), "cg_rounds_to_sgd_objective": needed}
    notes["cg_sec_to_sgd_objective"] = round(sum(seconds[:needed]), 3)

    own = {k: v for k, v in times.items() if not k.startswith("mllib")}
    found = re.search(r"sf([0-9.]+)", sf)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(own.values()), 3), "unit": "sec",
        "queries": times, "sf": float(found.group(1)) if found else sf, "notes": notes,
    }))


if __name__ == "__main__":
    main()
