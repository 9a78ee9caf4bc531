"""The given tables as inputs: impressions from orders, labelled examples from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clicktide.functions.numbering import number_rows, number_within
from clicktide.functions.scalar import format_unsigned
from clicktide.operators.encode import encode

# One order's lines in a fixed order; unique together with l_orderkey.
SLOT_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate",
]

# Training ends by the stop test when the weights move by less than this, and at the latest after
# so many rounds.
STOP_EPS, STOP_ROUNDS = 0.352, 8

# Decimals that a trace of scaled sums is compared in.
SCALED_DIGITS = {"alpha": 3, "beta": 6, "w_diff_norm": 6, "grad_norm": 9, "gtd": 12, "uhu": 15}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def impressions(spark: SparkSession, sf: str, numbered: bool = True) -> DataFrame:
    """`(req, seg, show, click, feats, common)`: an order is a request, its lines are slots.

    Without `numbered` there is no `seg`, which spares sorting the slots of each order.
    """
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", *SLOT_ORDER, "l_discount", "l_returnflag"
    )
    slots = number_within(lines, ["l_orderkey"], SLOT_ORDER, "seg") if numbered else lines
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    parts = table(spark, sf, "part").select("p_partkey", "p_size")
    joined = slots.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        parts, F.col("l_partkey") == F.col("p_partkey")
    )
    show = 1 + F.col("l_quantity").cast("int") % 4
    click = F.least(show, F.round(F.col("l_discount") * 100).cast("int") % 3)
    ids = lambda *cols: F.array(*(c.cast("bigint") for c in cols))
    return joined.select(
        F.col("l_orderkey").alias("req"),
        *(["seg"] if numbered else []),
        show.alias("show"),
        click.alias("click"),
        ids(
            4000000 + F.col("l_suppkey"),
            5000000 + F.col("p_size"),
            6000000 + F.ascii("l_returnflag"),
        ).alias("feats"),
        ids(
            1000000 + F.col("o_custkey"), 2000000 + F.ascii(F.substring("o_orderpriority", 1, 1))
        ).alias("common"),
    )


def log_lines(imps: DataFrame) -> DataFrame:
    """Impressions as log text: `(req, value)`, all slots of a request in one line."""

    def tokens(ids: str) -> Column:
        return F.array_join(
            F.transform(ids, lambda f: F.concat(format_unsigned(f), F.lit(":s"))), " "
        )

    slot = F.concat_ws(" ", F.col("show").cast("string"), F.col("click").cast("string"), tokens("feats"))
    texts = imps.select(
        "req",
        F.concat(F.lit("0 0 "), tokens("common")).alias("head"),
        F.struct("seg", slot.alias("text")).alias("slot"),
    )
    lines = texts.groupBy("req", "head").agg(F.sort_array(F.collect_list("slot")).alias("s"))
    body = F.array_join(F.transform("s", lambda x: x["text"]), "\t")
    return lines.select("req", F.concat("head", F.lit("\t"), body).alias("value"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents in impression form: one show each, clicked if of good quality."""
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    letter = lambda i: F.ascii(F.substring("lang", i, 1))
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.lit(1).alias("show"),
        F.col("quality").alias("click"),
        F.array(
            (1 + 100 * letter(1) + letter(2)).cast("bigint"),
            20000 + F.substring("source", 4, 10).cast("bigint"),
            30000 + F.floor(F.log(F.col("n_chars") + 1)).cast("bigint"),
        ).alias("feats"),
        F.array().cast("array<bigint>").alias("common"),
    )


def document_dictionary(docs: DataFrame) -> DataFrame:
    """`(fid, dim)` over all features, numbered by feature id."""
    fids = docs.select(F.explode("feats").alias("fid")).distinct()
    return number_rows(fids, [F.col("fid")], "dim").select("fid", F.col("dim").cast("int"))


def document_examples(spark: SparkSession, sf: str) -> DataFrame:
    """`(id, pos, neg, idx)`."""
    docs = documents(spark, sf)
    return encode(docs, document_dictionary(docs), ["id"])


def check_weights(dictionary: DataFrame) -> DataFrame:
    """`(idx, w, mu)`: fixed weights and direction for bias and all dictionary dimensions."""
    dims = dictionary.select(F.col("dim").cast("int").alias("idx")).unionAll(
        dictionary.sparkSession.range(1).select(F.col("id").cast("int").alias("idx"))
    )
    return dims.select(
        "idx",
        (F.lit(0.01) * (F.col("idx") % 7) - 0.02).alias("w"),
        (F.lit(0.02) * (F.col("idx") % 5) - 0.03).alias("mu"),
    )
