"""Input tables of the registered queries, derived from the given parquet tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import prepare
from quarry.sources import read_table
from quarry.session import cut

CONTINUOUS = ["n_orders", "total", "avg_price", "recency", "c_acctbal"]
NOMINAL = ["c_mktsegment"]
AS_OF = "2002-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def rfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: number, sum and mean of orders, days since the last one, balance, segment."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("row_id")).agg(
        F.count(F.lit(1)).cast("double").alias("n_orders"), F.sum("o_totalprice").alias("total"), F.avg("o_totalprice").alias("avg_price"),
        F.datediff(F.to_date(F.lit(AS_OF)), F.max("o_orderdate").cast("date")).cast("double").alias("recency"),
    )
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), "c_acctbal", "c_mktsegment")
    return orders.join(customer, "row_id")


def events_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with every 17th value and every 23rd type missing."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 23 != 0, F.col("event_type")).alias("event_type"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("cluster"))


# Fixed linear projections of all coordinates to two, as rules for the weights of coordinate i.
LOW = (lambda i: ((7 * i) % 13 - 6) / 6.0, lambda i: ((5 * i) % 11 - 5) / 5.0)
OTHER = (lambda i: ((3 * i) % 7 - 3) / 3.0, lambda i: ((11 * i) % 17 - 8) / 8.0)


def embeddings_low(spark: SparkSession, sf_dir: str, rules: tuple = LOW) -> DataFrame:
    """All coordinates projected linearly to two."""
    e = embeddings(spark, sf_dir)
    width = e.select(F.max(F.size("x"))).first()[0] or 0
    parts = [sum((F.col("x")[i] * F.lit(rule(i)) for i in range(width)), F.lit(0.0)) for rule in rules]
    return e.select("row_id", F.array(*parts).alias("x"))


def labelled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected embeddings with their label ``y``, cluster columns ``k2``, ``k3``, ``k4`` by half-planes of the projection, and
    ``marked``: ``k4`` with two ids of every seven as noise (-1)."""
    low = cut(embeddings_low(spark, sf_dir))
    e = embeddings(spark, sf_dir).select("row_id", F.col("cluster").alias("y"))
    u, v = F.col("x")[0], F.col("x")[1]
    k2, k3 = (u > 0).cast("int"), F.when(u > 0, 0).when(v > 0, 1).otherwise(2)
    k4 = (u > 0).cast("int") * 2 + (v > 0).cast("int")
    noise = F.pmod("row_id", F.lit(7)) < 2
    return low.join(e, "row_id").select("row_id", "x", "y", F.when(noise, -1).otherwise(k4).alias("marked"), k2.alias("k2"), k3.alias("k3"), k4.alias("k4"))


def events_with_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with gaps and, by key, far values in two columns that have none."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").cast("double").alias("user_id"),
        F.when(e % 17 != 0, F.col("value") + F.when(e % 101 == 0, 1e6).otherwise(0.0)).alias("value"),
        ((e % 50) + F.when(e % 97 == 0, 5000.0).otherwise(0.0)).alias("load"),
        F.when(e % 23 != 0, F.col("event_type")).alias("event_type"),
    )


def scaled_rfm(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str], dict[str, prepare.Scale]]:
    """Continuous and one-hot columns, standardised and written once, with the fitted scaler."""
    base = cut(rfm(spark, sf_dir))
    levels = prepare.fit_levels(base, NOMINAL)
    cols = [*CONTINUOUS, *prepare.level_columns(levels)]
    matrix = prepare.model_matrix(base, CONTINUOUS, [], levels)
    scaler = prepare.fit_scaler(matrix, cols)
    return cut(prepare.standardize(matrix, scaler)), cols, scaler
