"""The driver's star tables seen as a search log.

search = order, hotel = part, impression = one (order, part) pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.session import bucket_number
from rankloom.sources.schema import COMPETITORS

_DOUBLE = "CAST({} AS DOUBLE)"


def _column_expressions() -> dict[str, str]:
    cols = {
        "srch_id": "srch_id",
        "prop_id": "prop_id",
        "date_time": "o_orderdate",
        "site_id": "CAST(o_custkey % 5 AS INT)",
        "visitor_location_country_id": "c_nationkey",
        "visitor_hist_starrating": "CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(1 + o_custkey % 5 AS DOUBLE) END",
        "visitor_hist_adr_usd": "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal / 40 END",
        "prop_country_id": "CAST(p_partkey % 25 AS INT)",
        "prop_starrating": "p_size % 6",
        "prop_review_score": "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_partkey % 10 AS DOUBLE) / 2 END",
        "prop_brand_bool": "CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE 1 END",
        "prop_location_score1": "CAST(p_partkey % 70 AS DOUBLE) / 10",
        "prop_location_score2": "CASE WHEN tax = 0 THEN NULL ELSE CAST(tax * 10 AS DOUBLE) END",
        "prop_log_historical_price": "LN(p_retailprice / 10)",
        "position": "position",
        "price_usd": "price_raw / qty / 10",
        "promotion_flag": "CASE WHEN disc > CAST(0.07 AS DOUBLE) THEN 1 ELSE 0 END",
        "srch_destination_id": "o_custkey % 40",
        "srch_length_of_stay": "CAST(1 + srch_id % 7 AS INT)",
        "srch_booking_window": "CAST(EXTRACT(DOY FROM o_orderdate) - 1 AS INT)",
        "srch_adults_count": "CAST(1 + srch_id % 3 AS INT)",
        "srch_children_count": "CAST((srch_id + o_custkey) % 3 AS INT)",
        "srch_room_count": "1",
        "srch_saturday_night_bool": "CAST(srch_id % 2 AS INT)",
        "srch_query_affinity_score": "CASE WHEN srch_id % 8 < 6 THEN NULL ELSE CAST(-1 * (5 + prop_id % 20) AS DOUBLE) END",
        "orig_destination_distance": "CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST((o_custkey * 37 + prop_id) % 3000 AS DOUBLE) END",
        "random_bool": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END",
        "click_bool": "click_bool",
        "booking_bool": "booking_bool",
        "gross_bookings_usd": "CASE WHEN booking_bool = 1 THEN price_raw ELSE NULL END",
    }
    for i in COMPETITORS:
        cols[f"comp{i}_rate"] = (
            f"CASE (prop_id * {i} + srch_id) % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(-1 AS DOUBLE) "
            "WHEN 2 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END"
        )
        cols[f"comp{i}_inv"] = (
            f"CASE (prop_id + srch_id * {i}) % 3 WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS DOUBLE) "
            "ELSE CAST(1 AS DOUBLE) END"
        )
        cols[f"comp{i}_rate_percent_diff"] = (
            f"CASE (prop_id * {i} + srch_id * 3) % 5 WHEN 0 THEN NULL "
            f"ELSE CAST((prop_id * {i} + srch_id * 3) % 5 * 7 AS DOUBLE) END"
        )
    return cols


LOG_EXPRESSIONS = _column_expressions()



def bucket_count(spark: SparkSession, sf_dir: str) -> int:
    """Partitions of ``search_base``; they grow with the rows."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    return bucket_number(rows, spark.sparkContext.defaultParallelism)


def search_base(spark: SparkSession, sf_dir: str, n: int | None = None) -> DataFrame:
    """One row per impression with the columns that ``LOG_EXPRESSIONS`` read, dealt by search over ``n`` partitions.

    The log's 53 columns follow from these 17 row by row, so only these are shuffled and stored.
    """
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    flag = F.col("l_returnflag")
    lines = table("lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_returnflag"
    )
    n = n or bucket_count(spark, sf_dir)
    impressions = (
        lines.repartition(n, "l_orderkey")
        .groupBy(F.col("l_orderkey").alias("srch_id"), F.col("l_partkey").alias("prop_id"))
        .agg(
            F.min("l_linenumber").alias("position"),
            F.max("l_extendedprice").alias("price_raw"),
            F.max("l_discount").alias("disc"),
            F.max("l_tax").alias("tax"),
            F.max("l_quantity").alias("qty"),
            F.max(F.when(flag == "R", 1).otherwise(0)).alias("booking_bool"),
            F.max(F.when(flag.isin("R", "A"), 1).otherwise(0)).alias("click_bool"),
        )
    )
    orders = table("orders").join(
        table("customer").select("c_custkey", "c_nationkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey")
    ).repartition(n, "o_orderkey")
    part = table("part").select("p_partkey", "p_size", "p_type", "p_retailprice")
    return (
        impressions.join(part, F.col("prop_id") == F.col("p_partkey"))
        .join(orders, F.col("srch_id") == F.col("o_orderkey"))
        .select(*BASE_COLUMNS)
    )


BASE_COLUMNS = [
    "srch_id", "prop_id", "position", "price_raw", "disc", "tax", "qty", "booking_bool", "click_bool", "o_custkey",
    "o_orderdate", "o_orderpriority", "c_nationkey", "c_acctbal", "p_size", "p_type", "p_retailprice",
]


def log_view(base: DataFrame) -> DataFrame:
    """The log's columns over the rows of ``search_base``; a query computes those it reads."""
    rows = base.withColumn("p_partkey", F.col("prop_id"))
    return rows.select(*[F.col(name) if sql == name else F.expr(sql).alias(name) for name, sql in LOG_EXPRESSIONS.items()])


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as one lazy plan; unused columns are pruned."""
    return log_view(search_base(spark, sf_dir))
