"""Order lines as a projection of a star schema (lineitem, orders, part, customer, nation, region).

The expressions are plain SQL that Spark and other SQL engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAR_COLUMNS = {
    "ROW_KEY": "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "CAST(ROUND(l_extendedprice * 100) AS BIGINT))",
    "ORDERNUMBER": "o_orderkey",
    "ORDERLINENUMBER": "l_linenumber",
    "QUANTITYORDERED": "l_quantity",
    "PRICEEACH": "l_extendedprice / l_quantity",
    "SALES": "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE)",
    "MSRP": "CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_retailprice END",
    "ORDERDATE": "CAST(o_orderdate AS DATE)",
    "ORDERDATE_TEXT": "CASE WHEN o_orderkey % 100 = 0 THEN 'not a date' "
    "ELSE concat(month(o_orderdate), '/', day(o_orderdate), '/', year(o_orderdate), ' 0:00') END",
    "QTR_ID": "CAST(quarter(o_orderdate) AS INT)",
    "MONTH_ID": "CAST(month(o_orderdate) AS INT)",
    "YEAR_ID": "CAST(year(o_orderdate) AS INT)",
    "STATUS": "CASE o_orderstatus WHEN 'F' THEN 'Shipped' WHEN 'O' THEN 'In Process' ELSE 'On Hold' END",
    "PRODUCTLINE": "p_type",
    "DEALSIZE": "CASE WHEN l_extendedprice * (1 - l_discount) < 33000 THEN 'Small' "
    "WHEN l_extendedprice * (1 - l_discount) < 66000 THEN 'Medium' ELSE 'Large' END",
    "CUSTOMERNAME": "CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE c_name END",
    "COUNTRY": "n_name",
    "TERRITORY": "r_name",
    "POSTALCODE": "CASE WHEN c_custkey % 40 = 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR(20)) END",
    "ADDRESSLINE1": "concat('Street ', c_custkey)",
    "ADDRESSLINE2": "CAST(NULL AS VARCHAR(20))",
    "ADDRESSLINE3": "CAST(NULL AS VARCHAR(20))",
    "ADDRESSLINE4": "CAST(NULL AS VARCHAR(20))",
}


# Columns used, with their types: no job has to read file footers to plan a query.
STAR_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int",
    "part": "p_partkey bigint, p_type string, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double",
}


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item.

    Customers, nations and regions join to the orders first, so the line items, the largest side,
    move for the order key and the part key only. Which of these joins broadcast is left to Spark,
    which knows the true file sizes; Catalyst prunes unused columns from every scan.
    """

    def table(name: str) -> DataFrame:
        return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")

    places = table("nation").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = table("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table("orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    lines = table("lineitem").join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(*[F.expr(sql).alias(name) for name, sql in STAR_COLUMNS.items()])
