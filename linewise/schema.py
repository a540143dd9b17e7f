"""Fixed names and values of the order-line table."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and types of one order line.
ORDER_LINE_TYPES = {
    "ORDERNUMBER": T.LongType(),
    "ORDERLINENUMBER": T.IntegerType(),
    "QUANTITYORDERED": T.DoubleType(),
    "PRICEEACH": T.DoubleType(),
    "SALES": T.DoubleType(),
    "MSRP": T.DoubleType(),
    "QTR_ID": T.IntegerType(),
    "MONTH_ID": T.IntegerType(),
    "YEAR_ID": T.IntegerType(),
}

# Columns removed or renamed when cleaning.
UNUSED_ADDRESS_COLUMNS = ["ADDRESSLINE2", "ADDRESSLINE3", "ADDRESSLINE4", "TERRITORY"]
ADDRESS_RENAME = {"ADDRESSLINE1": "ADDRESS"}
REQUIRED_COLUMNS = ["POSTALCODE"]

# Columns of the full study's feature matrix.
CATEGORICAL_FEATURES = ["STATUS", "PRODUCTLINE", "COUNTRY", "DEALSIZE"]
NUMERIC_FEATURES = [
    "QUANTITYORDERED", "PRICEEACH", "MSRP", "ORDERLINENUMBER", "QTR_ID", "MONTH_ID", "YEAR_ID",
    "DAY_OF_WEEK", "DAY_OF_MONTH", "WEEK_OF_YEAR", "PROFIT_MARGIN", "PRICE_DISCOUNT", "REVENUE_PER_UNIT",
    "CUSTOMER_ORDER_COUNT", "CUSTOMER_TOTAL_SALES", "CUSTOMER_AVG_SALES", "CUSTOMER_TOTAL_QTY",
    "PRODUCTLINE_AVG_SALES", "PRODUCTLINE_TOTAL_SALES", "PRODUCTLINE_AVG_QTY",
    "QTY_PRICE_INTERACTION", "STATUS_MSRP_RATIO",
]
# Columns of the list of largest orders.
TOP_COLUMNS = ["ORDERNUMBER", "CUSTOMERNAME", "SALES", "QUANTITYORDERED"]
TARGET = "SALES"
ROW_KEY = "ROW_KEY"

# Cleaned columns that the feature matrix is computed from.
FEATURE_SOURCES = [
    ROW_KEY, *CATEGORICAL_FEATURES, "QUANTITYORDERED", "PRICEEACH", "MSRP", "ORDERLINENUMBER", "QTR_ID", "MONTH_ID",
    "YEAR_ID", "ORDERDATE", "ORDERNUMBER", "CUSTOMERNAME", TARGET,
]

# Features computed from the target itself; left out of a leak-free study.
TARGET_DERIVED_FEATURES = ["PROFIT_MARGIN", "REVENUE_PER_UNIT"]

# Columns the dashboard removes before training, where present.
DASHBOARD_DROP = [
    "ORDERDATE", "ORDERNUMBER", "CUSTOMERNAME", "PHONE", "ADDRESSLINE1", "ADDRESSLINE2", "CITY", "STATE",
    "POSTALCODE", "TERRITORY", "CONTACTLASTNAME", "CONTACTFIRSTNAME",
]

# Share of the sale price assumed to be cost, and the status that counts as delivered.
COST_SHARE = 0.7
SHIPPED = "Shipped"

# Text that a CSV reader takes as missing.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Date formats tried in turn; month before day.
DATE_FORMATS = ["M/d/yyyy H:mm", "M/d/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]

# Formats tried on a whole column when its own is looked for; of equals the first is taken, so month goes before day.
CANDIDATE_FORMATS = ["M/d/yyyy H:mm", "d/M/yyyy H:mm", "M/d/yyyy", "d/M/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]

# Names a missing category gets before it is encoded.
MISSING_LABEL = "nan"
