"""SQL twins of the registered queries, written for another engine over the same tables."""

from __future__ import annotations

from linewise import schema as S
from linewise.sources import synthetic
from linewise.sources.star import STAR_COLUMNS

_SALES = (
    "sales AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in STAR_COLUMNS.items()) + " FROM lineitem "
    "JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey "
    "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey)"
)
_CLEANED = (
    "cleaned AS (SELECT * EXCLUDE (ADDRESSLINE1, ADDRESSLINE2, ADDRESSLINE3, ADDRESSLINE4, TERRITORY), "
    "ADDRESSLINE1 AS ADDRESS FROM sales WHERE POSTALCODE IS NOT NULL)"
)
_FILLED = "filled AS (SELECT * REPLACE (COALESCE(MSRP, (SELECT median(MSRP) FROM cleaned)) AS MSRP) FROM cleaned)"


def _total(c: str) -> str:
    return f"CAST(COALESCE(SUM(CAST({c} AS DECIMAL(38,10))), 0) AS DOUBLE)"


def _mean(c: str) -> str:
    return f"{_total(c)} / NULLIF(COUNT({c}), 0)"


# The split by the first eight digits of the key's md5, tenths 8 and 9 being the test part; the fold by the next eight.
_SPLIT = "CASE WHEN ('0x' || left(md5(ROW_KEY), 8))::BIGINT % 10 IN (8, 9) THEN 'test' ELSE 'train' END"
_FOLD = "CAST(('0x' || md5(ROW_KEY)[9:16])::BIGINT % 5 AS INT)"
# The same hash as an order: its fifth of the rows, rounded up, is the test part. Hexadecimal digits sort like the number.
_EXACT_SPLIT = (
    ", parted AS (SELECT ROW_KEY, CASE WHEN row_number() OVER (ORDER BY left(md5(ROW_KEY), 8), ROW_KEY) <= (COUNT(*) OVER () + 4) // 5 "
    "THEN 'test' ELSE 'train' END AS split FROM sales) "
)
_UNTYPED = (
    ", untyped AS (SELECT ROW_KEY, ORDERNUMBER::VARCHAR AS WHOLE, POSTALCODE AS GAPS, MSRP AS NUMBER, "
    "CASE WHEN ORDERNUMBER % 100 = 0 THEN 'unknown' ELSE MSRP::VARCHAR END AS MIXED, "
    "CASE WHEN STATUS = 'Shipped' THEN 'True' ELSE 'False' END AS FLAG, NULL::VARCHAR AS NOTHING FROM sales) "
)
_COLUMN_KINDS = (
    ", cells AS (UNPIVOT (SELECT ROW_KEY, WHOLE, COALESCE(GAPS, '') AS GAPS, COALESCE(NUMBER::VARCHAR, '') AS NUMBER, "
    "COALESCE(MIXED, '') AS MIXED, FLAG, COALESCE(NOTHING, '') AS NOTHING FROM untyped) "
    "ON ROW_KEY, WHOLE, GAPS, NUMBER, MIXED, FLAG, NOTHING INTO NAME column_name VALUE x), "
    "counts AS (SELECT column_name, COUNT(*) AS n_cells, COUNT(*) FILTER (x = '') AS n_missing, "
    "COUNT(*) FILTER (x IN ('True', 'False')) AS n_boolean, COUNT(*) FILTER (TRY_CAST(x AS BIGINT) IS NOT NULL AND NOT x LIKE '%.%') AS n_integer, "
    "COUNT(*) FILTER (TRY_CAST(x AS DOUBLE) IS NOT NULL) AS n_double FROM cells GROUP BY column_name) "
    "SELECT column_name, CASE WHEN n_missing = n_cells THEN 'double' WHEN n_boolean = n_cells THEN 'boolean' WHEN n_integer = n_cells THEN 'integer' "
    "WHEN n_double + n_missing = n_cells THEN 'double' ELSE 'text' END AS kind, n_missing, n_boolean, n_integer, n_double, n_cells FROM counts"
)


def _round(k: int, before: str, scale: str) -> str:
    """CTEs of boosting round k over g (q, n, s, f): lines, sum of the target and prediction so far by quantity."""
    rest = f"(s - n * f)"
    return (
        f", left{k} AS (SELECT q, SUM(n) OVER w AS ln, SUM({rest}) OVER w AS ls, SUM(n) OVER () AS n, SUM({rest}) OVER () AS s FROM {before} "
        f"WINDOW w AS (ORDER BY q)), "
        f"best{k} AS (SELECT q AS cut, ls / ln AS low, (s - ls) / (n - ln) AS high, ls * ls / ln + (s - ls) * (s - ls) / (n - ln) - s * s / n AS gain "
        f"FROM left{k} WHERE ln < n ORDER BY gain DESC LIMIT 1), "
        f"g{k} AS (SELECT q, n, s, f + {scale} * CASE WHEN q <= cut THEN low ELSE high END AS f FROM {before}, best{k})"
    )


# Later rounds fit twice the residual, at a tenth of its weight.
_ROUNDS = (
    ", g0 AS (SELECT QUANTITYORDERED AS q, COUNT(*) AS n, SUM(SALES) AS s, 0.0::DOUBLE AS f FROM train GROUP BY q)"
    + _round(1, "g0", "1") + _round(2, "g1", "0.2::DOUBLE") + _round(3, "g2", "0.2::DOUBLE")
)
# What a scenario may hold, and columns that cleaning leaves out, stated here apart from the engine.
BOUNDS = {"QUANTITYORDERED": (10, 200), "PRICEEACH": (10, 500), "MSRP": (10, 500)}

_CUSTOMER = (
    f"SELECT CUSTOMERNAME, COUNT(ORDERNUMBER) AS CUSTOMER_ORDER_COUNT, {_total('SALES')} AS CUSTOMER_TOTAL_SALES, "
    f"{_mean('SALES')} AS CUSTOMER_AVG_SALES, {_total('QUANTITYORDERED')} AS CUSTOMER_TOTAL_QTY "
    "FROM {0} WHERE CUSTOMERNAME IS NOT NULL GROUP BY CUSTOMERNAME"
)
_PRODUCT = (
    f"SELECT PRODUCTLINE, {_mean('SALES')} AS PRODUCTLINE_AVG_SALES, {_total('SALES')} AS PRODUCTLINE_TOTAL_SALES, "
    f"{_mean('QUANTITYORDERED')} AS PRODUCTLINE_AVG_QTY FROM {{0}} WHERE PRODUCTLINE IS NOT NULL GROUP BY PRODUCTLINE"
)
_CUSTOMER_APP = (
    f"SELECT CUSTOMERNAME, {_mean('SALES')} AS CUST_AVG_SALES, {_total('SALES')} AS CUST_TOTAL_SALES, "
    "COUNT(SALES) AS CUST_ORDER_COUNT FROM {0} WHERE CUSTOMERNAME IS NOT NULL GROUP BY CUSTOMERNAME"
)
_PRODUCT_APP = (
    f"SELECT PRODUCTLINE, {_mean('SALES')} AS PROD_AVG_SALES FROM {{0}} WHERE PRODUCTLINE IS NOT NULL GROUP BY PRODUCTLINE"
)

_PROFIT_MARGIN = "(SALES - QUANTITYORDERED * (PRICEEACH * 0.7::DOUBLE)) / NULLIF(SALES, 0)"
_PRICE_DISCOUNT = "(MSRP - PRICEEACH) / NULLIF(MSRP, 0)"
_REVENUE_PER_UNIT = "SALES / NULLIF(QUANTITYORDERED, 0)"
_STATUS_MSRP = "CASE WHEN STATUS = 'Shipped' THEN 1 ELSE 0 END * MSRP"
_DOW, _DOM, _WEEK = (
    "CAST(isodow(ORDERDATE) - 1 AS INT)", "CAST(day(ORDERDATE) AS INT)", "CAST(week(ORDERDATE) AS INT)",
)

_FEATURES = (
    f"cust AS ({_CUSTOMER.format('filled')}), prod AS ({_PRODUCT.format('filled')}), "
    f"feats AS (SELECT f.* REPLACE (CAST(ORDERDATE AS TIMESTAMP) AS ORDERDATE), {_PROFIT_MARGIN} AS PROFIT_MARGIN, "
    f"{_PRICE_DISCOUNT} AS PRICE_DISCOUNT, {_REVENUE_PER_UNIT} AS REVENUE_PER_UNIT, {_DOW} AS DAY_OF_WEEK, "
    f"{_DOM} AS DAY_OF_MONTH, {_WEEK} AS WEEK_OF_YEAR, cust.* EXCLUDE (CUSTOMERNAME), prod.* EXCLUDE (PRODUCTLINE), "
    f"QUANTITYORDERED * PRICEEACH AS QTY_PRICE_INTERACTION, {_STATUS_MSRP} AS STATUS_MSRP_RATIO "
    "FROM filled f LEFT JOIN cust ON f.CUSTOMERNAME = cust.CUSTOMERNAME "
    "LEFT JOIN prod ON f.PRODUCTLINE = prod.PRODUCTLINE)"
)


def _codes(source: str, columns: list[str]) -> str:
    """Rank of each label among its column's distinct labels, per column."""
    return ", ".join(
        f"codes_{c} AS (SELECT label, CAST(ROW_NUMBER() OVER (ORDER BY label) - 1 AS INT) AS code FROM "
        f"(SELECT DISTINCT COALESCE({c}, 'nan') AS label FROM {source}))"
        for c in columns
    )


def _code_joins(columns: list[str]) -> str:
    return " ".join(f"LEFT JOIN codes_{c} ON COALESCE(s.{c}, 'nan') = codes_{c}.label" for c in columns)


_CUSTOMER_COLUMNS = ["CUSTOMER_ORDER_COUNT", "CUSTOMER_TOTAL_SALES", "CUSTOMER_AVG_SALES", "CUSTOMER_TOTAL_QTY"]


def _matrix_column(c: str) -> str:
    if c in S.CATEGORICAL_FEATURES:
        return f"codes_{c}.code AS {c}"
    if c in _CUSTOMER_COLUMNS:
        return f"COALESCE(CAST({c} AS DOUBLE), (SELECT median({c}) FROM feats)) AS {c}"
    return c


_FEATURE_COLUMNS = [*S.CATEGORICAL_FEATURES, *S.NUMERIC_FEATURES]
_MATRIX = (
    f"{_codes('feats', S.CATEGORICAL_FEATURES)}, matrix AS (SELECT ROW_KEY, "
    f"{', '.join(_matrix_column(c) for c in _FEATURE_COLUMNS)}, SALES FROM feats s {_code_joins(S.CATEGORICAL_FEATURES)})"
)


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


_TO_SALES = _with(_SALES)
_TO_CLEANED = _with(_SALES, _CLEANED)
_TO_FILLED = _with(_SALES, _CLEANED, _FILLED)
_TO_FEATURES = _with(_SALES, _CLEANED, _FILLED, _FEATURES)
_TO_MATRIX = _with(_SALES, _CLEANED, _FILLED, _FEATURES, _MATRIX)


def _describe(source: str, columns: list[str], digits: int) -> str:
    def one(c: str) -> str:
        x = f"CAST({c} AS DOUBLE)"
        stats = {
            "mean": f"AVG({x})", "std": f"STDDEV_SAMP({x})", "min": f"MIN({x})",
            "q25": f"quantile_cont({x}, 0.25)", "q50": f"quantile_cont({x}, 0.5)", "q75": f"quantile_cont({x}, 0.75)",
            "max": f"MAX({x})",
        }
        shown = ", ".join(f'ROUND({sql}, {digits}) AS "{name}"' for name, sql in stats.items())
        return f"SELECT '{c}' AS column_name, COUNT({c}) AS \"count\", {shown} FROM {source}"

    return " UNION ALL ".join(one(c) for c in columns)


def _long_counts(source: str, columns: list[str], stat: str, value: str) -> str:
    wide = ", ".join(f"{stat.format(c)} AS {c}" for c in columns)
    return f"SELECT column_name, {value} FROM (UNPIVOT (SELECT {wide} FROM {source}) ON COLUMNS(*) INTO NAME column_name VALUE {value})"


_SALES_COLUMNS = list(STAR_COLUMNS)
_SALES_KINDS = {
    "ORDERNUMBER": "bigint", "ORDERLINENUMBER": "int", "QUANTITYORDERED": "double", "PRICEEACH": "double",
    "SALES": "double", "MSRP": "double", "ORDERDATE": "date", "QTR_ID": "int", "MONTH_ID": "int", "YEAR_ID": "int",
}
_NUMERIC = [c for c, kind in _SALES_KINDS.items() if kind != "date"]
_CLEANED_COLUMNS = [
    c for c in _SALES_COLUMNS if c not in S.UNUSED_ADDRESS_COLUMNS and c != "ADDRESSLINE1"
] + ["ADDRESS"]
_DROPPED = [c for c in S.DASHBOARD_DROP if c in _SALES_COLUMNS]


def _histogram(source: str, value: str, bins: int) -> str:
    """CTEs up to `hist`: counts per equal-width bin, empty bins included."""
    edge = "(lo + {0} * w)"
    return (
        f"vals AS (SELECT {value} AS x FROM {source} WHERE {value} IS NOT NULL), "
        "raw AS (SELECT MIN(x) AS a, MAX(x) AS b FROM vals), "
        "lim AS (SELECT CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5 ELSE b END AS hi, "
        f"(hi - lo) / {bins} AS w FROM raw), "
        f"first AS (SELECT x, lo, w, LEAST(FLOOR((x - lo) * ({bins} / (hi - lo))), {bins - 1}) AS b FROM vals, lim), "
        f"placed AS (SELECT CASE WHEN x < {edge.format('b')} THEN b - 1 "
        f"WHEN b < {bins - 1} AND x >= {edge.format('(b + 1)')} THEN b + 1 ELSE b END AS bin FROM first), "
        "cnt AS (SELECT CAST(bin AS INT) AS bin, COUNT(*) AS n FROM placed GROUP BY 1), "
        f"hist AS (SELECT CAST(i AS INT) AS bin, ROUND(lo + i * w, 4) AS low, "
        f"ROUND(CASE WHEN i = {bins - 1} THEN hi ELSE lo + (i + 1) * w END, 4) AS high, COALESCE(n, 0) AS n "
        f"FROM range({bins}) AS t(i), lim LEFT JOIN cnt ON cnt.bin = i)"
    )


def _bin_of(x: str, bins: int) -> str:
    lo, hi = f"(SELECT MIN({x}) FROM sales)", f"(SELECT MAX({x}) FROM sales)"
    b = f"LEAST(FLOOR(({x} - {lo}) * ({bins} / ({hi} - {lo}))), {bins - 1})"
    w = f"(({hi} - {lo}) / {bins})"
    return (
        f"CAST(CASE WHEN {x} < {lo} + {b} * {w} THEN {b} - 1 "
        f"WHEN {b} < {bins - 1} AND {x} >= {lo} + ({b} + 1) * {w} THEN {b} + 1 ELSE {b} END AS INT)"
    )


def _draw(name: str, key: str = "o_orderkey", seed: int = synthetic.DEFAULT_SEED) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{name}', {key})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _whole(name: str, low: int, high: int) -> str:
    return f"CAST({low} + FLOOR({_draw(name)} * {high - low}) AS INT)"


def _between(name: str, bounds: tuple[float, float]) -> str:
    low, high = bounds
    return f"({low}::DOUBLE + {_draw(name)} * ({high}::DOUBLE - {low}::DOUBLE))"


def _one_of(name: str, values: list[str]) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{_whole(name, 1, len(values) + 1)}]"


def _weighted(name: str, values: list[str], weights: list[float]) -> str:
    reached, cases = 0.0, []
    for value, weight in zip(values[:-1], weights[:-1]):
        reached = round(reached + weight, 10)
        cases.append(f"WHEN {_draw(name)} < {reached}::DOUBLE THEN '{value}'")
    return f"CASE {' '.join(cases)} ELSE '{values[-1]}' END"


_SYNTHETIC = (
    f"SELECT o_orderkey, CAST(DATE '{synthetic.FIRST_DAY}' + {_whole('ORDERDATE', 0, synthetic.DEFAULT_ROWS)} AS DATE) "
    f"AS ORDERDATE, {_one_of('PRODUCTLINE', synthetic.PRODUCT_LINES)} AS PRODUCTLINE, "
    f"{_weighted('STATUS', synthetic.STATUSES, synthetic.STATUS_WEIGHTS)} AS STATUS, "
    f"{_whole('QUANTITYORDERED', *synthetic.QUANTITY_RANGE)} AS QUANTITYORDERED, "
    f"{_between('PRICEEACH', synthetic.PRICE_RANGE)} AS PRICEEACH, "
    f"{_one_of('DEALSIZE', synthetic.DEAL_SIZES)} AS DEALSIZE, {_between('MSRP', synthetic.MSRP_RANGE)} AS MSRP, "
    f"concat('Customer_', {_whole('CUSTOMERNAME', *synthetic.CUSTOMER_RANGE)}) AS CUSTOMERNAME, "
    f"{_one_of('COUNTRY', synthetic.COUNTRIES)} AS COUNTRY, "
    f"{_whole('QUANTITYORDERED', *synthetic.QUANTITY_RANGE)} * {_between('PRICEEACH', synthetic.PRICE_RANGE)} * "
    f"{_between('SALES', synthetic.NOISE_RANGE)} AS SALES FROM orders"
)

# Simple predictors on the cleaned, filled lines
_BASELINES = (
    f"lines AS (SELECT *, {_SPLIT} AS split FROM filled), train AS (SELECT * FROM lines WHERE split = 'train'), "
    f"overall AS (SELECT {_mean('SALES')} AS m, regr_slope(SALES, QUANTITYORDERED) AS slope, "
    "regr_intercept(SALES, QUANTITYORDERED) AS intercept FROM train), "
    f"by_product AS (SELECT PRODUCTLINE, {_mean('SALES')} AS m FROM train GROUP BY PRODUCTLINE), "
    f"by_customer AS (SELECT CUSTOMERNAME, {_mean('SALES')} AS m FROM train WHERE CUSTOMERNAME IS NOT NULL GROUP BY 1), "
    "wide AS (SELECT l.split, l.ROW_KEY, l.SALES AS label, l.QUANTITYORDERED * l.PRICEEACH AS quantity_x_price, "
    "o.m AS train_mean, COALESCE(p.m, o.m) AS product_mean, COALESCE(c.m, o.m) AS customer_mean, "
    "l.QUANTITYORDERED * o.slope + o.intercept AS quantity_line FROM lines l, overall o "
    "LEFT JOIN by_product p ON l.PRODUCTLINE = p.PRODUCTLINE LEFT JOIN by_customer c ON l.CUSTOMERNAME = c.CUSTOMERNAME), "
    "long AS (" + " UNION ALL ".join(
        f"SELECT '{m}' AS model, split, ROW_KEY, label, {m} AS prediction FROM wide"
        for m in ("quantity_x_price", "train_mean", "product_mean", "customer_mean", "quantity_line")
    ) + "), "
    "measured AS (SELECT model, split, 1 - SUM((label - prediction) ** 2) / regr_syy(label, label) AS r2, "
    "SQRT(AVG((label - prediction) ** 2)) AS rmse, AVG(ABS(label - prediction)) AS mae, COUNT(*) AS n "
    "FROM long GROUP BY model, split), "
    "comparison AS (SELECT tr.model, tr.r2 AS train_r2, te.r2 AS test_r2, te.rmse, te.mae FROM measured tr "
    "JOIN measured te ON tr.model = te.model AND tr.split = 'train' AND te.split = 'test')"
)
_TO_BASELINES = _with(_SALES, _CLEANED, _FILLED, _BASELINES)


def _settled(sql: str) -> str:
    return f"CASE WHEN model = 'quantity_line' THEN ROUND({sql}, 4) ELSE {sql} END"


def _cv(folds: int) -> str:
    """Each fold predicted by statistics taken directly from the rows of the other folds."""
    return (
        _with(_SALES, _CLEANED, _FILLED)
        + f", train AS (SELECT *, {_FOLD} AS fold FROM filled WHERE {_SPLIT} = 'train'), "
        f"f AS (SELECT CAST(i AS INT) AS i FROM range({folds}) AS t(i)), "
        f"overall AS (SELECT i, {_mean('SALES')} AS m, regr_slope(SALES, QUANTITYORDERED) AS slope, "
        "regr_intercept(SALES, QUANTITYORDERED) AS intercept FROM train JOIN f ON fold <> i GROUP BY i), "
        f"p AS (SELECT i, PRODUCTLINE, {_mean('SALES')} AS m FROM train JOIN f ON fold <> i GROUP BY 1, 2), "
        f"c AS (SELECT i, CUSTOMERNAME, {_mean('SALES')} AS m FROM train JOIN f ON fold <> i "
        "WHERE CUSTOMERNAME IS NOT NULL GROUP BY 1, 2), "
        "wide AS (SELECT fold, SALES AS label, QUANTITYORDERED * PRICEEACH AS quantity_x_price, o.m AS train_mean, "
        "COALESCE(p.m, o.m) AS product_mean, COALESCE(c.m, o.m) AS customer_mean, "
        "QUANTITYORDERED * slope + intercept AS quantity_line FROM train l JOIN overall o ON l.fold = o.i "
        "LEFT JOIN p ON l.PRODUCTLINE = p.PRODUCTLINE AND l.fold = p.i "
        "LEFT JOIN c ON l.CUSTOMERNAME = c.CUSTOMERNAME AND l.fold = c.i), "
        "long AS (" + " UNION ALL ".join(
            f"SELECT '{m}' AS model, fold, label, {m} AS prediction FROM wide"
            for m in ("quantity_x_price", "train_mean", "product_mean", "customer_mean", "quantity_line")
        ) + "), "
        "r AS (SELECT model, fold, 1 - SUM((label - prediction) ** 2) / regr_syy(label, label) AS r2 FROM long GROUP BY 1, 2) "
        "SELECT model, ROUND(AVG(r2), 8) AS mean_r2, COUNT(*) AS folds FROM r GROUP BY model"
    ).replace(" , train AS", ", train AS")


def _grid() -> str:
    def values(vs: list[float]) -> str:
        return "(" + " UNION ALL ".join(f"SELECT {v}::DOUBLE AS v" for v in vs) + ")"

    q, p, m = BOUNDS["QUANTITYORDERED"], BOUNDS["PRICEEACH"], BOUNDS["MSRP"]
    return (
        _TO_SALES + "SELECT o.PRODUCTLINE, o.DEALSIZE, q.v AS QUANTITYORDERED, p.v AS PRICEEACH, m.v AS MSRP, "
        "q.v * p.v AS ESTIMATE FROM (SELECT PRODUCTLINE, DEALSIZE FROM (SELECT DISTINCT PRODUCTLINE FROM sales WHERE PRODUCTLINE IS NOT NULL), "
        "(SELECT DISTINCT DEALSIZE FROM sales WHERE DEALSIZE IS NOT NULL)) o, "
        f"{values([5, 10, 50, 100, 200, 250])} q, {values([5, 10, 100, 500, 600])} p, {values([110, 501])} m "
        f"WHERE q.v BETWEEN {q[0]} AND {q[1]} AND p.v BETWEEN {p[0]} AND {p[1]} AND m.v BETWEEN {m[0]} AND {m[1]}"
    )


_DATED = "dated AS (SELECT * EXCLUDE (ORDERDATE_TEXT) REPLACE (try_strptime(ORDERDATE_TEXT, '%m/%d/%Y %H:%M') AS ORDERDATE) FROM sales)"
_TO_DATED = _with(_SALES, _DATED)
# The candidate formats in both engines' spelling; a cell is unlike where an earlier one reads it as another time.
_FORMATS = {
    "M/d/yyyy H:mm": "%m/%d/%Y %H:%M", "d/M/yyyy H:mm": "%d/%m/%Y %H:%M", "M/d/yyyy": "%m/%d/%Y", "d/M/yyyy": "%d/%m/%Y",
    "yyyy-MM-dd HH:mm:ss": "%Y-%m-%d %H:%M:%S", "yyyy-MM-dd": "%Y-%m-%d",
}
_FORMAT_COUNTS = ", tried AS (SELECT ORDERDATE_TEXT AS x, " + ", ".join(
    f"try_strptime(ORDERDATE_TEXT, '{f}') AS t{i}" for i, f in enumerate(_FORMATS.values())
) + " FROM sales) " + " UNION ALL ".join(
    f"SELECT '{f}' AS format, {i} AS place, COUNT(t{i}) AS n_fit, COUNT(*) FILTER (t{i} <> "
    + (f"COALESCE({', '.join(f't{j}' for j in range(i))}, NULL)" if i else "NULL::TIMESTAMP") + ") AS n_unlike, COUNT(x) AS n_text FROM tried"
    for i, f in enumerate(_FORMATS)
)
_APP = (
    f"cust AS ({_CUSTOMER_APP.format('dated')}), prod AS ({_PRODUCT_APP.format('dated')}), "
    "guarded AS (SELECT d.*, year(ORDERDATE) AS YEAR, month(ORDERDATE) AS MONTH, isodow(ORDERDATE) - 1 AS DAY_OF_WEEK, "
    "quarter(ORDERDATE) AS QUARTER, cust.* EXCLUDE (CUSTOMERNAME), prod.* EXCLUDE (PRODUCTLINE), "
    "QUANTITYORDERED * PRICEEACH AS THEORETICAL_REV FROM dated d LEFT JOIN cust ON d.CUSTOMERNAME = cust.CUSTOMERNAME "
    "LEFT JOIN prod ON d.PRODUCTLINE = prod.PRODUCTLINE)"
)
_APP_FILLED = ["MSRP", "YEAR", "MONTH", "DAY_OF_WEEK", "QUARTER", "CUST_AVG_SALES", "CUST_TOTAL_SALES", "CUST_ORDER_COUNT"]
_ENCODE_ALL = ["STATUS", "PRODUCTLINE", "DEALSIZE", "COUNTRY", "ADDRESSLINE3", "ADDRESSLINE4"]


def _encoded(columns: list[str]) -> str:
    return (
        _with(_SALES, _codes("sales", columns))
        + f"SELECT s.ROW_KEY, {', '.join(f'codes_{c}.code AS {c}' for c in columns)} FROM sales s {_code_joins(columns)}"
    )


# Normal equations of two centred features
_TWO_SLOPES = (
    ", m AS (SELECT covar_pop(QUANTITYORDERED, QUANTITYORDERED) AS aa, covar_pop(PRICEEACH, PRICEEACH) AS bb, "
    "covar_pop(QUANTITYORDERED, PRICEEACH) AS ab, covar_pop(SALES, QUANTITYORDERED) AS ya, covar_pop(SALES, PRICEEACH) AS yb, "
    "AVG(QUANTITYORDERED) AS a, AVG(PRICEEACH) AS b, AVG(SALES) AS y FROM train), "
    "w AS (SELECT (ya * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS wb, a, b, y FROM m) "
    "SELECT 'QUANTITYORDERED' AS term, ROUND(wa, 4) AS value FROM w UNION ALL SELECT 'PRICEEACH', ROUND(wb, 4) FROM w "
    "UNION ALL SELECT 'intercept', ROUND(y - wa * a - wb * b, 4) FROM w"
)
# The threshold on whole quantities that leaves the least squared error, and the means on both sides of it
_STUMP = (
    ", q AS (SELECT QUANTITYORDERED AS quantity, COUNT(*) AS n, SUM(SALES) AS s FROM train GROUP BY 1), "
    "cut AS (SELECT t.quantity AS t, SUM(CASE WHEN q.quantity <= t.quantity THEN q.n END) AS nl, "
    "SUM(CASE WHEN q.quantity <= t.quantity THEN q.s END) AS sl, SUM(CASE WHEN q.quantity > t.quantity THEN q.n END) AS nr, "
    "SUM(CASE WHEN q.quantity > t.quantity THEN q.s END) AS sr FROM q t, q GROUP BY 1), "
    "best AS (SELECT * FROM cut WHERE nr > 0 ORDER BY sl * sl / nl + sr * sr / nr DESC LIMIT 1) "
    "SELECT quantity, n, ROUND(CASE WHEN quantity <= t THEN sl / nl ELSE sr / nr END, 4) AS prediction, "
    "CAST(1.0 AS DOUBLE) AS importance FROM q, best"
)


def oracle_sql() -> dict[str, str]:
    stats = ", ".join(_CUSTOMER_COLUMNS)
    return {
        "header_normalise": _TO_SALES + "SELECT ORDERNUMBER, CUSTOMERNAME, SALES, ROW_KEY FROM sales",
        "synthetic_source": _SYNTHETIC,
        "csv_roundtrip": _TO_SALES
        + "SELECT ROW_KEY, ORDERNUMBER, CUSTOMERNAME, POSTALCODE, QUANTITYORDERED, SALES, MSRP, STATUS FROM sales",
        "csv_rejects": _TO_SALES
        + "SELECT ROW_KEY, ORDERNUMBER, SALES, 'MSRP' AS bad_columns FROM sales WHERE ORDERNUMBER % 100 = 0",
        "csv_malformed": _TO_SALES
        + ", r AS (SELECT ORDERNUMBER % 100 AS kind, ROW_KEY || ',' || ORDERNUMBER AS start, CAST(QUANTITYORDERED AS INT) AS q FROM sales) "
        "SELECT CASE WHEN kind = 1 THEN start || ',' || q || ',surplus' ELSE start END AS record, '_CELLS' AS bad_columns FROM r WHERE kind IN (1, 2)",
        "csv_inferred": _TO_SALES + _UNTYPED
        + "SELECT ROW_KEY, WHOLE::BIGINT AS WHOLE, GAPS::DOUBLE AS GAPS, NUMBER, MIXED, FLAG = 'True' AS FLAG, NULL::DOUBLE AS NOTHING FROM untyped",
        "csv_column_kinds": _TO_SALES + _UNTYPED + _COLUMN_KINDS,
        "guarded_load": _TO_SALES
        + "SELECT 'clean' AS file, true AS loaded, COUNT(*) AS n_rows, 0 AS n_bad_shape, '' AS bad_cells FROM sales UNION ALL "
        "SELECT 'cells', false, COUNT(*), 0, 'MSRP:' || COUNT(*) FILTER (ORDERNUMBER % 100 = 0) FROM sales UNION ALL "
        "SELECT 'records', false, COUNT(*), COUNT(*) FILTER (ORDERNUMBER % 100 = 1), '' FROM sales UNION ALL SELECT 'absent', false, 0, 0, ''",
        "stored_customer_stats": _TO_SALES + _CUSTOMER.format("sales"),
        "exact_split": _TO_SALES + _EXACT_SPLIT + "SELECT ROW_KEY, split FROM parted",
        "exact_split_ratio": _TO_CLEANED
        + "SELECT n - (n + 4) // 5 AS n_train, (n + 4) // 5 AS n_test, (n - (n + 4) // 5) / NULLIF((n + 4) // 5, 0) AS ratio FROM (SELECT COUNT(*) AS n FROM cleaned)",
        "exact_folds": _TO_SALES + _EXACT_SPLIT
        + "SELECT ROW_KEY, CAST(CASE WHEN i < r * (q + 1) THEN i // (q + 1) ELSE r + (i - r * (q + 1)) // q END AS INT) AS fold FROM "
        "(SELECT ROW_KEY, row_number() OVER (ORDER BY md5(ROW_KEY)[9:16], ROW_KEY) - 1 AS i, COUNT(*) OVER () // 5 AS q, COUNT(*) OVER () % 5 AS r "
        "FROM parted WHERE split = 'train')",
        "boosted_rounds": _TO_BASELINES + _ROUNDS + " SELECT q AS quantity, n, ROUND(f, 4) AS prediction FROM g3",
        "split_gains": _TO_BASELINES + _ROUNDS
        + " SELECT 'QUANTITYORDERED' AS feature, 3 AS splits, ROUND(t / 1e6, 4) AS total_gain, ROUND(t / 3 / 1e6, 4) AS mean_gain, 1.0::DOUBLE AS importance "
        "FROM (SELECT (SELECT gain FROM best1) + (SELECT gain FROM best2) + (SELECT gain FROM best3) AS t)",
        "predictions_sink": _TO_BASELINES
        + "SELECT label AS Actual_Sales, prediction AS Predicted_Sales FROM long "
        "WHERE model = 'product_mean' AND split = 'test'",
        "row_count": _TO_SALES + f"SELECT COUNT(*) AS n_rows, CAST({len(_SALES_COLUMNS)} AS BIGINT) AS n_columns FROM sales",
        "head_rows": _TO_SALES + "SELECT * FROM sales ORDER BY ROW_KEY LIMIT 5",
        "non_null_profile": _TO_SALES
        + "SELECT column_name, CASE "
        + " ".join(f"WHEN column_name = '{c}' THEN '{kind}'" for c, kind in _SALES_KINDS.items())
        + f" ELSE 'string' END AS data_type, non_null FROM ({_long_counts('sales', _SALES_COLUMNS, 'COUNT({0})', 'non_null')})",
        "describe_numeric": _TO_SALES + _describe("sales", _NUMERIC, 4),
        "describe_features": _TO_MATRIX + _describe("matrix", _FEATURE_COLUMNS, 2),
        "null_counts": _TO_SALES + _long_counts("sales", _SALES_COLUMNS, "COUNT(*) - COUNT({0})", "n_null"),
        "null_counts_cleaned": _TO_CLEANED + _long_counts("cleaned", _CLEANED_COLUMNS, "COUNT(*) - COUNT({0})", "n_null"),
        "null_total": _TO_MATRIX
        + f"SELECT CAST({' + '.join(f'(COUNT(*) - COUNT({c}))' for c in _FEATURE_COLUMNS)} AS BIGINT) AS n_null FROM matrix",
        "distinct_counts": _TO_SALES + _long_counts("sales", _SALES_COLUMNS, "COUNT(DISTINCT {0})", "n_distinct"),
        "drop_strict": _TO_SALES + f"SELECT * EXCLUDE ({', '.join(S.UNUSED_ADDRESS_COLUMNS)}) FROM sales",
        "drop_lenient": _TO_SALES + f"SELECT * EXCLUDE ({', '.join(_DROPPED)}) FROM sales",
        "rename_address": _TO_SALES + "SELECT ROW_KEY, ADDRESSLINE1 AS ADDRESS FROM sales",
        "drop_null_postal": _TO_SALES + "SELECT ROW_KEY, POSTALCODE, SALES FROM sales WHERE POSTALCODE IS NOT NULL",
        "median_fill": _TO_FILLED + "SELECT ROW_KEY, QUANTITYORDERED, PRICEEACH, SALES, MSRP FROM filled",
        "median_fill_features": _TO_MATRIX + "SELECT * FROM matrix",
        "feature_select": _TO_FEATURES + f"SELECT ROW_KEY, {', '.join(_FEATURE_COLUMNS)}, SALES FROM feats",
        "guarded_features": _with(_SALES, f"prod AS ({_PRODUCT_APP.format('sales')})")
        + "SELECT s.ROW_KEY, s.PRODUCTLINE, QUANTITYORDERED, PRICEEACH, SALES, PROD_AVG_SALES, "
        "QUANTITYORDERED * PRICEEACH AS THEORETICAL_REV FROM sales s LEFT JOIN prod ON s.PRODUCTLINE = prod.PRODUCTLINE",
        "join_customer_stats": _with(_SALES, f"cust AS ({_CUSTOMER.format('sales')})")
        + f"SELECT s.ROW_KEY, s.CUSTOMERNAME, s.SALES, {stats} FROM sales s LEFT JOIN cust ON s.CUSTOMERNAME = cust.CUSTOMERNAME",
        "join_product_stats": _with(_SALES, f"prod AS ({_PRODUCT.format('sales')})")
        + "SELECT s.ROW_KEY, s.PRODUCTLINE, s.SALES, prod.* EXCLUDE (PRODUCTLINE) FROM sales s "
        "LEFT JOIN prod ON s.PRODUCTLINE = prod.PRODUCTLINE",
        "sales_by_productline": _TO_SALES + f"SELECT PRODUCTLINE, {_total('SALES')} AS total_sales FROM sales GROUP BY 1 ORDER BY 2 DESC",
        "avg_sales_by_year": _TO_SALES + f"SELECT YEAR_ID, {_mean('SALES')} AS avg_sales FROM sales GROUP BY 1 ORDER BY 1",
        "avg_sales_by_quarter": _TO_SALES + f"SELECT QTR_ID, {_mean('SALES')} AS avg_sales FROM sales GROUP BY 1 ORDER BY 1",
        **{f"{name}_cleaned": _TO_FILLED + sql for name, sql in {
            "sales_by_productline": f"SELECT PRODUCTLINE, {_total('SALES')} AS total_sales FROM filled GROUP BY 1",
            "avg_sales_by_year": f"SELECT YEAR_ID, {_mean('SALES')} AS avg_sales FROM filled GROUP BY 1",
            "avg_sales_by_quarter": f"SELECT QTR_ID, {_mean('SALES')} AS avg_sales FROM filled GROUP BY 1",
            "sales_by_status": f"SELECT STATUS, {_total('SALES')} AS total_sales FROM filled GROUP BY 1",
        }.items()},
        "sales_histogram_cleaned": _with(_SALES, _CLEANED, _FILLED, _histogram("filled", "SALES", 50)) + "SELECT * FROM hist",
        "kpis_app": _TO_DATED
        + f"SELECT {_total('SALES')} AS total_revenue, ROUND({_total('SALES')} / 1e6, 2) AS revenue_millions, "
        f"{_mean('SALES')} AS mean_line_value, COUNT(*) AS line_count, COUNT(DISTINCT CUSTOMERNAME) AS unique_customers FROM dated",
        "sales_by_productline_app": _TO_DATED + f"SELECT PRODUCTLINE, {_total('SALES')} AS total_sales FROM dated GROUP BY 1",
        "sales_by_orderdate_app": _TO_DATED
        + f"SELECT ORDERDATE, {_total('SALES')} AS total_sales FROM dated WHERE ORDERDATE IS NOT NULL GROUP BY 1",
        "dealsize_share_app": _TO_DATED
        + f"SELECT DEALSIZE, {_total('SALES')} AS total, {_total('SALES')} / (SELECT {_total('SALES')} FROM dated) AS share FROM dated GROUP BY 1",
        "ols_two_features": _TO_BASELINES + _TWO_SLOPES,
        "ridge_one_feature": _TO_BASELINES
        + ", r AS (SELECT regr_sxy(SALES, QUANTITYORDERED) / (regr_sxx(SALES, QUANTITYORDERED) + 1000) AS b, AVG(SALES) AS y, "
        "AVG(QUANTITYORDERED) AS x FROM train) SELECT 'QUANTITYORDERED' AS term, ROUND(b, 4) AS value FROM r "
        "UNION ALL SELECT 'intercept', ROUND(y - b * x, 4) FROM r",
        "forest_stump": _TO_BASELINES + _STUMP,
        "boosted_stump": _TO_BASELINES + _STUMP,
        "sales_by_status": _TO_SALES + f"SELECT STATUS, {_total('SALES')} AS total_sales FROM sales GROUP BY 1 ORDER BY 2 DESC",
        "sales_by_orderdate": _TO_SALES + f"SELECT ORDERDATE, {_total('SALES')} AS total_sales FROM sales GROUP BY 1 ORDER BY 1",
        "kpis": _TO_SALES
        + f"SELECT {_total('SALES')} AS total_revenue, ROUND({_total('SALES')} / 1e6, 2) AS revenue_millions, "
        f"{_mean('SALES')} AS mean_line_value, COUNT(*) AS line_count, COUNT(DISTINCT CUSTOMERNAME) AS unique_customers FROM sales",
        "dealsize_share": _TO_SALES
        + f"SELECT DEALSIZE, {_total('SALES')} AS total, {_total('SALES')} / (SELECT {_total('SALES')} FROM sales "
        "WHERE DEALSIZE IS NOT NULL) AS share FROM sales WHERE DEALSIZE IS NOT NULL GROUP BY 1",
        "customer_stats": _TO_SALES + _CUSTOMER.format("sales"),
        "customer_stats_app": _TO_SALES + _CUSTOMER_APP.format("sales"),
        "product_stats": _TO_SALES + _PRODUCT.format("sales"),
        "product_stats_app": _TO_SALES + _PRODUCT_APP.format("sales"),
        "sales_histogram": _with(_SALES, _histogram("sales", "SALES", 50)) + "SELECT * FROM hist",
        "qty_sales_corr": _TO_SALES + "SELECT ROUND(corr(QUANTITYORDERED, SALES), 8) AS correlation FROM sales",
        "qty_sales_points": _TO_SALES + "SELECT QUANTITYORDERED, SALES, STATUS FROM sales",
        "qty_sales_grid": _TO_SALES
        + f"SELECT {_bin_of('QUANTITYORDERED', 50)} AS x_bin, {_bin_of('SALES', 50)} AS y_bin, STATUS, COUNT(*) AS n "
        "FROM sales GROUP BY 1, 2, 3",
        "option_lists": _TO_SALES
        + "SELECT DISTINCT 'PRODUCTLINE' AS list_name, PRODUCTLINE AS choice FROM sales "
        "UNION ALL SELECT DISTINCT 'DEALSIZE', DEALSIZE FROM sales",
        "actual_min_max": _TO_SALES
        + f"SELECT {_SPLIT} AS split, MIN(SALES) AS min_value, MAX(SALES) AS max_value FROM sales GROUP BY 1",
        "sales_by_country_productline": _TO_SALES
        + f"SELECT COUNTRY, PRODUCTLINE, {_total('SALES')} AS total_sales FROM sales GROUP BY 1, 2",
        "sales_by_year_quarter": _TO_SALES + f"SELECT YEAR_ID, QTR_ID, {_total('SALES')} AS total_sales FROM sales GROUP BY 1, 2",
        "top_orders": _TO_FILLED
        + "SELECT ORDERNUMBER, CUSTOMERNAME, SALES, QUANTITYORDERED FROM filled ORDER BY SALES DESC, ROW_KEY LIMIT 10",
        "top_customers": _with(_SALES, f"cust AS ({_CUSTOMER.format('sales')})")
        + "SELECT CUSTOMERNAME, CUSTOMER_TOTAL_SALES, CUSTOMER_ORDER_COUNT FROM cust "
        "ORDER BY CUSTOMER_TOTAL_SALES DESC, CUSTOMERNAME LIMIT 10",
        "price_features": _TO_SALES
        + f"SELECT ROW_KEY, {_PROFIT_MARGIN} AS PROFIT_MARGIN, {_PRICE_DISCOUNT} AS PRICE_DISCOUNT, "
        f"{_REVENUE_PER_UNIT} AS REVENUE_PER_UNIT FROM sales",
        "interaction_features": _TO_SALES + "SELECT ROW_KEY, QUANTITYORDERED * PRICEEACH AS QTY_PRICE_INTERACTION FROM sales",
        "status_msrp": _TO_SALES + f"SELECT ROW_KEY, {_STATUS_MSRP} AS STATUS_MSRP_RATIO FROM sales",
        "parse_dates_coerce": _TO_DATED + "SELECT ROW_KEY, ORDERDATE FROM dated",
        "date_format_counts": _TO_SALES + _FORMAT_COUNTS,
        "parse_dates_discovered": _TO_DATED + "SELECT ROW_KEY, ORDERDATE FROM dated",
        "parse_dates_strict": _TO_SALES + "SELECT ROW_KEY, CAST(ORDERDATE AS TIMESTAMP) AS ORDERDATE FROM sales",
        "temporal_features": _TO_SALES
        + f"SELECT ROW_KEY, {_DOW} AS DAY_OF_WEEK, {_DOM} AS DAY_OF_MONTH, {_WEEK} AS WEEK_OF_YEAR FROM sales",
        "date_parts_app": _TO_DATED
        + "SELECT ROW_KEY, CAST(year(ORDERDATE) AS INT) AS YEAR, CAST(month(ORDERDATE) AS INT) AS MONTH, "
        f"{_DOW} AS DAY_OF_WEEK, CAST(quarter(ORDERDATE) AS INT) AS QUARTER FROM dated",
        "features_notebook": _TO_FEATURES + "SELECT * FROM feats",
        "features_app": _with(_SALES, _DATED, _APP)
        + "SELECT * REPLACE ("
        + ", ".join(f"COALESCE(CAST({c} AS DOUBLE), (SELECT median({c}) FROM guarded)) AS {c}" for c in _APP_FILLED)
        + ") FROM guarded",
        "label_encode": _encoded(S.CATEGORICAL_FEATURES),
        "label_encode_all": _encoded(_ENCODE_ALL),
        "encoder_classes": _TO_SALES
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, COUNT(DISTINCT COALESCE({c}, 'nan')) AS n_classes FROM sales"
            for c in S.CATEGORICAL_FEATURES
        ),
        "train_test_split": _TO_SALES + f"SELECT ROW_KEY, {_SPLIT} AS split FROM sales",
        "split_ratio": _TO_SALES
        + f", s AS (SELECT {_SPLIT} AS split FROM sales) SELECT COUNT(*) FILTER (split = 'train') AS n_train, "
        "COUNT(*) FILTER (split = 'test') AS n_test, n_train / n_test AS ratio FROM s",
        "fold_assign": _TO_SALES + f"SELECT ROW_KEY, {_FOLD} AS fold FROM sales",
        "standard_scale": _TO_BASELINES
        + "SELECT ROW_KEY, "
        + ", ".join(
            f"ROUND(({c} - (SELECT AVG({c}) FROM train)) / (SELECT STDDEV_POP({c}) FROM train), 8) AS {c}"
            for c in ("QUANTITYORDERED", "PRICEEACH", "MSRP")
        )
        + " FROM lines",
        "ols_one_feature": _TO_BASELINES
        + "SELECT ROUND(slope, 6) AS slope, ROUND(intercept, 4) AS intercept, (SELECT COUNT(*) FROM train) AS n FROM overall",
        "cv_baselines": _cv(5),
        "metrics_by_split": _TO_BASELINES
        + "SELECT model, split, ROUND(r2, 8) AS r2, ROUND(rmse, 4) AS rmse, ROUND(mae, 4) AS mae, n FROM measured",
        "accuracy_pct": _TO_BASELINES
        + "SELECT model, ROUND(LEAST(100.0, r2 * 100 + 0.5), 6) AS accuracy_pct FROM measured WHERE split = 'test'",
        "comparison_table": _TO_BASELINES
        + "SELECT model, ROUND(train_r2, 4) AS train_r2, ROUND(test_r2, 4) AS test_r2, ROUND(rmse, 4) AS rmse, ROUND(mae, 4) AS mae FROM comparison",
        "best_model": _TO_BASELINES
        + "SELECT model, ROUND(train_r2, 8) AS train_r2, ROUND(test_r2, 8) AS test_r2, ROUND(rmse, 8) AS rmse, ROUND(mae, 8) AS mae "
        "FROM comparison WHERE test_r2 = (SELECT MAX(test_r2) FROM comparison)",
        "model_bars": _TO_BASELINES + "SELECT model, ROUND(test_r2, 8) AS test_r2, ROUND(rmse, 8) AS rmse FROM comparison",
        "residuals": _TO_BASELINES
        + f"SELECT model, ROW_KEY, {_settled('prediction')} AS prediction, {_settled('label - prediction')} AS residual "
        "FROM long WHERE split = 'test'",
        "residual_histogram": _TO_BASELINES
        + ", res AS (SELECT label - prediction AS residual FROM long WHERE split = 'test' AND model = 'product_mean'), "
        + _histogram("res", "residual", 30)
        + " SELECT * FROM hist",
        "actual_vs_predicted": _TO_BASELINES
        + f"SELECT model, split, ROW_KEY, label, {_settled('prediction')} AS prediction FROM long",
        "scenario_estimates": _TO_SALES
        + ", s AS (SELECT ROW_KEY, QUANTITYORDERED, PRICEEACH / 10 AS PRICEEACH, MSRP / 2 AS MSRP, PRODUCTLINE, DEALSIZE "
        "FROM sales) SELECT *, QUANTITYORDERED * PRICEEACH AS ESTIMATE FROM s "
        f"WHERE QUANTITYORDERED BETWEEN {BOUNDS['QUANTITYORDERED'][0]} AND {BOUNDS['QUANTITYORDERED'][1]} "
        f"AND PRICEEACH BETWEEN {BOUNDS['PRICEEACH'][0]} AND {BOUNDS['PRICEEACH'][1]} "
        f"AND MSRP BETWEEN {BOUNDS['MSRP'][0]} AND {BOUNDS['MSRP'][1]}",
        "scenario_grid": _grid(),
    }
