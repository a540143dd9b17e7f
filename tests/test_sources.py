import pytest
from pyspark.sql import functions as F

from linewise.session import materialize, materialize_measured, scratch_path
from linewise.sources import orders_csv, synthetic


@pytest.fixture
def orders_file(tmp_path):
    path = tmp_path / "orders.csv"
    text = (
        " Ordernumber ,customername,POSTALCODE,SALES\n"
        '1,"Café ""Noir"", Nîmes",30000,10.5\n'
        "2,NA,,20\n"
        "3,Nantes,nan,n/a\n"
    )
    path.write_bytes(text.encode("latin-1"))
    return str(path)


def test_latin1_header_and_missing_tokens(spark, orders_file):
    df = orders_csv.read_orders_csv(spark, orders_file)
    assert df.columns == ["ORDERNUMBER", "CUSTOMERNAME", "POSTALCODE", "SALES"]
    assert dict(df.dtypes)["ORDERNUMBER"] == "bigint" and dict(df.dtypes)["SALES"] == "double"
    assert [tuple(r) for r in df.orderBy("ORDERNUMBER").collect()] == [
        (1, 'Café "Noir", Nîmes', "30000", 10.5), (2, None, None, 20.0), (3, "Nantes", None, None)]
    kept = orders_csv.read_orders_csv(spark, orders_file, types={}, tidy_header=False)
    assert kept.columns[:2] == [" Ordernumber ", "customername"]


def test_bad_cells_fail_or_are_split_off(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("SALES,ORDERNUMBER,YEAR_ID\n1.5,7,2003\noops,8,2004\n2.5,x,later\n3.0,9.0,\n")
    with pytest.raises(Exception):
        orders_csv.read_orders_csv(spark, str(path)).collect()
    good, bad = orders_csv.split_rejects(orders_csv.read_orders_csv(spark, str(path), mode="keep"))
    assert sorted(tuple(r) for r in good.select("SALES", "ORDERNUMBER").collect()) == [(1.5, 7), (3.0, 9)]
    assert sorted(r[orders_csv.REJECT_REASON] for r in bad.collect()) == [["ORDERNUMBER", "YEAR_ID"], ["SALES"]]
    with pytest.raises(ValueError):
        orders_csv.read_orders_csv(spark, str(path), mode="lenient")


def test_guarded_load_reports(spark, tmp_path, orders_file):
    said = []
    assert orders_csv.load_or_none(spark, str(tmp_path / "absent.csv"), report=said.append) is None
    assert len(said) == 1 and "absent.csv" in said[0]
    assert orders_csv.load_or_none(spark, orders_file).count() == 3


def kinds(spark, tmp_path, cells):
    path = tmp_path / f"kinds{len(list(tmp_path.iterdir()))}.csv"
    path.write_text("X,Y\n" + "".join(f"{c},1\n" for c in cells))
    df = orders_csv.read_orders_csv(spark, str(path), types={}, infer=True)
    return dict(df.dtypes)["X"], [r["X"] for r in df.collect()]


@pytest.mark.parametrize("cells, kind, values", [
    (["1", "-2", "+3", " 4 "], "bigint", [1, -2, 3, 4]),
    (["007", "9223372036854775807"], "bigint", [7, 2**63 - 1]),
    (["1", "9223372036854775808"], "double", [1.0, 2.0**63]),  # beyond 64 bits
    (["1", "", "NA"], "double", [1.0, None, None]),
    (["1", "2.5", "1e3", ".5", "-5.", "inf"], "double", [1.0, 2.5, 1000.0, 0.5, -5.0, float("inf")]),
    (["nan", "", "NULL"], "double", [None, None, None]),
    (["1", "2d"], "string", ["1", "2d"]),  # not a number, though some parsers take it
    (["1", "two"], "string", ["1", "two"]),
    (["True", "false"], "boolean", [True, False]),
    (["True", ""], "string", ["True", None]),
    (["True", "1"], "string", ["True", "1"]),
    ([], "double", []),
])
def test_kinds_are_inferred(spark, tmp_path, cells, kind, values):
    assert kinds(spark, tmp_path, cells) == (kind, values)


def test_known_types_go_before_inferred_ones(spark, tmp_path):
    path = tmp_path / "both.csv"
    path.write_text("ORDERNUMBER,EXTRA,NOTE\n1,2,x\n2,3,\n")
    assert dict(orders_csv.read_orders_csv(spark, str(path), infer=True).dtypes) == {"ORDERNUMBER": "bigint", "EXTRA": "bigint", "NOTE": "string"}
    # a record that doesn't fit the header says nothing about a column
    path.write_text("ORDERNUMBER,EXTRA,NOTE\n1,2,x\n2,word\n3,4,y\n")
    kept = orders_csv.read_orders_csv(spark, str(path), mode="keep", infer=True)
    assert dict(kept.dtypes)["EXTRA"] == "bigint"
    good, bad = orders_csv.split_rejects(kept)
    assert sorted(r["EXTRA"] for r in good.collect()) == [2, 4] and bad.count() == 1


def test_guarded_load_of_the_whole_file(spark, tmp_path, orders_file):
    said = []
    load = orders_csv.load_guarded(spark, orders_file, report=said.append)
    assert load.rows.count() == load.n_rows == 3 and load.error is None and load.report == "3 rows" and not said
    assert orders_csv.REJECT_REASON not in load.rows.columns and orders_file not in str(load.rows.inputFiles())
    path = tmp_path / "bad.csv"
    path.write_text("SALES,ORDERNUMBER,YEAR_ID\n1.5,7,2003\noops,8,2004\n2.5,x,later\n3.0,9.0\n4,1,2004,5\n")
    load = orders_csv.load_guarded(spark, str(path), report=said.append)
    assert load.rows is None and (load.n_rows, load.n_bad_shape) == (5, 2)
    assert load.bad_cells == {"ORDERNUMBER": 1, "SALES": 1, "YEAR_ID": 1}
    assert "bad.csv" in said[0] and "1 bad cells in SALES" in said[0] and "2 records" in said[0]
    load = orders_csv.load_guarded(spark, str(tmp_path / "absent.csv"), report=said.append)
    assert load.rows is None and load.error and "absent.csv" in said[1]


def test_guarded_load_of_an_empty_file(spark, tmp_path):
    path = tmp_path / "empty.csv"
    path.write_text("SALES,ORDERNUMBER\n")
    load = orders_csv.load_guarded(spark, str(path), infer=True)
    assert load.rows.count() == load.n_rows == 0 and load.rows.columns == ["SALES", "ORDERNUMBER"]


def test_files_with_unlike_headers_are_not_loaded(spark, tmp_path):
    (tmp_path / "a.csv").write_text("SALES,ORDERNUMBER\n1,2\n")
    (tmp_path / "b.csv").write_text("ORDERNUMBER,SALES\n2,1\n")
    said = []
    assert orders_csv.load_guarded(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"], report=said.append).rows is None and said


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = tmp_path / "breaks.csv"
    path.write_text('ORDERNUMBER,CUSTOMERNAME\n1,"two\nlines"\n2,b\n')
    assert [tuple(r) for r in orders_csv.read_orders_csv(spark, str(path)).collect()] == [(1, "two\nlines"), (2, "b")]


def test_no_cell_is_lost_silently(spark, tmp_path):
    for name, bad in (("surplus", "2,b,20,99"), ("short", "3,d")):
        path = tmp_path / f"{name}.csv"
        path.write_text(f"ORDERNUMBER,CUSTOMERNAME,SALES\n1,a,10\n{bad}\n4,e,40\n")
        for columns in (["*"], ["SALES"], ["ORDERNUMBER"]):
            for multi_line in (True, False):
                with pytest.raises(Exception):
                    orders_csv.read_orders_csv(spark, str(path), multi_line=multi_line).select(*columns).collect()
                kept = orders_csv.read_orders_csv(spark, str(path), mode="keep", multi_line=multi_line)
                good, rejected = orders_csv.split_rejects(kept)
                assert good.select(*columns).count() == 2
                assert [(r[orders_csv.RAW_RECORD].strip(), r[orders_csv.REJECT_REASON]) for r in rejected.collect()] == [(bad, [orders_csv.BAD_SHAPE])]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_predictions_are_written_in_full(spark, tmp_path, fmt):
    long = spark.range(50).select((F.col("id") / 3).alias("label"), (F.col("id") / 7).alias("prediction"))
    path = str(tmp_path / fmt)
    orders_csv.write_predictions(long, path, fmt)
    reader = spark.read.schema("Actual_Sales double, Predicted_Sales double").option("header", True)
    back = reader.format(fmt).load(path)
    assert back.exceptAll(long.toDF("Actual_Sales", "Predicted_Sales")).isEmpty() and back.count() == 50


def test_synthetic_orders(spark):
    df = synthetic.synthetic_orders(spark)
    again = synthetic.synthetic_from(spark.range(2000).repartition(5), "id", 2000).drop("id")
    assert df.count() == 2000 and df.exceptAll(again).isEmpty()
    pdf = df.toPandas()
    assert pdf.QUANTITYORDERED.between(20, 99).all() and pdf.PRICEEACH.between(50, 200).all()
    assert pdf.MSRP.between(60, 250).all()
    noise = pdf.SALES / (pdf.QUANTITYORDERED * pdf.PRICEEACH)
    assert noise.between(0.9, 1.1).all() and noise.std() > 0.05
    assert set(pdf.STATUS) == set(synthetic.STATUSES) and abs((pdf.STATUS == "Shipped").mean() - 0.8) < 0.04
    assert set(pdf.PRODUCTLINE) == set(synthetic.PRODUCT_LINES) and set(pdf.COUNTRY) == set(synthetic.COUNTRIES)
    assert pdf.CUSTOMERNAME.nunique() == 99
    dates = pdf.ORDERDATE.astype(str)
    assert dates.min() >= "2023-01-01" and dates.max() <= "2028-06-22"


def test_materialized_table_is_read_back_pruned(spark):
    df = spark.range(100).select("id", (F.col("id") * 2).alias("twice"))
    table, seen = materialize_measured(df, "t", top=F.max("id"), any_null=F.bool_or(F.col("id").isNull()))
    assert seen == {"top": 99, "any_null": False}
    assert table.schema == df.schema or table.columns == df.columns
    assert table.agg(F.sum("twice")).first()[0] == 9900
    assert materialize(df, "t").count() == 100
    folder = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(folder) and scratch_path(spark, "x") != scratch_path(spark, "x")
