import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import quality
from ledgerlens.schema import COLUMNS, TRANSACTION
from ledgerlens.sources import synthetic, transactions as sources


def test_bad_csv_cells_become_null(spark, tmp_path):
    head = ",".join(COLUMNS)
    (tmp_path / "a.csv").write_text(f"{head}\n1,CASH-OUT,12.5,C1,1,2,M1,3,4,0,0\nx,PAYMENT,abc,C2,NaN,2,M2,3,4,1,0\n")
    rows = sources.read_csv(spark, str(tmp_path / "a.csv")).orderBy("nameOrig").collect()
    assert rows[0].type == "CASH_OUT" and rows[0].amount == 12.5 and rows[0].step == 1
    assert rows[1].step is None and rows[1].amount is None and rows[1].oldbalanceOrg is None


def test_columns_are_matched_by_name(spark, tmp_path):
    (tmp_path / "b.csv").write_text("amount,step,extra\n5.5,7,hello\n")
    df = sources.read_csv(spark, str(tmp_path / "b.csv"))
    r = df.first()
    assert (r.amount, r.step, r.extra) == (5.5, 7, "hello")
    assert set(quality.missing_columns(df)) == set(COLUMNS) - {"amount", "step"}


def test_whole_numbers_may_have_a_point(spark, tmp_path):
    (tmp_path / "c.csv").write_text("step,amount,isFraud\n1.0,2,1e0\n1.5,Infinity,-0.0\n1e30,NaN,x\n")
    rows = sources.read_csv(spark, str(tmp_path / "c.csv")).collect()
    assert [(r.step, r.amount, r.isFraud) for r in rows] == [(1, 2.0, 1), (None, None, 0), (None, None, None)]


def test_files_of_another_column_order_fail(spark, tmp_path):
    (tmp_path / "1.csv").write_text("oldbalanceOrg,newbalanceOrig\n1,2\n")
    (tmp_path / "2.csv").write_text("newbalanceOrig,oldbalanceOrg\n2,1\n")
    with pytest.raises(Exception, match="header"):
        sources.read_csv(spark, str(tmp_path)).collect()


def test_generator(spark):
    df = synthetic.generate(spark, 20000, 0.1)
    r = df.agg(F.avg("isFraud").alias("rate"), F.min("step").alias("lo"), F.max("step").alias("hi"),
               F.avg((F.col("type") == "PAYMENT").cast("int")).alias("pay"), F.count_if((F.col("isFlaggedFraud") == 1) & (F.col("isFraud") == 0)).alias("odd")).first()
    assert math.isclose(r.rate, 0.1, abs_tol=0.02) and 1 <= r.lo and r.hi <= 744 and math.isclose(r.pay, 0.45, abs_tol=0.02) and r.odd == 0
    assert df.schema.fieldNames() == TRANSACTION.fieldNames()
    cash_in = df.filter("type = 'CASH_IN' and abs(newbalanceOrig - oldbalanceOrg - amount) > 0.01")
    assert cash_in.count() == 0


def test_edge_cases_are_reported(spark):
    got = {(r.issue, r.column): r.rows for r in quality.quality_issues(synthetic.edge_cases(spark)).collect()}
    assert got[("balance_mismatch", "newbalanceOrig")] == 1


def test_history_pruning(spark, tmp_path):
    df = spark.range(72).select("id", F.timestamp_seconds(F.col("id") * 3600).alias("ts"))
    sources.append_table(df, str(tmp_path / "h"))
    sources.append_table(df, str(tmp_path / "h"))
    back = sources.read_table(spark, str(tmp_path / "h"), since="1970-01-03")
    assert back.count() == 48
    assert "PartitionFilters: [isnotnull(day" in back._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
