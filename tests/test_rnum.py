
import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanroll.functions.rnum import div_sql, eq_sql, ge_sql, gt_sql, ifelse_sql, is_na_sql, is_nan_sql, le_sql, lt_sql, sum_na_rm_sql

NAN, INF = float("nan"), float("inf")


def _same(a, b):
    if a is None or b is None:
        return a is None and b is None
    if math.isnan(a) or math.isnan(b):
        return math.isnan(a) and math.isnan(b)
    return a == b


def test_div_all_cases(spark):
    cases = [(1.0, 0.0, INF), (-1.0, 0.0, -INF), (0.0, 0.0, NAN), (NAN, 0.0, NAN),
             (None, 0.0, None), (1.0, None, None), (6.0, 3.0, 2.0), (NAN, 2.0, NAN)]
    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())])
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], schema)
    got = [r[0] for r in df.select(F.expr(div_sql("a", "b"))).collect()]
    for (a, b, want), g in zip(cases, got, strict=True):
        assert _same(g, want), (a, b, want, g)


def test_ifelse_na_condition_gives_na(spark):
    df = spark.createDataFrame([(None,), (True,), (False,)], "c boolean")
    assert [r[0] for r in df.select(F.expr(ifelse_sql("c", 1.0, 2.0))).collect()] == [None, 1.0, 2.0]


def test_nan_comparisons_are_unknown(spark):
    df = spark.createDataFrame([(NAN,), (1.0,)], "x double")
    got = [tuple(r) for r in df.select(*(F.expr(f("x", 1.0)) for f in (gt_sql, ge_sql, lt_sql, le_sql, eq_sql))).collect()]
    assert got == [(None,) * 5, (False, True, False, True, True)]


def test_is_na_and_is_nan(spark):
    df = spark.createDataFrame([(NAN,), (None,), (1.0,)], "x double")
    got = [tuple(r) for r in df.select(F.expr(is_na_sql("x")), F.expr(is_nan_sql("x"))).collect()]
    assert got == [(True, True), (True, False), (False, False)]


def test_sum_na_rm(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (None,)], "x double")
    assert df.agg(F.expr(sum_na_rm_sql("x"))).first()[0] == 1.0
    assert df.filter("x > 10").agg(F.expr(sum_na_rm_sql("x"))).first()[0] == 0.0
