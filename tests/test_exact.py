"""Sums whose digits don't depend on the order of the rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loanroll.functions.rnum import exact_parts, exact_value_sql, sum_na_rm_sql
from loanroll.operators import portfolio as P
from loanroll.operators import rolling as RM

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def amounts():
    rng = random.Random(5)
    return [rng.choice([1, -1]) * rng.random() * 10 ** rng.randint(-6, 14) for _ in range(4000)] + [1e15, -1e15, 0.1, None]


def test_the_sum_is_that_of_the_rounded_values(spark, amounts):
    df = spark.createDataFrame([(x,) for x in amounts], "x double")
    exact = math.fsum(math.floor((x - math.floor(x)) * 1e8 + 0.5) for x in amounts if x is not None) / 1e8 + sum(math.floor(x) for x in amounts if x is not None)
    got = df.agg(F.expr(sum_na_rm_sql("x"))).first()[0]
    assert got == pytest.approx(exact, rel=1e-15)


def test_the_same_digits_with_any_partitions(spark, amounts):
    rows = [(70 + i % 2, 20200131 + 100 * (i % 3), x, i % 391) for i, x in enumerate(amounts)]
    seen = set()
    for n in (1, 7, 200):
        random.Random(n).shuffle(rows)
        df = spark.createDataFrame(rows, "tipo_producto int, id_fecha int, saldo_capital double, numero_dias_mora int").repartition(n)
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            active = df.select("tipo_producto", *(F.col("saldo_capital").alias(c) for c in (
                "valor_pago_ttl_canc", "precio_compra", "Precio_y_valoracion", "Precio_y_valoracion_mod", "Precio_y_valoracion_capital")),
                F.abs("saldo_capital").alias("saldo_actual"))
            out = [P.portfolio_summary(active), P.residual_summary(active), RM.bucket_share_history(df.filter("saldo_capital IS NOT NULL"))]
            seen.add(tuple(str(sorted(map(tuple, t.collect()), key=str)) for t in out))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(seen) == 1


@pytest.mark.parametrize("values,na_rm,strict", [
    ([], 0.0, 0.0), ([None, NAN], 0.0, NAN), ([1.5, NAN], 1.5, NAN), ([INF, 1.0], INF, INF), ([-INF, 1.0, None], -INF, -INF),
    ([INF, -INF], NAN, NAN), ([0.1, 0.2, -0.3], 0.0, 0.0), ([-0.25, -0.5], -0.75, -0.75)])
def test_special_values(spark, values, na_rm, strict):
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = df.agg(F.expr(sum_na_rm_sql("x")), F.expr(exact_value_sql(exact_parts("x"), na_rm=False))).first()
    for a, b in zip(got, (na_rm, strict), strict=True):
        assert math.isnan(a) if math.isnan(b) else a == b


def test_sums_beyond_64_bits_raise(spark):
    df = spark.createDataFrame([(9e18,)] * 3, "x double")
    with pytest.raises(Exception, match="OVERFLOW"):
        df.agg(F.expr(sum_na_rm_sql("x"))).collect()
