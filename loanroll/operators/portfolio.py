"""Active/inactive split, summaries and per-product lists.

Summaries are ``groupBy`` aggregates with map-side partial aggregation; the
residual summary is the only key-less reduction (partial + one final row).
Sums follow ``sum(na.rm = TRUE)``: NA and NaN are skipped, empty sums are 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanroll.functions.rnum import div_sql, is_na_sql, sum_na_rm_sql
from loanroll.operators.ledger import left_by_loan
from loanroll.operators.valuation import is_active

DEFAULT_MIN_BALANCE = 0.0001


def active_loans(priced: DataFrame) -> DataFrame:
    """Rows with a known daily payoff."""
    return priced.filter(is_active())


def inactive_loans(priced: DataFrame) -> DataFrame:
    """Rows without payoff (no match, or a match whose payoff is NA)."""
    return priced.filter(is_na_sql("valor_pago_ttl_canc"))


def _sum(column: str) -> F.Column:
    return F.expr(sum_na_rm_sql(column))


def _uplift(value: str) -> F.Column:
    return F.expr(f"{div_sql(value, 'Precio_de_compra')} - 1")


def portfolio_summary(active: DataFrame, min_balance: float = DEFAULT_MIN_BALANCE,
                      with_capital: bool = True) -> DataFrame:
    """Per product, count + null-safe sums, then ``p = value/price - 1``.

    ``with_capital=False`` is the older report (no capital-factor column).
    """
    aggs = [
        F.count(F.lit(1)).alias("Creditos"),
        _sum("valor_pago_ttl_canc").alias("Deuda_total"),
        _sum("saldo_actual").alias("Saldo_a_capital"),
        _sum("precio_compra").alias("Precio_de_compra"),
        _sum("Precio_y_valoracion").alias("Valoracion"),
        _sum("Precio_y_valoracion_mod").alias("Valoracion_mod"),
    ]
    if with_capital:
        aggs.append(_sum("Precio_y_valoracion_capital").alias("Valoracion_capital"))
    uplifts = {"p": _uplift("Valoracion"), "p_mod": _uplift("Valoracion_mod")}
    if with_capital:
        uplifts["p_cap"] = _uplift("Valoracion_capital")
    return (
        active.filter(F.col("saldo_actual") > min_balance)
        .groupBy("tipo_producto").agg(*aggs)
        .withColumns(uplifts)
    )


def residual_loans(inactive: DataFrame, min_balance: float = DEFAULT_MIN_BALANCE) -> DataFrame:
    """Inactive loans that still carry a balance."""
    return inactive.filter(F.col("saldo_actual") > min_balance).select(
        "credito", "valor_pago_ttl_canc", "saldo_actual", "precio_compra", "Precio_y_valoracion")


def residual_summary(residual: DataFrame) -> DataFrame:
    """One row always (an empty residual gives 0s and ``p = NaN``)."""
    return residual.agg(
        F.count(F.lit(1)).alias("Creditos"),
        _sum("valor_pago_ttl_canc").alias("Deuda_total"),
        _sum("saldo_actual").alias("Saldo_a_capital"),
        _sum("precio_compra").alias("Precio_de_compra"),
        _sum("Precio_y_valoracion").alias("Valoracion"),
    ).withColumn("p", _uplift("Valoracion"))


def live_product_70(active: DataFrame, keep_all_priced: bool = True, product: int = 70) -> DataFrame:
    """Product-70 list; uplift on the exposure factor, NA/NaN -> 0.

    ``keep_all_priced=False`` is the older report's column set.
    """
    vg = f"({div_sql('Precio_y_valoracion_mod', 'compra')} - 1)"
    cols = ["credito", "saldo_a_capital", "compra"]
    if keep_all_priced:
        cols += ["Precio_y_valoracion", "Precio_y_valoracion_capital"]
    return (
        active.filter(F.col("tipo_producto") == product)
        .withColumnRenamed("saldo_actual", "saldo_a_capital")
        .withColumnRenamed("precio_compra", "compra")
        .withColumn("valoracion_con_garantia", F.expr(f"CASE WHEN {is_na_sql(vg)} THEN 0.0D ELSE {vg} END"))
        .select(*cols, "valoracion_con_garantia")
    )


def live_product_71(rows: DataFrame, product: int = 71) -> DataFrame:
    """Product-71 list with a constant uplift of 0.

    Pass active rows (newest script) or inactive rows (older report, D7).
    """
    return rows.filter(F.col("tipo_producto") == product).select(
        "credito",
        F.col("saldo_actual").alias("saldo_a_capital"),
        F.col("precio_compra").alias("compra"),
        F.lit(0.0).alias("valoracion_con_garantia"),
    )


def ltv_change(extract: DataFrame, ltv: DataFrame, prior_key: int) -> DataFrame:
    """Attach the collateral value and LTV of an earlier snapshot."""
    prior = ltv.filter(F.col("id_fecha") == prior_key).select(
        "credito",
        F.col("valor_garantia_final").alias("garantia_anterior"),
        F.col("LTV").alias("LTV_ant"),
    )
    return left_by_loan(extract, prior)
