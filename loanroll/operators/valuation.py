"""Snapshots (S2-S4), valuation table (M9), price factors (M10) and pricing.

Joins are equi-joins on ``credito``. No join has a broadcast hint, as the
snapshots grow with the book; Spark picks a broadcast where its estimate (or
AQE's measured size) of a side is below ``spark.sql.autoBroadcastJoinThreshold``,
and a sort-merge join else.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanroll.functions.rnum import div_sql, eq_sql, gt_sql, is_na_sql, le_sql, sql
from loanroll.operators.ledger import left_by_loan

# Text labels of the first restructuring mark.
MARK_REFINANCING = "Refinanciacion"
MARK_RESTRUCTURING = "Reestructuracion"


def daily_closing_snapshot(ledger_day: DataFrame, window_keys: Sequence[int],
                           products: Sequence[int] = (70, 71)) -> DataFrame:
    """Daily rows of the closing window with capital > 0 and closing flag 1.

    The keys are bound as an ``IN`` list (never spliced into SQL text); all
    four predicates push down to the scan.
    """
    return ledger_day.filter(
        F.col("tipo_producto").isin(list(products))
        & (F.col("saldo_capital") > 0)
        & F.col("id_fecha").isin(list(window_keys))
        & (F.col("ind_cierre") == 1)
    ).select("saldo_capital", "tipo_producto", "credito", "valor_pago_ttl_canc")


def first_restructuring_mark(marks: DataFrame, case_insensitive: bool = False) -> DataFrame:
    """First non-'S' mark of each loan, as a label.

    The order is that of ``ROW_NUMBER() OVER (PARTITION BY credito ORDER BY
    id_fecha)``: a mark without a date comes first. Marks of one day are
    ordered by ``id_marca`` (none first), equal ones by code ('R' first).

    Two hash aggregates with map-side partial aggregation, so a loan with very
    many marks never lands whole in one task: the first mark of each
    (loan, day), as a number that orders by ``id_marca`` and then by code, and
    the first day of each loan. Ids must be below 2^62 (else an overflow error).
    ``case_insensitive`` compares the codes as a case-insensitive collation
    would (binary is the default).
    """
    code = "upper(marcacion)" if case_insensitive else "marcacion"
    kept = marks.filter(f"{code} <> 'S'")
    key = f"coalesce(id_marca * 2L, -9223372036854775806L) + CASE WHEN {code} = 'R' THEN 0L ELSE 1L END"
    per_day = kept.groupBy("credito", "id_fecha").agg(F.expr(f"min({key}) AS _k"))
    first = per_day.groupBy("credito").agg(F.expr("min_by(_k, coalesce(id_fecha, -2147483647)) AS _k"))
    return first.selectExpr(
        "credito", f"CASE WHEN pmod(_k, 2) = 0 THEN '{MARK_REFINANCING}' ELSE '{MARK_RESTRUCTURING}' END AS marc_desc")


def ltv_snapshot(ltv: DataFrame, marks: DataFrame, snapshot_key: int,
                 product: int | None = None) -> DataFrame:
    """S3 (all products) / S3b (``product`` given): one LTV snapshot + first mark."""
    cond = F.col("id_fecha") == snapshot_key
    if product is not None:
        cond = cond & (F.col("tipo_producto") == product)
    snap = ltv.filter(cond)
    return snap.join(first_restructuring_mark(marks), "credito", "left").select(
        "credito", "id_fecha", "tipo_producto", "conteo_garantias", "LTV", "valor_garantia_final",
        F.coalesce(F.col("libre_inversion_o_vehicular"), F.lit("")).alias("libre_inversion_o_vehicular"),
        F.coalesce(F.col("marc_desc"), F.lit("")).alias("marca_refi_restru"),
    )


LTV_COLUMNS = ["credito", "LTV", "valor_garantia_final", "libre_inversion_o_vehicular",
               "marca_refi_restru"]


def _unmarked(df: DataFrame, _name: str) -> DataFrame:
    return df


def valuation_table(rates: DataFrame, ltv_snap: DataFrame, daily: DataFrame,
                    mark: Callable[[DataFrame, str], DataFrame] = _unmarked) -> DataFrame:
    """M9: rates of each loan + collateral snapshot + daily payoff (left joins).

    ``mark(df, name)`` sees the rows before and after each join (``rates``, ``ltv``, ``daily``).

    ``rates`` is :func:`loanroll.operators.recovery.all_rates`; a loan with no
    product-70 month has no rate row, so its daily row is never attached.
    """
    t = rates.select(
        "credito", "id_fecha_inicial", "id_fecha_actual", "Duracion_p10", "Duracion_p70",
        "tasa_recuperacion_anual_exp", "tasa_recuperacion_anual", "tasa_recuperacion_anual_capital",
    )
    with_ltv = mark(left_by_loan(mark(t, "rates"), ltv_snap.select(*LTV_COLUMNS)), "ltv")
    return mark(left_by_loan(with_ltv, daily), "daily")


def price_factor_inverse_sql(rate: str, ltv: str, months: str) -> str:
    """``r>0 & LTV<=0.8 -> (1+r)(1+(1/LTV)(1/d))``; ``r=0 & LTV<=0.6 ->
    1+0.6/LTV``; else ``1+r``. Unknown conditions fall to the next arm."""
    r = sql(rate)
    return (f"(CASE WHEN {gt_sql(rate, 0)} AND {le_sql(ltv, 0.8)} "
            f"THEN (1 + {r}) * (1 + {div_sql(1.0, ltv)} * {div_sql(1.0, months)}) "
            f"WHEN {eq_sql(rate, 0)} AND {le_sql(ltv, 0.6)} THEN 1 + 0.6D * {div_sql(1.0, ltv)} "
            f"ELSE 1 + {r} END)")


def price_factor_direct_sql(rate: str, ltv: str, months: str) -> str:
    """M10c (older script): ``r>0 & LTV>1 -> (1+r)(1+LTV/d)``; ``r=0 & LTV>1 ->
    1+0.75 LTV``; else ``1+r``."""
    r = sql(rate)
    return (f"(CASE WHEN {gt_sql(rate, 0)} AND {gt_sql(ltv, 1)} THEN (1 + {r}) * (1 + {div_sql(ltv, months)}) "
            f"WHEN {eq_sql(rate, 0)} AND {gt_sql(ltv, 1)} THEN 1 + 0.75D * {sql(ltv)} "
            f"ELSE 1 + {r} END)")


def price_factor_inverse(rate: str, ltv: str, months: str) -> Column:
    return F.expr(price_factor_inverse_sql(rate, ltv, months))


def price_factor_direct(rate: str, ltv: str, months: str) -> Column:
    return F.expr(price_factor_direct_sql(rate, ltv, months))


def with_price_factors(valuation: DataFrame, months: str = "Duracion_p70") -> DataFrame:
    """M10 on the combined, exposure and capital rates."""
    return valuation.withColumns({
        "Valoracion_pd": price_factor_inverse("tasa_recuperacion_anual", "LTV", months),
        "Valoracion_pd_mod": price_factor_inverse("tasa_recuperacion_anual_exp", "LTV", months),
        "Valoracion_pd_cap": price_factor_inverse("tasa_recuperacion_anual_capital", "LTV", months),
    })


def purchase_tape(raw_tape: DataFrame) -> DataFrame:
    """Tape rows that carry a loan id."""
    return raw_tape.filter(F.col("credito").isNotNull())


def priced_portfolio(tape: DataFrame, valued: DataFrame) -> DataFrame:
    """M11 (newest script): whole tape left-joined to the valuation, price x factor."""
    return (
        tape.join(valued, "credito", "left")
        .withColumnRenamed("suma_importe_base", "saldo_actual")
        .withColumns({
            "Precio_y_valoracion": F.expr("precio_compra * Valoracion_pd"),
            "Precio_y_valoracion_mod": F.expr("precio_compra * Valoracion_pd_mod"),
            "Precio_y_valoracion_capital": F.expr("precio_compra * Valoracion_pd_cap"),
        })
    )


def with_balance(tape: DataFrame, min_balance: float) -> DataFrame:
    """Tape rows above the least balance."""
    return tape.filter(F.col("suma_importe_base") > min_balance)


def priced_portfolio_v1(tape: DataFrame, extract: DataFrame, min_balance: float = 0.0001) -> DataFrame:
    """M11 (older report): balance filter first, then join to the hand-off extract."""
    return (
        with_balance(tape, min_balance)
        .join(extract, "credito", "left")
        .withColumnRenamed("suma_importe_base", "saldo_actual")
        .withColumns({
            "Precio_y_valoracion": F.expr("precio_compra * Valoracion_pd"),
            "Precio_y_valoracion_mod": F.expr("precio_compra * Valoracion_pd_mod"),
        })
    )


def is_active() -> Column:
    """A loan is active when the daily payoff is known."""
    return F.expr(f"NOT {is_na_sql('valor_pago_ttl_canc')}")
