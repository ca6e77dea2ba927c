"""Annualised recovery rates (M5-M8) on the adjusted per-loan base.

All rates are row-wise projections of one row per loan: no shuffle. The
annualisation is ``prop / (months + 1) * 12``; ``months >= 1`` so that
division never sees zero, the proportion divisions can (R rules apply).
Expressions are built as Spark SQL text (see ``functions.rnum``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanroll.functions.rnum import div_sql, eq_sql, gt_sql, ifelse_sql, is_nan_sql, lt_sql

RATE_BASE_COLUMNS = [
    "credito", "id_fecha_inicial", "id_fecha_actual", "Duracion_p70", "Duracion_p10",
    "saldo_capital_inicial", "saldo_capital_actual", "Saldo_exposicion_inicial",
    "Saldo_exposicion_actual", "saldo_mora_inicial", "saldo_mora_actual",
]


def annualise_sql(prop: str, months: str = "Duracion_p70") -> str:
    return f"({prop}) / ({months} + 1) * 12"


def floored_proportion_sql(start: str, end: str) -> str:
    """``ifelse(start - end < 0, 0, (start - end) / start)``."""
    diff = f"{start} - {end}"
    return ifelse_sql(lt_sql(diff, 0), 0.0, div_sql(diff, start))


def combined_rate_sql(mora: str, cap: str) -> str:
    """M8: arrears NaN -> capital; capital NaN -> arrears; both 0 -> 0; else larger.

    Not ``greatest``: Spark's skips nulls and ranks NaN highest, while the
    script propagates NA through every nested ``ifelse``.
    """
    larger = ifelse_sql(gt_sql(mora, cap), mora, cap)
    both_zero = ifelse_sql(f"{eq_sql(mora, 0)} AND {eq_sql(cap, 0)}", 0.0, larger)
    return ifelse_sql(is_nan_sql(mora), cap, ifelse_sql(is_nan_sql(cap), mora, both_zero))


def with_exposure_rate(base: DataFrame, rate_name: str = "tasa_recuperacion_anual") -> DataFrame:
    """M5: ``prop = (E0 - E1) / E0`` without floor, annualised."""
    prop = div_sql("Saldo_exposicion_inicial - Saldo_exposicion_actual", "Saldo_exposicion_inicial")
    return (
        base.withColumn("prop_recuperado_exposicion", F.expr(prop))
        .withColumn(rate_name, F.expr(annualise_sql("prop_recuperado_exposicion")))
    )


def with_arrears_and_capital_rates(base: DataFrame) -> DataFrame:
    """M6 + M7: floored proportions on arrears and on capital."""
    mora = floored_proportion_sql("saldo_mora_inicial", "saldo_mora_actual")
    cap = floored_proportion_sql("saldo_capital_inicial", "saldo_capital_actual")
    return base.withColumns({
        "prop_recuperado_mora": F.expr(mora),
        "prop_recuperado_capital": F.expr(cap),
    }).withColumns({
        "tasa_recuperacion_anual_mora": F.expr(annualise_sql("prop_recuperado_mora")),
        "tasa_recuperacion_anual_capital": F.expr(annualise_sql("prop_recuperado_capital")),
    })


def with_combined_rate(rates: DataFrame) -> DataFrame:
    return rates.withColumn("tasa_recuperacion_anual", F.expr(
        combined_rate_sql("tasa_recuperacion_anual_mora", "tasa_recuperacion_anual_capital")))


def exposure_rates(adjusted: DataFrame) -> DataFrame:
    """``DF_SALDOS``: base columns + exposure proportion and rate."""
    return with_exposure_rate(adjusted.select(*RATE_BASE_COLUMNS))


def arrears_capital_rates(adjusted: DataFrame) -> DataFrame:
    """``DF_SALDOS2``: base columns + arrears, capital and combined rates."""
    return with_combined_rate(with_arrears_and_capital_rates(adjusted.select(*RATE_BASE_COLUMNS)))


def all_rates(adjusted: DataFrame) -> DataFrame:
    """Both rate tables side by side on the same rows (no self-join needed:
    they come from the same one-row-per-loan base)."""
    t = with_exposure_rate(adjusted.select(*RATE_BASE_COLUMNS), "tasa_recuperacion_anual_exp")
    return with_combined_rate(with_arrears_and_capital_rates(t))


def capital_rate_v1(adjusted_v1: DataFrame) -> DataFrame:
    """Older script: floored capital proportion, ``tasa_recuperacion_anual``."""
    prop = floored_proportion_sql("Saldo_capital_inicial", "Saldo_capital_final")
    return (
        adjusted_v1.withColumn("prop_recuperado", F.expr(prop))
        .withColumn("tasa_recuperacion_anual", F.expr(annualise_sql("prop_recuperado")))
    )
