"""The per-loan profile month by month: a mergeable state instead of the whole ledger.

A loan's state holds what the profile needs of the rows seen so far: counts,
least and greatest dates, the first and last product observation, the last
observation under another product, the first row of the latest month and the
row before it, and the very last row. Two states merge if all of the second
one's dated rows are later than the first one's: numbers continue after the
first one's rows, firsts come from the first state that has one, lasts from the
last. So a month costs its own rows and one join per loan; the ledger's other
months are not read.

Rows without a date come before all dated ones (as ``orden`` counts them), so a
loan may have them in its first state only. A batch that breaks the order for
any loan fails while it is merged.

States are stored one folder a month (``hasta=yyyymm``), so that a month can be
run again, and an older one be gone back to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from loanroll.operators import ledger as L
from loanroll.sources.layout import in_period

_OBSERVED = L.OBSERVED_COLUMNS


def loan_state(rows: DataFrame, product: int = L.PRODUCT, tie_break: Sequence[str] = (), max_loan_rows: int | None = None) -> DataFrame:
    """One row per loan: the state of these rows (one scan, one exchange by loan unless they are stored by loan)."""
    columns = dict.fromkeys([*L.PROFILE_COLUMNS, *tie_break])
    seq = L.with_sequence(rows.select(*columns), tie_break, max_loan_rows=max_loan_rows, last_date=True)
    is_p, other = f"tipo_producto = {product}", f"tipo_producto <> {product}"
    first_key = f"CAST(id_fecha AS BIGINT) * {L._ORDEN_SPAN} + orden"
    last_key = f"CAST(id_fecha AS BIGINT) * {L._ORDEN_SPAN} - orden"
    k_first, k_last, k_prior = (f"CASE WHEN {c} THEN {k} END" for c, k in ((is_p, first_key), (is_p, last_key), (other, last_key)))
    k_before = "CASE WHEN _ultima IS NOT NULL AND (id_fecha IS NULL OR id_fecha < _ultima) THEN orden END"
    aggs = {
        "n_rows": "count(*)", "n_undated": "count(CASE WHEN id_fecha IS NULL THEN 1 END)",
        "first_date": "min(id_fecha)", "last_date": "max(id_fecha)",
        "p_rows": f"count(CASE WHEN {is_p} THEN 1 END)",
        "p_undated": f"count(CASE WHEN {is_p} AND id_fecha IS NULL THEN 1 END)",
        "p_no_disbursement": f"count(CASE WHEN {is_p} AND id_fecha_desembolso IS NULL THEN 1 END)",
        "disbursement_min": f"min(CASE WHEN {is_p} THEN id_fecha_desembolso END)",
        "disbursement_sum": f"sum(CASE WHEN {is_p} THEN CAST(id_fecha_desembolso AS BIGINT) END)",
        "p_first_date": f"min(CASE WHEN {is_p} THEN id_fecha END)", "p_last_date": f"max(CASE WHEN {is_p} THEN id_fecha END)",
        "p_first_orden": f"min(CASE WHEN {is_p} THEN orden END)",
        "n_prior": f"count({k_prior})", "prior_exposure": f"max_by({L.exposure_sql()}, {k_prior})",
        "prior_capital": f"max_by(saldo_capital, {k_prior})",
        "last_capital": f"max_by(saldo_capital, {last_key})", "last_type": f"max_by(tipo_producto, {last_key})",
        "n_before": f"count({k_before})", "before_capital": f"max_by(saldo_capital, {k_before})", "before_type": f"max_by(tipo_producto, {k_before})",
        "tail_capital": "max_by(saldo_capital, orden)", "tail_type": "max_by(tipo_producto, orden)",
    }
    aggs |= {f"{c}_first": f"min_by({c}, {k_first})" for c in _OBSERVED} | {f"{c}_last": f"max_by({c}, {k_last})" for c in _OBSERVED}
    return seq.groupBy("credito").agg(*(F.expr(a).alias(name) for name, a in aggs.items()))


def merge(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """The state of both batches' rows."""
    names = [c for c in earlier.columns if c != "credito"]
    a = earlier.select(F.col("credito").alias("_a"), F.lit(True).alias("a_in"), *(F.col(c).alias(f"a_{c}") for c in names))
    b = later.select(F.col("credito").alias("_b"), F.lit(True).alias("b_in"), *(F.col(c).alias(f"b_{c}") for c in names))
    both = a.join(b, a["_a"].eqNullSafe(b["_b"]) & F.col("a_in") & F.col("b_in"), "full_outer")
    total = [c for c in names if c.startswith("n_") or c in ("p_rows", "p_undated", "p_no_disbursement")]
    made = {c: f"coalesce(a_{c}, 0) + coalesce(b_{c}, 0)" for c in total}
    made |= {c: f"least(a_{c}, b_{c})" for c in ("first_date", "p_first_date", "disbursement_min")}
    made |= {c: f"greatest(a_{c}, b_{c})" for c in ("last_date", "p_last_date")}
    made["disbursement_sum"] = "CASE WHEN a_disbursement_sum IS NULL THEN b_disbursement_sum ELSE a_disbursement_sum + coalesce(b_disbursement_sum, 0) END"
    made["p_first_orden"] = "coalesce(a_p_first_orden, coalesce(a_n_rows, 0) + b_p_first_orden)"

    def chosen(condition: str, first: str, second: str, columns: Sequence[str], second_columns: Sequence[str] = ()) -> None:
        for c, d in zip(columns, second_columns or columns, strict=True):
            made[c] = f"CASE WHEN {condition} THEN {first}{c} ELSE {second}{d} END"

    chosen("a_p_first_date IS NOT NULL", "a_", "b_", [f"{c}_first" for c in _OBSERVED])
    chosen("b_p_last_date IS NOT NULL", "b_", "a_", [f"{c}_last" for c in _OBSERVED])
    chosen("b_n_prior > 0", "b_", "a_", ["prior_exposure", "prior_capital"])
    chosen("b_last_date IS NOT NULL", "b_", "a_", ["last_capital", "last_type"])
    chosen("b_in", "b_", "a_", ["tail_capital", "tail_type"])
    # the row before the latest month: of the later batch, else the earlier one's very last row
    for c in ("capital", "type"):
        made[f"before_{c}"] = (f"CASE WHEN b_last_date IS NULL THEN a_before_{c} WHEN b_n_before > 0 OR a_in IS NULL THEN b_before_{c} "
                               f"ELSE a_tail_{c} END")
    made["n_before"] = "CASE WHEN b_last_date IS NULL THEN coalesce(a_n_before, 0) ELSE coalesce(a_n_rows, 0) + b_n_before END"
    late = "a_in AND b_in AND (b_n_undated > 0 OR b_first_date <= a_last_date)"
    message = "concat('rows of loan ', coalesce(CAST(_b AS STRING), 'NA'), ' are not later than those of the state: start it anew')"
    kinds = {f.name: f.dataType for f in earlier.schema}
    checked = both.withColumn("credito", F.expr(f"CASE WHEN {late} THEN CAST(raise_error({message}) AS BIGINT) WHEN a_in THEN _a ELSE _b END"))
    return checked.select(F.col("credito").cast(kinds["credito"]).alias("credito"),
                          *(F.expr(made[c]).cast(kinds[c]).alias(c) for c in names))


def profile(state: DataFrame, strict_na: bool = True) -> DataFrame:
    """:func:`loanroll.operators.ledger.loan_profile` of all rows that the state has seen."""
    known = "p_rows - p_no_disbursement"
    least, mean = "CAST(disbursement_min AS DOUBLE)", f"CASE WHEN {known} > 0 THEN CAST(disbursement_sum AS DOUBLE) / ({known}) END"
    begin, end = "p_first_date", "p_last_date"
    if strict_na:
        least, mean = (f"CASE WHEN p_no_disbursement > 0 THEN NULL ELSE {x} END" for x in (least, mean))
        begin, end = (f"CASE WHEN p_undated > 0 THEN NULL ELSE {x} END" for x in (begin, end))
    out = state.filter("p_rows > 0").selectExpr(
        "credito", f"{least} AS Fecha_desembolso", f"{mean} AS Fecha_desembolso_media", f"{begin} AS fecha_inicio_p70",
        f"{end} AS fecha_vigencia", "p_rows AS Duracion_p70", "p_first_orden AS Duracion_p10",
        *(f"{c}_first AS {c}_inicial" for c in _OBSERVED), *(f"{c}_last AS {c}_actual" for c in _OBSERVED),
        "prior_exposure AS capital_ant", "prior_capital AS saldo_ant", "n_prior",
        "last_capital AS _ultimo_capital", "last_type AS _ultimo_tipo", "before_capital AS _previo_capital", "before_type AS _previo_tipo")
    return out.withColumns({"Saldo_exposicion_inicial": L.exposure("_inicial"), "Saldo_exposicion_actual": L.exposure("_actual")})


def stored_state(spark: SparkSession, folder: str, until: int | None = None) -> tuple[DataFrame, int] | None:
    """The state of the latest stored month (at most ``until``, ``yyyymm``) with that month; none if there is none."""
    try:
        known = spark.read.parquet(folder)
    except AnalysisException:  # nothing is stored there
        return None
    if "hasta" not in known.columns:
        return None
    months = known.select("hasta") if until is None else known.filter(F.col("hasta") <= until).select("hasta")
    last = months.agg(F.max("hasta")).first()[0]  # from the folders' names
    return None if last is None else (known.filter(F.col("hasta") == last).drop("hasta"), last)


def months_between(first: int, last: int) -> list[int]:
    """The months after ``first`` up to ``last``, as ``yyyymm``."""
    out, now = [], first
    while now < last:
        now = now + 1 if now % 100 < 12 else now + 89
        out.append(now)
    return out


def advance(ledger: DataFrame, folder: str, until: int, product: int = L.PRODUCT, tie_break: Sequence[str] = (),
            max_loan_rows: int | None = None) -> DataFrame:
    """The stored state up to the month ``until`` (``yyyymm``): the latest one merged with each month since, each stored.

    Only those months are read; where no state is stored, it is started from all rows up to that month and
    those without a date.
    """
    spark = ledger.sparkSession

    def store(state: DataFrame, month: int) -> DataFrame:
        state.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/hasta={month}")
        return stored_state(spark, folder, month)[0]

    found = stored_state(spark, folder, until)
    if found is None:
        rows = ledger.filter(F.col("id_fecha").isNull() | (F.expr("id_fecha DIV 100") <= until))
        return store(loan_state(rows, product, tie_break, max_loan_rows), until)
    state, last = found
    for month in months_between(last, until):
        rows = ledger.filter(L.month_range(month // 100, month % 100) & in_period(ledger, month // 100, month % 100))
        state = store(merge(state, loan_state(rows, product, tie_break, max_loan_rows)), month)
    return state
