"""Monthly-ledger operators: sequence number, product slices, per-loan profile.

Partitioning: everything per loan is keyed by ``credito``. The ledger is
exchanged by loan once, in the columns a stage needs; the sequence number is a
window on that exchange, and all per-loan values (span, first and last
observation, prior-product balance, duration, the last two rows) come out of
one aggregate over the numbered rows, in the same partitioning: no second
exchange and no join.

Loans with more than ``HOT_ROWS`` rows are the exception. One narrow aggregate
finds them (or the caller knows the largest loan's rows); they are numbered by
range partitions, so that no task holds such a loan, and reach the aggregate
as partial results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanroll.functions.rnum import eq_sql, ifelse_sql
from loanroll.session import write_and_read

# Columns whose first and last product-70 values the reports keep.
OBSERVED_COLUMNS = [
    "id_fecha", "numero_dias_mora", "saldo_capital", "saldo_interes", "saldo_seguros",
    "saldo_cargo_1", "saldo_cargo_2", "saldo_cargo_3", "saldo_mora",
]

# Exposure = capital + interest + insurance + the three charges (arrears excluded).
EXPOSURE_PARTS = [
    "saldo_capital", "saldo_interes", "saldo_seguros",
    "saldo_cargo_1", "saldo_cargo_2", "saldo_cargo_3",
]

PRODUCT = 70
_ORDEN_SPAN = 1 << 36  # orden < 2^36 and id_fecha < 10^8, so id_fecha * 2^36 - orden fits 64 bits and orders (id_fecha, -orden)

# Order of the rows that share (credito, id_fecha), ascending, nulls first. Rows equal in
# all these columns are interchangeable.
TIE_BREAK = [
    "tipo_producto", "id_fecha_desembolso", *OBSERVED_COLUMNS[1:],
    "valor_desembolso", "valor_canc_capital_intereses_seguros", "valor_garantia",
]
# What the per-loan profile reads; a prefix of the declared order, so a narrow ledger is
# numbered like the whole one wherever the profile can tell rows apart.
PROFILE_COLUMNS = ["credito", "id_fecha", "tipo_producto", "id_fecha_desembolso", *OBSERVED_COLUMNS[1:]]

HOT_ROWS = 1_000_000


def same_loan(left: DataFrame, right: DataFrame) -> Column:
    """Null-safe equality of the loan ids (the scripts' joins match NA with NA)."""
    return left["credito"].eqNullSafe(right["credito"])


def left_by_loan(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on the loan id, NA matching NA."""
    key = right.withColumnRenamed("credito", "_credito")
    return left.join(key, left["credito"].eqNullSafe(key["_credito"]), "left").drop("_credito")


def sequence_order(ledger: DataFrame, tie_break: Sequence[str] = ()) -> list[Column]:
    """``id_fecha``, then ``tie_break``, then the declared columns, each ascending with nulls first."""
    names = ["id_fecha", *dict.fromkeys([*tie_break, *(c for c in TIE_BREAK if c in ledger.columns)])]
    return [F.col(c).asc_nulls_first() for c in names]


def hot_loans(ledger: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Loans with more than ``hot_rows`` rows: an aggregate over one column, at most 1 / hot_rows of the ledger's rows."""
    return ledger.groupBy("credito").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).select("credito")


def with_sequence(ledger: DataFrame, tie_break: Sequence[str] = (), hot_rows: int = HOT_ROWS,
                  max_loan_rows: int | None = None, last_date: bool = False) -> DataFrame:
    """``orden`` = row number of the loan's months over ALL products.

    Must be computed before any product filter (``Duracion_p10`` counts the
    months spent in other products). Rows without a date come first, as in
    ``ROW_NUMBER()``; rows without a loan id are one loan. ``last_date`` adds
    the loan's latest date as ``_ultima``.

    One exchange of the ledger and one sort, unless a loan has more than
    ``hot_rows`` rows (``max_loan_rows``, where known, spares the search).
    """
    order = sequence_order(ledger, tie_break)
    loan = Window.partitionBy("credito")

    def plain(rows: DataFrame) -> DataFrame:
        out = rows.withColumn("orden", F.row_number().over(loan.orderBy(*order)).cast("bigint"))
        return out.withColumn("_ultima", F.max("id_fecha").over(loan)) if last_date else out

    if max_loan_rows is not None and max_loan_rows <= hot_rows:
        return plain(ledger)
    hot = hot_loans(ledger, hot_rows)
    if hot.isEmpty():
        return plain(ledger)
    hot = write_and_read(hot, "hot-loans")
    cold = ledger.join(hot, same_loan(ledger, hot), "left_anti")
    many = _number_by_ranges(ledger.join(hot, same_loan(ledger, hot), "left_semi"), order)
    if last_date:
        latest = many.groupBy("credito").agg(F.max("id_fecha").alias("_ultima"))
        many = left_by_loan(many, latest)
    return plain(cold).unionByName(many)


def _number_by_ranges(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Number loans that are too large for one task.

    The rows are written sorted by (loan, order) in range partitions, with the
    partition's number; a loan's rows before a partition are the sum of its
    counts in the partitions before it. Equal rows are told apart by a row id,
    so that even a cell of equal rows spreads over partitions.
    """
    key = [F.col("credito").asc_nulls_first(), *order, F.col("_fila").asc()]
    ranged = rows.withColumn("_fila", F.monotonically_increasing_id()).repartitionByRange(*key).sortWithinPartitions(*key)
    ranged = write_and_read(ranged.withColumn("_tramo", F.spark_partition_id()), "hot-rows")
    counts = ranged.groupBy("credito", "_tramo").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("credito").orderBy("_tramo").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("credito").alias("_credito"), F.col("_tramo").alias("_t"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_antes"))
    inside = Window.partitionBy("credito", "_tramo").orderBy(*order, "_fila")
    numbered = ranged.withColumn("_en", F.row_number().over(inside))
    joined = numbered.join(counts, numbered["credito"].eqNullSafe(F.col("_credito")) & (F.col("_tramo") == F.col("_t")))
    return joined.withColumn("orden", (F.col("_antes") + F.col("_en")).cast("bigint")).drop(
        "_fila", "_tramo", "_credito", "_t", "_antes", "_en")


def assert_unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D4 option: rows whose key appears more than once (empty when unique).

    An aggregate with partial aggregation; run it (e.g. ``.isEmpty()``) before
    a join that must not fan out.
    """
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def with_year_month(df: DataFrame) -> DataFrame:
    """``anio`` and ``mes`` as text cut from the ``yyyymmdd`` key."""
    return df.withColumns({
        "mes": F.expr("substring(CAST(id_fecha AS STRING), 5, 2)"),
        "anio": F.expr("substring(CAST(id_fecha AS STRING), 1, 4)"),
    })


def product_slice(ledger: DataFrame, product: int = PRODUCT, negate: bool = False) -> DataFrame:
    """Rows of one product (``negate`` keeps the other products)."""
    cond = F.col("tipo_producto") == product
    return ledger.filter(~cond if negate else cond)


def exposure_sql(suffix: str = "") -> str:
    return " + ".join(f"{part}{suffix}" for part in EXPOSURE_PARTS)


def exposure(suffix: str = "") -> Column:
    """M1: exposure of one observation (columns carry ``suffix``)."""
    return F.expr(exposure_sql(suffix))


def with_exposure(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("saldo_exposicion", exposure())


def month_range(year: int, month: int) -> Column:
    """Rows of one calendar month, as a range on the key (pushes to the scan)."""
    lo = year * 10000 + month * 100
    return F.col("id_fecha").between(lo + 1, lo + 31)


def loan_profile(ledger: DataFrame, product: int = PRODUCT, strict_na: bool = True,
                 tie_break: Sequence[str] = (), max_loan_rows: int | None = None) -> DataFrame:
    """One row per loan with at least one ``product`` month.

    Columns: the span (A1/A1b), first and last product observation with
    ``_inicial``/``_actual`` suffixes (A2, P5), exposures (M1, M2), the last
    observation under any other product (M3: ``capital_ant``, ``saldo_ant``,
    ``n_prior``) and the loan's last two rows over all products (W5:
    ``_ultimo_*`` the first row of the latest month, ``_previo_*`` the row
    before it).

    First = earliest date, then lowest ``orden``; last = latest date, then
    lowest ``orden`` (``which.min``/``which.max`` skip NA dates and keep the
    first tie); ``Duracion_p10`` is the lowest product ``orden``. With
    ``strict_na`` a missing date or disbursement date of a product row makes
    the span's ``min``/``max``/``mean`` missing, as without ``na.rm``.

    A ledger without ``orden`` is numbered here, in the columns the profile
    reads: one scan and one exchange for the whole profile.
    """
    if "orden" not in ledger.columns or "_ultima" not in ledger.columns:
        columns = [c for c in dict.fromkeys([*PROFILE_COLUMNS, *tie_break])]
        ledger = with_sequence(ledger.select(*columns), tie_break, max_loan_rows=max_loan_rows, last_date=True)
    is_p, other = f"tipo_producto = {product}", f"tipo_producto <> {product}"
    first_key = f"CAST(id_fecha AS BIGINT) * {_ORDEN_SPAN} + orden"
    last_key = f"CAST(id_fecha AS BIGINT) * {_ORDEN_SPAN} - orden"
    k_first = f"CASE WHEN {is_p} THEN {first_key} END"
    k_last = f"CASE WHEN {is_p} THEN {last_key} END"
    k_prior = f"CASE WHEN {other} THEN {last_key} END"
    k_before = "CASE WHEN _ultima IS NOT NULL AND (id_fecha IS NULL OR id_fecha < _ultima) THEN orden END"
    desemb = f"CASE WHEN {is_p} THEN CAST(id_fecha_desembolso AS DOUBLE) END"
    fecha_min, fecha_mean = f"min({desemb})", f"avg({desemb})"
    inicio, vigencia = (f"{f}(CASE WHEN {is_p} THEN id_fecha END)" for f in ("min", "max"))
    if strict_na:
        def strict(value: str, column: str) -> str:
            missing = f"count(CASE WHEN {is_p} AND {column} IS NULL THEN 1 END) > 0"
            return f"CASE WHEN {missing} THEN NULL ELSE {value} END"

        fecha_min, fecha_mean = (strict(v, "id_fecha_desembolso") for v in (fecha_min, fecha_mean))
        inicio, vigencia = (strict(v, "id_fecha") for v in (inicio, vigencia))

    aggs = [
        f"{fecha_min} AS Fecha_desembolso",
        f"{fecha_mean} AS Fecha_desembolso_media",
        f"{inicio} AS fecha_inicio_p70",
        f"{vigencia} AS fecha_vigencia",
        f"count(CASE WHEN {is_p} THEN 1 END) AS Duracion_p70",
        f"min(CASE WHEN {is_p} THEN orden END) AS Duracion_p10",
    ]
    aggs += [f"min_by({c}, {k_first}) AS {c}_inicial" for c in OBSERVED_COLUMNS]
    aggs += [f"max_by({c}, {k_last}) AS {c}_actual" for c in OBSERVED_COLUMNS]
    aggs += [
        f"max_by({exposure_sql()}, {k_prior}) AS capital_ant",
        f"max_by(saldo_capital, {k_prior}) AS saldo_ant",
        f"count({k_prior}) AS n_prior",
        f"max_by(saldo_capital, {last_key}) AS _ultimo_capital",
        f"max_by(tipo_producto, {last_key}) AS _ultimo_tipo",
        f"max_by(saldo_capital, {k_before}) AS _previo_capital",
        f"max_by(tipo_producto, {k_before}) AS _previo_tipo",
    ]
    profile = ledger.groupBy("credito").agg(*[F.expr(a) for a in aggs]).filter("Duracion_p70 > 0")
    return profile.withColumns({
        "Saldo_exposicion_inicial": exposure("_inicial"),
        "Saldo_exposicion_actual": exposure("_actual"),
    })


SPAN_COLUMNS = ["credito", "Fecha_desembolso", "fecha_inicio_p70", "fecha_vigencia",
                "Duracion_p70", "Duracion_p10"]


def loan_span(profile: DataFrame, mean_disbursement: bool = False) -> DataFrame:
    """A1 (``min`` of the disbursement key) or A1b (``mean``)."""
    cols = [F.col(c) for c in SPAN_COLUMNS]
    if mean_disbursement:
        cols[1] = F.col("Fecha_desembolso_media").alias("Fecha_desembolso")
    return profile.select(*cols)


def first_last_observation(profile: DataFrame) -> DataFrame:
    """A2 + P5: first and last product observation, suffixed columns."""
    return profile.select(
        "credito",
        *[f"{c}_inicial" for c in OBSERVED_COLUMNS],
        *[f"{c}_actual" for c in OBSERVED_COLUMNS],
    )


def recovery_base(profile: DataFrame) -> DataFrame:
    """M2: span + first + last + both exposures (the scripts' ``BBB``)."""
    return profile.select(
        *SPAN_COLUMNS,
        *[f"{c}_inicial" for c in OBSERVED_COLUMNS],
        *[f"{c}_actual" for c in OBSERVED_COLUMNS],
        "Saldo_exposicion_inicial", "Saldo_exposicion_actual",
    )


def zero_start_loans(base: DataFrame) -> DataFrame:
    """P10: loans whose first product exposure is exactly zero."""
    return base.filter(F.col("Saldo_exposicion_inicial") == 0)


def prior_product_balance(profile: DataFrame) -> DataFrame:
    """M3: last record under another product for zero-start loans.

    No "before" condition: the last non-product month anywhere in time.
    """
    return (
        profile.filter((F.col("Saldo_exposicion_inicial") == 0) & (F.col("n_prior") > 0))
        .select("credito", "capital_ant", "saldo_ant")
    )


def zero_start_history(ledger_seq: DataFrame, profile: DataFrame) -> DataFrame:
    """Every numbered ledger row (all products) of the zero-start loans (left semi join, NA matching NA).

    Both sides are partitioned by loan, and a join by plain equality keeps that, while a null-safe one would
    exchange the whole ledger. So the loan without an id, which is one row of the profile, is looked up first; if
    it is a zero-start loan, its rows are those that the join leaves without a match.
    """
    zero = zero_start_loans(profile).select(F.col("credito").alias("_cero"))
    same = F.col("credito") == F.col("_cero")
    if zero.filter("_cero IS NULL").isEmpty():
        return ledger_seq.join(zero, same, "left_semi")
    found = ledger_seq.join(zero.distinct(), same, "left")
    return found.filter("credito IS NULL OR _cero IS NOT NULL").drop("_cero")


def adjusted_recovery_base(profile: DataFrame, exposure_baseline: str = "as_written") -> DataFrame:
    """M4: initial values of zero-start one-month loans take the prior balance.

    ``exposure_baseline="as_written"`` reproduces the script: the else branch
    of the exposure takes the CURRENT exposure (D1). ``"initial"`` keeps the
    initial exposure, as the older script does for capital.
    """
    if exposure_baseline not in ("as_written", "initial"):
        raise ValueError(f"exposure_baseline: {exposure_baseline!r}")
    # The prior balance is joined (before any mutate) only for zero-start loans:
    # the script's left join leaves NA for every other loan.
    joined = profile.withColumns({
        "_capital_ant": F.expr("CASE WHEN Saldo_exposicion_inicial = 0 THEN capital_ant END"),
        "_saldo_ant": F.expr("CASE WHEN Saldo_exposicion_inicial = 0 THEN saldo_ant END"),
    })
    else_exposure = "Saldo_exposicion_actual" if exposure_baseline == "as_written" else "Saldo_exposicion_inicial"
    one_month = "Duracion_p70 = 1"
    return recovery_base(joined.withColumns({   # both read the values before the update
        "Saldo_exposicion_inicial": F.expr(ifelse_sql(
            f"{eq_sql('Saldo_exposicion_inicial', 0)} AND {one_month}", "_capital_ant", else_exposure)),
        "saldo_capital_inicial": F.expr(ifelse_sql(
            f"{eq_sql('saldo_capital_inicial', 0)} AND {one_month}", "_saldo_ant", "saldo_capital_inicial")),
    }))


def last_two_non_product(profile: DataFrame, product: int = PRODUCT) -> DataFrame:
    """W5 + M3b (older script): of the last two rows of each loan whose first capital is zero, those not in ``product``.

    0, 1 or 2 rows per loan, so a later join fans out. "Last two" is
    ``slice((which.max(id_fecha) - 1):which.max(id_fecha))`` on the numbered
    rows: the first row of the latest month and the row before it, both kept
    by :func:`loan_profile`.
    """
    rows = profile.filter("saldo_capital_inicial = 0").selectExpr(
        "credito", "inline(array(struct(_ultimo_capital AS capital_ant, _ultimo_tipo AS _tipo), "
        "struct(_previo_capital AS capital_ant, _previo_tipo AS _tipo)))")
    return rows.filter(f"_tipo <> {product}").select("credito", "capital_ant")


def first_last_capital(profile: DataFrame) -> DataFrame:
    """A2b (older script): first and last capital, last days past due."""
    return profile.select(
        "credito",
        F.col("saldo_capital_inicial").alias("Saldo_capital_inicial"),
        F.col("saldo_capital_actual").alias("Saldo_capital_final"),
        F.col("numero_dias_mora_actual").alias("dias_mora_actual"),
    )


def capital_base_v1(profile: DataFrame, *further: str) -> DataFrame:
    """Older script's per-loan table: A1b span + A2b values (one projection)."""
    return profile.select(
        "credito", *further,
        F.col("Fecha_desembolso_media").alias("Fecha_desembolso"),
        *SPAN_COLUMNS[2:],
        F.col("saldo_capital_inicial").alias("Saldo_capital_inicial"),
        F.col("saldo_capital_actual").alias("Saldo_capital_final"),
        F.col("numero_dias_mora_actual").alias("dias_mora_actual"),
    )


def adjusted_capital_v1(profile: DataFrame, product: int = PRODUCT) -> DataFrame:
    """Zero-start one-month loans take the prior capital; else keep initial.

    The prior rows are those of :func:`last_two_non_product`; a loan with two
    of them becomes two rows and one without any keeps its row, as in the
    script's left join. They come from the loan's own profile row, so nothing
    is joined.
    """
    prior = f"""filter(array(struct(_ultimo_capital AS capital, _ultimo_tipo AS tipo),
        struct(_previo_capital AS capital, _previo_tipo AS tipo)),
        x -> saldo_capital_inicial = 0 AND x.tipo <> {product})"""
    rows = profile.withColumn("_prior", F.expr(f"explode_outer(transform({prior}, x -> struct(x.capital AS capital)))"))
    base = capital_base_v1(rows, "_prior")
    return (
        base.withColumn("Saldo_capital_inicial", F.expr(ifelse_sql(
            f"{eq_sql('Saldo_capital_inicial', 0)} AND Duracion_p70 = 1", "_prior.capital", "Saldo_capital_inicial")))
        .drop("_prior")
    )
