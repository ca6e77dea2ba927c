"""Delinquency buckets, bucket share history and roll-rate matrices.

Plan shape, chosen for scale:

* share history: a hash aggregate keyed by month and bucket (partial
  aggregation map-side, so a month that holds a third of the ledger costs a
  few rows per task before the shuffle), then one over its few rows by month;
  no window or pivot stage over the ledger.
* roll matrix: the two month slices are reduced to one row per loan and month
  (in each task first), paired per loan by an aggregate keyed by ``credito``, then a key-less aggregate of 14 x 14
  conditional counts (partial per task, one final row) is unfolded into the
  fixed 14-row grid. No dense matrix, no collect, no literal-table join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanroll.functions.rnum import NULL_DOUBLE_SQL, div_sql, exact_parts, exact_value_sql, merged_parts
from loanroll.operators.ledger import TIE_BREAK, left_by_loan, month_range, with_year_month
from loanroll.sources.layout import in_period

# Days-past-due bucket labels, in order. ICV<n> holds up to n
# days (30-day bands up to 360), ICV0 exactly 0 days, ICV360+ beyond 360.
BUCKETS = [
    "ICV0", "ICV30", "ICV60", "ICV90", "ICV120", "ICV150", "ICV180",
    "ICV210", "ICV240", "ICV270", "ICV300", "ICV330", "ICV360", "ICV360+",
]
SHARE_BUCKETS = BUCKETS[:13]  # the share table leaves out ICV360+ (D11)
_BUCKET_ARRAY_SQL = "array(" + ", ".join(f"'{b}'" for b in BUCKETS) + ")"


def dpd_bucket_sql(days: str) -> str:
    """``case_when`` of the script. Fractional days between bands,
    negatives, NA and NaN fall in no bucket (null)."""
    d = f"CAST(({days}) AS DOUBLE)"
    arms = [f"WHEN isnan({d}) THEN CAST(NULL AS STRING)", f"WHEN {d} = 0 THEN 'ICV0'",
            f"WHEN {d} BETWEEN 0 AND 30 THEN 'ICV30'"]
    arms += [f"WHEN {d} BETWEEN {upper - 29} AND {upper} THEN 'ICV{upper}'" for upper in range(60, 361, 30)]
    arms.append(f"WHEN {d} > 360 THEN 'ICV360+'")
    return "(CASE " + " ".join(arms) + " END)"


def dpd_bucket(days: str) -> Column:
    """M18 as a Column of a SQL expression (e.g. a column name)."""
    return F.expr(dpd_bucket_sql(days))


def with_bucket(rows: DataFrame) -> DataFrame:
    return with_year_month(rows).withColumn("icvs", dpd_bucket("numero_dias_mora"))


def bucket_share_history(p70: DataFrame, include_over_360: bool = False,
                         strict_na: bool = True) -> DataFrame:
    """Per (anio, mes), each bucket's share of the month's capital.

    The denominator is the month's whole capital (ICV360+ and unbucketed rows
    included). With ``strict_na`` one NA balance makes its bucket (and the
    month total) NA, as ``sum()`` without ``na.rm`` does (D16).

    One hash aggregate keyed by the integer month ``id_fecha div 100`` and an
    integer bucket code, with order-free sums; its rows (one per month and
    bucket) are merged by month. The text ``anio``/``mes`` columns are cut from
    the month after that.
    """
    shown = BUCKETS if include_over_360 else SHARE_BUCKETS
    rows = p70.selectExpr(
        "id_fecha DIV 100 AS _ym", "saldo_capital",
        f"array_position({_BUCKET_ARRAY_SQL}, {dpd_bucket_sql('numero_dias_mora')}) AS _b")

    cells = rows.groupBy("_ym", "_b").agg(
        *(F.expr(f"{a} AS _{k}") for k, a in exact_parts("saldo_capital").items()),
        F.expr("count(*) AS _rows"), F.expr("count(saldo_capital) AS _known"))

    def value(parts: dict[str, str], n_rows: str, known: str) -> str:
        missing = f"{n_rows} > {known}" if strict_na else f"{known} = 0"
        return f"CASE WHEN {missing} THEN {NULL_DOUBLE_SQL} ELSE {exact_value_sql(parts, na_rm=False)} END"

    cells = cells.withColumn("_n", F.expr(value({k: f"_{k}" for k in exact_parts("x")}, "_rows", "_known")))
    totals = [F.expr(f"{a} AS _{k}") for k, a in merged_parts("_").items()]
    g = cells.groupBy("_ym").agg(  # one row per month and bucket comes in
        *(F.expr(f"max(CASE WHEN _b = {i + 1} THEN _n END) AS _n{i}") for i in range(len(shown))), *totals,
        F.expr("sum(_rows) AS _rows"), F.expr("sum(_known) AS _known"))
    g = g.withColumn("_total", F.expr(value({k: f"_{k}" for k in exact_parts("x")}, "_rows", "_known")))
    return g.selectExpr(
        "substring(CAST(_ym AS STRING), 1, 4) AS anio", "substring(CAST(_ym AS STRING), 5, 2) AS mes",
        *[f"{div_sql(f'_n{i}', '_total')} AS `{b}`" for i, b in enumerate(shown)])


def month_slice(p70: DataFrame, year: int, month: int) -> DataFrame:
    return with_bucket(p70.filter(month_range(year, month) & in_period(p70, year, month)))


def month_states(p70: DataFrame, t0: tuple[int, int], t1: tuple[int, int]) -> DataFrame:
    """One row per loan and month of the pair: ``credito``, ``_t1`` (the later month) and ``_b``, its bucket's number.

    A loan with several rows in a month has the bucket of its last one: the
    latest date, then the lowest ``orden`` (the order of the columns that
    ``orden`` breaks ties by, where the rows are not numbered). Each task keeps
    one row per loan and month before the exchange, so repeats cost nothing there.
    """
    in0, in1 = (month_range(*t) & in_period(p70, *t) for t in (t0, t1))
    # what stands after the days past due in the declared order changes nothing here
    declared = TIE_BREAK[:TIE_BREAK.index("numero_dias_mora") + 1]
    ties = [F.col("orden")] if "orden" in p70.columns else [F.col(c).asc_nulls_first() for c in declared]
    last = Window.partitionBy("credito", "_t1").orderBy(F.col("id_fecha").desc(), *ties)
    rows = p70.filter(in0 | in1).withColumn("_t1", in1)
    one = rows.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1")
    return one.select("credito", "_t1", "id_fecha",
                      F.expr(f"array_position({_BUCKET_ARRAY_SQL}, {dpd_bucket_sql('numero_dias_mora')})").alias("_b"))


def bucket_one_hot(p70: DataFrame, t0: tuple[int, int], t1: tuple[int, int]) -> DataFrame:
    """V2: one row per loan and month (``anio``, ``mes``), 1 in its bucket, 0 elsewhere; all 0 without a bucket."""
    return with_year_month(month_states(p70, t0, t1)).selectExpr(
        "anio", "mes", "credito", *[f"CASE WHEN _b = {i} THEN 1 ELSE 0 END AS `{b}`" for i, b in enumerate(BUCKETS, 1)])


def bucket_one_hot_common(p70: DataFrame, t0: tuple[int, int], t1: tuple[int, int]) -> DataFrame:
    """V3: the one-hot rows of the loans present in both months, two rows each.

    One aggregate per loan over the pair of months, unfolded again.
    """
    pairs = _paired(month_states(p70, t0, t1))
    months = ", ".join(f"struct('{y:04d}' AS anio, '{m:02d}' AS mes, {b} AS _b)" for (y, m), b in ((t0, "_b0"), (t1, "_b1")))
    return pairs.selectExpr("credito", f"inline(array({months}))").selectExpr(
        "anio", "mes", "credito", *[f"CASE WHEN _b = {i} THEN 1 ELSE 0 END AS `{b}`" for i, b in enumerate(BUCKETS, 1)])


def _paired(states: DataFrame) -> DataFrame:
    """Loans of both months with their buckets' numbers (0 or null: none) as ``_b0`` and ``_b1``."""
    pairs = states.groupBy("credito").agg(
        F.expr("max(CASE WHEN NOT _t1 THEN 1 END) AS _in0"),
        F.expr("max(CASE WHEN _t1 THEN 1 END) AS _in1"),
        F.expr("max(CASE WHEN NOT _t1 THEN _b END) AS _b0"),
        F.expr("max(CASE WHEN _t1 THEN _b END) AS _b1"),
    )
    return pairs.filter("_in0 IS NOT NULL AND _in1 IS NOT NULL").select("credito", "_b0", "_b1")


def common_loans(p70: DataFrame, t0: tuple[int, int], t1: tuple[int, int]) -> DataFrame:
    """Distinct loans present in both months (set intersection)."""
    # Each side is made distinct first (partial aggregation), so a loan with
    # many rows in a month reaches the set operation as one row.
    c0, c1 = (p70.filter(month_range(*t) & in_period(p70, *t)).select("credito").distinct() for t in (t0, t1))
    return c1.intersect(c0)


def roll_pairs(p70: DataFrame, t0: tuple[int, int], t1: tuple[int, int]) -> DataFrame:
    """Each loan present in both months with its bucket at t0 and t1.

    Both slices are read once, reduced to one row per loan and month
    (:func:`month_states`) and paired per loan by a hash aggregate on ``credito``.
    """
    pairs = _paired(month_states(p70, t0, t1))
    label = "CASE WHEN {0} > 0 THEN element_at(" + _BUCKET_ARRAY_SQL + ", CAST({0} AS INT)) END"
    return pairs.selectExpr(
        "credito", f"{label.format('_b0')} AS bucket_t0", f"{label.format('_b1')} AS bucket_t1")


def roll_matrix_units(p70: DataFrame, t0: tuple[int, int], t1: tuple[int, int]) -> DataFrame:
    """Loans in bucket i at t0 and j at t1; full 14 x 14 grid.

    Loans without a bucket in either month count nowhere (their one-hot row
    is all zeros in the script's matrix product). Pairs are counted per
    (from, to) cell (at most 196 groups, partial aggregation), gathered into
    one map bounded by the grid size, and unfolded into the 14 rows with 0
    for absent cells.
    """
    pairs = roll_pairs(p70, t0, t1).filter(F.col("bucket_t0").isNotNull() & F.col("bucket_t1").isNotNull())
    cells = pairs.groupBy("bucket_t0", "bucket_t1").agg(F.count(F.lit(1)).alias("n"))
    cell_map = cells.agg(F.expr(
        "map_from_entries(collect_list(struct(concat_ws('|', bucket_t0, bucket_t1), n))) AS m"))
    grid = ", ".join(
        "named_struct('bucket_from', '{a}', {cells})".format(a=a, cells=", ".join(
            f"'{b}', coalesce(try_element_at(m, '{a}|{b}'), 0L)" for b in BUCKETS))
        for a in BUCKETS)
    # One map row unfolded in bucket order: rows come out in grid order.
    return cell_map.selectExpr(f"inline(array({grid}))")


_ROW_TOTAL_SQL = " + ".join(f"`{b}`" for b in BUCKETS)


def roll_matrix_share(units: DataFrame) -> DataFrame:
    """Row-normalised matrix; an empty row gives 0/0 = NaN."""
    return units.withColumn("_row_total", F.expr(_ROW_TOTAL_SQL)).selectExpr(
        "bucket_from", *[f"{div_sql(f'`{b}`', '_row_total')} AS `{b}`" for b in BUCKETS])


def roll_matrix_check(share: DataFrame) -> DataFrame:
    """Each row of shares sums to 1 (NaN for an empty row); all 14 columns."""
    return share.selectExpr("bucket_from", f"{_ROW_TOTAL_SQL} AS row_sum")


def collections_flag(p70: DataFrame, collections: DataFrame, code: int = 88) -> DataFrame:
    """S5 + A6 + M23: product rows left-joined to the distinct (loan, code) pairs.

    The distinct runs as an aggregate with partial aggregation; after the code
    filter it is unique per loan, so the left join never fans out.
    """
    coded = collections.filter(F.col("cod_trans") == code).select("credito", "cod_trans").distinct()
    return with_year_month(left_by_loan(p70, coded))
