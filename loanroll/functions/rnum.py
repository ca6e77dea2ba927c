"""R missing-value arithmetic as Spark expressions.

R keeps two missing markers in a double column: ``NA`` (Spark null) and
``NaN``. Spark differs on four points that the reports depend on:

* ``x / 0`` raises under ANSI mode; R gives ``+Inf``/``-Inf``/``NaN``.
* ``NaN`` compares as the greatest double (``NaN > 0`` is true); in R any
  comparison with ``NaN`` is ``NA``.
* ``when(null)`` falls through to ``otherwise``; R's ``ifelse(NA, ...)`` is NA.
* ``sum`` is poisoned by ``NaN``; R's ``sum(na.rm = TRUE)`` drops it, and an
  empty sum is 0 rather than null.

The ``*_sql`` builders return Spark SQL text (arguments are SQL expressions:
column names or snippets; numbers become double literals), which a query
parses once: far cheaper to build than a tree of Python Column calls, and the
same code-generated expressions.
"""

from __future__ import annotations

NULL_DOUBLE_SQL = "CAST(NULL AS DOUBLE)"
NAN_SQL = "CAST('NaN' AS DOUBLE)"


def sql(x) -> str:
    """A SQL operand: text is an expression (parenthesised), numbers are literals."""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int):
        return str(x)
    if isinstance(x, float):
        return f"CAST('{x!r}' AS DOUBLE)" if x != x or x in (float("inf"), float("-inf")) else f"{x!r}D"
    return f"({x})"


def div_sql(a, b) -> str:
    a, b = sql(a), sql(b)
    return (f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN {NULL_DOUBLE_SQL} "
            f"WHEN {b} = 0 THEN (CASE WHEN isnan({a}) OR {a} = 0 THEN {NAN_SQL} "
            f"WHEN {a} > 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST('-Infinity' AS DOUBLE) END) "
            f"ELSE CAST({a} AS DOUBLE) / {b} END)")


def ifelse_sql(cond, yes, no) -> str:
    c = sql(cond)
    return f"(CASE WHEN {c} IS NULL THEN NULL WHEN {c} THEN {sql(yes)} ELSE {sql(no)} END)"


def _cmp_sql(op: str):
    def build(a, b) -> str:
        a, b = sql(a), sql(b)
        return f"(CASE WHEN isnan({a}) OR isnan({b}) THEN CAST(NULL AS BOOLEAN) ELSE {a} {op} {b} END)"
    return build


gt_sql, ge_sql, lt_sql, le_sql, eq_sql = (_cmp_sql(op) for op in (">", ">=", "<", "<=", "="))


def is_na_sql(x) -> str:
    x = sql(x)
    return f"({x} IS NULL OR isnan({x}))"


def is_nan_sql(x) -> str:
    return f"coalesce(isnan({sql(x)}), false)"


def sum_na_rm_sql(x) -> str:
    """``sum(na.rm = TRUE)`` with the same digits whatever the partitions: NA and NaN are skipped, an empty sum is 0."""
    return exact_value_sql(exact_parts(x))


# Sums that don't depend on the order of addition ---------------------------------

EXACT_SCALE = 100_000_000  # whole units and 10^-8 parts are summed apart, as integers


def _finite(x: str) -> str:
    return f"abs({x}) < CAST('Infinity' AS DOUBLE)"  # not for NaN, which is above infinity, nor for null


def exact_parts(x) -> dict[str, str]:
    """Aggregates of one double column from which its sum follows whatever the order of the rows.

    ``hi`` and ``lo``: sums of the whole parts and of the rest in units of 10^-8 (each value is rounded to
    these once, so the sum is that of the rounded values); ``up``, ``down``, ``nan``: whether there are
    infinities and NaN. Sums beyond 64 bits raise under ANSI rules.
    """
    x = sql(x)
    whole, rest = f"floor({x})", f"floor(({x} - floor({x})) * {EXACT_SCALE}D + 0.5D)"
    return {
        "hi": f"coalesce(sum(CASE WHEN {_finite(x)} THEN {whole} END), 0L)",
        "lo": f"coalesce(sum(CASE WHEN {_finite(x)} THEN {rest} END), 0L)",
        "up": f"coalesce(max({x} = CAST('Infinity' AS DOUBLE)), false)",
        "down": f"coalesce(max({x} = CAST('-Infinity' AS DOUBLE)), false)",
        "nan": f"coalesce(max(isnan({x})), false)",
    }


def merged_parts(prefix: str) -> dict[str, str]:
    """Aggregates that merge the parts of several groups, held in columns ``prefix`` + part."""
    return {k: f"coalesce({'sum' if k in ('hi', 'lo') else 'max'}({prefix}{k}), {'0L' if k in ('hi', 'lo') else 'false'})"
            for k in ("hi", "lo", "up", "down", "nan")}


def exact_value_sql(parts: dict[str, str], na_rm: bool = True) -> str:
    """The sum as a double; ``na_rm`` leaves NaN out."""
    p = parts
    total = f"CAST(CAST({p['hi']} AS DECIMAL(28,0)) * {EXACT_SCALE} + {p['lo']} AS DOUBLE) / {EXACT_SCALE}D"
    nan = f"({p['up']} AND {p['down']})" if na_rm else f"({p['nan']} OR ({p['up']} AND {p['down']}))"
    return (f"(CASE WHEN {nan} THEN {NAN_SQL} WHEN {p['up']} THEN CAST('Infinity' AS DOUBLE) "
            f"WHEN {p['down']} THEN CAST('-Infinity' AS DOUBLE) ELSE {total} END)")
