"""Presentation rules of the registered queries.

* Doubles are rounded to ``ROUND_DIGITS`` decimals, sums of money to ``MONEY_DIGITS``. The latter are exact sums of
  amounts with few decimals, often halfway between two cents: they are rounded half to even by plain arithmetic, as
  engines differ in what ``round`` makes of such a double.
* Integer columns that can hold gaps are shown as doubles, in every query
  alike, so that a gap is the same missing float in every client (pandas turns
  a Spark int column with nulls into float64, DuckDB into nullable Int32).
"""

ROUND_DIGITS = 6
MONEY_DIGITS = 2

MONEY_SUMS = frozenset(["Deuda_total", "Saldo_a_capital", "Precio_de_compra", "Valoracion", "Valoracion_mod", "Valoracion_capital"])

KEYS_AS_DOUBLES = frozenset([
    "credito", "id_fecha", "id_fecha_desembolso", "id_fecha_primera_factura", "id_fecha_inicial", "id_fecha_actual",
    "fecha_inicio_p70", "fecha_vigencia", "Duracion_p70", "Duracion_p10", "numero_dias_mora",
    "numero_dias_mora_inicial", "numero_dias_mora_actual", "dias_mora_actual", "tipo_producto", "cod_trans", "desde", "hasta",
])
