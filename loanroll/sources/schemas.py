"""Declared schemas of the warehouse tables the reports read.

The scripts infer types at run time (ODBC metadata, spreadsheet guessing);
here every source has a ``StructType`` so a reader never infers.
"""

from pyspark.sql import types as T

_I, _L, _D, _S = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Monthly ledger: one row per loan and month end.
LEDGER_MONTH = _schema(
    ("id_fecha", _I), ("credito", _L), ("id_fecha_desembolso", _I),
    ("valor_desembolso", _D), ("numero_dias_mora", _I),
    ("saldo_capital", _D), ("saldo_interes", _D), ("saldo_seguros", _D),
    ("saldo_cargo_1", _D), ("saldo_cargo_2", _D), ("saldo_cargo_3", _D),
    ("saldo_mora", _D), ("valor_canc_capital_intereses_seguros", _D),
    ("tipo_producto", _I), ("valor_garantia", _D),
)

LEDGER_COLUMNS = [f.name for f in LEDGER_MONTH.fields]

# The roll-rate report's wider projection of the same ledger (debtor id
# type, first invoice date, provision base, total debt). Read through
# ``readers.read_parquet_table``; columns a stored table lacks come back null.
LEDGER_MONTH_WIDE = T.StructType(LEDGER_MONTH.fields + [
    T.StructField("tipo_id_deudor", _S, True),
    T.StructField("id_fecha_primera_factura", _I, True),
    T.StructField("base_de_provision", _D, True),
    T.StructField("total_deuda", _D, True),
])

# Daily ledger, the columns the reports touch.
LEDGER_DAY = _schema(
    ("id_fecha", _I), ("credito", _L), ("tipo_producto", _I),
    ("saldo_capital", _D), ("valor_pago_ttl_canc", _D), ("ind_cierre", _I),
)

# Collateral (LTV) snapshots.
LTV = _schema(
    ("credito", _L), ("id_fecha", _I), ("tipo_producto", _I), ("conteo_garantias", _I),
    ("LTV", _D), ("valor_garantia_final", _D), ("libre_inversion_o_vehicular", _S),
)

# Restructuring marks; ``id_marca`` is the declared tie-break within a day.
RESTRUCTURING_MARK = _schema(
    ("credito", _L), ("id_fecha", _I), ("marcacion", _S), ("id_marca", _L),
)

# Collections.
COLLECTIONS = _schema(
    ("credito", _L), ("id_fecha_efe_mov", _I), ("cod_trans", _I), ("valor_pago_capital", _D),
)

# Purchase tape, snake_case inside the engine (display names at the sink).
PURCHASE_TAPE = _schema(
    ("credito", _L), ("suma_importe_base", _D), ("precio_compra", _D),
)
