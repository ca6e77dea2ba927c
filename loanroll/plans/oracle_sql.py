"""DuckDB SQL cross-checks for the registered queries.

Each string runs on the driver's raw views (``lineitem``, ``part``,
``orders``, ...). The report sources are rebuilt here as CTEs from the same
FIXTURES.md definitions without importing anything of the Spark code; the
formulas are the same rules, so an arm misread twice would pass. First/last
rows by ``ROW_NUMBER`` instead of ``min_by``/``max_by``, share history by
group + window + filtered pivot, roll matrix by join. R's NA/NaN rules are
spelled out as ``CASE`` (DuckDB, like Spark, ranks NaN above all numbers).
Doubles are rounded to 6 decimals, sums of money to 2.
"""

from __future__ import annotations

# Fixed values, stated here anew: bucket labels in order, and the integer columns that are shown as doubles.
BUCKETS = ["ICV0", "ICV30", "ICV60", "ICV90", "ICV120", "ICV150", "ICV180", "ICV210", "ICV240", "ICV270", "ICV300", "ICV330",
           "ICV360", "ICV360+"]
SHARE_BUCKETS = ["ICV0", "ICV30", "ICV60", "ICV90", "ICV120", "ICV150", "ICV180", "ICV210", "ICV240", "ICV270", "ICV300",
                 "ICV330", "ICV360"]
AS_OF_KEY = 20010630                  # fecha_actual of the fixture as_of 2001-07-15
PRIOR_KEY = 20010531
WINDOW_KEYS = "20010701, 20010702, 20010703, 20010704, 20010705"
PRIOR_WINDOW_KEYS = "20010601, 20010602, 20010603, 20010604, 20010605"
T0 = (20001001, 20001031)
T1 = (20001101, 20001130)


# --- R arithmetic as SQL text --------------------------------------------------

def DIV(a: str, b: str) -> str:
    return (f"(CASE WHEN ({a}) IS NULL OR ({b}) IS NULL THEN NULL "
            f"WHEN ({b}) = 0 THEN (CASE WHEN isnan(CAST({a} AS DOUBLE)) OR ({a}) = 0 THEN 'NaN'::DOUBLE "
            f"WHEN ({a}) > 0 THEN 'Infinity'::DOUBLE ELSE '-Infinity'::DOUBLE END) "
            f"ELSE CAST({a} AS DOUBLE) / ({b}) END)")


def IFELSE(cond: str, yes: str, no: str) -> str:
    return f"(CASE WHEN ({cond}) IS NULL THEN NULL WHEN ({cond}) THEN {yes} ELSE {no} END)"


def _cmp(op: str):
    def f(a: str, b: str) -> str:
        return (f"(CASE WHEN isnan(CAST({a} AS DOUBLE)) OR isnan(CAST({b} AS DOUBLE)) THEN NULL "
                f"ELSE ({a}) {op} ({b}) END)")
    return f


GT, LT, LE, EQ = _cmp(">"), _cmp("<"), _cmp("<="), _cmp("=")


def EXACT(x: str) -> str:
    """The finite values' sum, order-free: whole parts and 10^-8 parts as integers."""
    fin = f"CASE WHEN isfinite({x}) THEN"
    return (f"(coalesce(sum({fin} CAST(floor({x}) AS HUGEINT) * 100000000"
            f" + CAST(floor(({x} - floor({x})) * 100000000 + 0.5) AS HUGEINT) END), 0)::DOUBLE / 100000000)")


def NANSUM(x: str) -> str:
    up, down = f"coalesce(bool_or({x} = 'Infinity'::DOUBLE), false)", f"coalesce(bool_or({x} = '-Infinity'::DOUBLE), false)"
    return (f"(CASE WHEN {up} AND {down} THEN 'NaN'::DOUBLE WHEN {up} THEN 'Infinity'::DOUBLE "
            f"WHEN {down} THEN '-Infinity'::DOUBLE ELSE {EXACT(x)} END)")


def ISNA(x: str) -> str:
    return f"(({x}) IS NULL OR isnan({x}))"


# Sums of money are shown with 2 decimals, other doubles with 6.
MONEY_SUMS = ("Deuda_total", "Saldo_a_capital", "Precio_de_compra", "Valoracion", "Valoracion_mod", "Valoracion_capital")


def RND(x: str, alias: str | None = None) -> str:
    name = alias or x.strip(chr(34))
    return f'round_even({x} * 100, 0) / 100 AS "{name}"' if name in MONEY_SUMS else f'round({x}, 6) AS "{name}"'


def KEY(ts: str) -> str:
    return f"CAST(strftime(CAST({ts} AS DATE), '%Y%m%d') AS INTEGER)"


def EXPOSURE(prefix: str = "", suffix: str = "") -> str:
    parts = ["saldo_capital", "saldo_interes", "saldo_seguros", "saldo_cargo_1", "saldo_cargo_2",
             "saldo_cargo_3"]
    return " + ".join(f"{prefix}{p}{suffix}" for p in parts)


def FACTOR_INV(r: str, ltv: str, d: str) -> str:
    return (f"(CASE WHEN {GT(r, '0')} AND {LE(ltv, '0.8')} THEN (1 + {r}) * (1 + {DIV('1.0', ltv)} * {DIV('1.0', d)}) "
            f"WHEN {EQ(r, '0')} AND {LE(ltv, '0.6')} THEN 1 + 0.6 * {DIV('1.0', ltv)} "
            f"ELSE 1 + {r} END)")


def FACTOR_DIRECT(r: str, ltv: str, d: str) -> str:
    return (f"(CASE WHEN {GT(r, '0')} AND {GT(ltv, '1')} THEN (1 + {r}) * (1 + {DIV(ltv, d)}) "
            f"WHEN {EQ(r, '0')} AND {GT(ltv, '1')} THEN 1 + 0.75 * {ltv} "
            f"ELSE 1 + {r} END)")


def BUCKET(days: str) -> str:
    d = f"CAST({days} AS DOUBLE)"
    arms = [f"WHEN isnan({d}) THEN NULL", f"WHEN {d} = 0 THEN 'ICV0'", f"WHEN {d} BETWEEN 0 AND 30 THEN 'ICV30'"]
    for upper in range(60, 361, 30):
        arms.append(f"WHEN {d} BETWEEN {upper - 29} AND {upper} THEN 'ICV{upper}'")
    arms.append(f"WHEN {d} > 360 THEN 'ICV360+'")
    return "(CASE " + " ".join(arms) + " END)"


OBS = ["id_fecha", "numero_dias_mora", "saldo_capital", "saldo_interes", "saldo_seguros",
       "saldo_cargo_1", "saldo_cargo_2", "saldo_cargo_3", "saldo_mora"]
LEDGER_COLS = ["id_fecha", "credito", "id_fecha_desembolso", "valor_desembolso", "numero_dias_mora",
               "saldo_capital", "saldo_interes", "saldo_seguros", "saldo_cargo_1", "saldo_cargo_2",
               "saldo_cargo_3", "saldo_mora", "valor_canc_capital_intereses_seguros", "tipo_producto",
               "valor_garantia"]
DOUBLE_LEDGER = {"valor_desembolso", "saldo_capital", "saldo_interes", "saldo_seguros", "saldo_cargo_1",
                 "saldo_cargo_2", "saldo_cargo_3", "saldo_mora", "valor_canc_capital_intereses_seguros",
                 "valor_garantia"}


def _ledger_select(alias: str = "") -> str:
    pre = f"{alias}." if alias else ""
    return ", ".join(RND(pre + c, c) if c in DOUBLE_LEDGER else pre + c for c in LEDGER_COLS)


# --- source and stage CTEs ------------------------------------------------------------

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], sql: str) -> None:
    CTES[name] = (deps, sql)


cte("ledger_month", [], f"""
SELECT CAST(CASE WHEN k % 41 = 0 AND q % 6 = 0 THEN NULL ELSE month END AS INTEGER) AS id_fecha,
       CASE WHEN k % 97 = 0 THEN NULL ELSE k END AS credito,
       CAST(CASE WHEN k % 17 = 0 AND q % 4 = 0 THEN NULL
                 WHEN k % 3 = 0 THEN first_ship_key ELSE loan_first END AS INTEGER) AS id_fecha_desembolso,
       valor_desembolso,
       CAST(CASE WHEN q % 31 = 0 THEN NULL WHEN q % 9 = 0 THEN 0 ELSE (q * 7 + c) % 391 END AS INTEGER) AS numero_dias_mora,
       CASE WHEN q % 29 = 0 THEN NULL ELSE capital / (1 + c) END AS saldo_capital,
       CASE WHEN q % 23 = 0 THEN NULL WHEN k % 37 = 0 AND q % 2 = 0 THEN -interes ELSE interes END AS saldo_interes,
       seguros AS saldo_seguros,
       CASE WHEN q % 5 = 0 THEN q * 1.5::DOUBLE ELSE 0 END AS saldo_cargo_1,
       CASE WHEN q % 7 = 0 THEN q * 0.25::DOUBLE ELSE 0 END AS saldo_cargo_2,
       CASE WHEN q % 11 = 0 THEN q * 2.0::DOUBLE ELSE 0 END AS saldo_cargo_3,
       saldo_mora,
       capital / (1 + c) + interes + seguros AS valor_canc_capital_intereses_seguros,
       CAST(CASE WHEN c = 1 AND q % 2 = 1 THEN CASE WHEN product = 10 THEN 70 ELSE 10 END ELSE product END AS INTEGER) AS tipo_producto,
       CAST(q AS DOUBLE) * 100.0 AS valor_garantia
FROM (
  SELECT *, unnest(CASE WHEN k % 13 = 0 THEN [0, 1] ELSE [0] END) AS c,
         min(first_ship_key) OVER (PARTITION BY k) AS loan_first,
         CASE WHEN month < (CASE WHEN k % 4 = 3 THEN 20010531 ELSE 19970131 + 10000 * (k % 4) END)
                   OR (k % 19 = 0 AND month > 20000630) THEN 10
              WHEN k % 5 = 0 THEN 71 ELSE 70 END AS product
  FROM (
    SELECT l_partkey AS k,
           {KEY('last_day(CAST(l_shipdate AS DATE))')} AS month,
           CAST(sum(l_quantity) AS INTEGER) AS q,
           sum(l_extendedprice) AS valor_desembolso,
           sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE 0.0 END) AS capital,
           sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice * l_tax ELSE 0.0 END) AS interes,
           sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice * l_discount ELSE 0.0 END) AS seguros,
           sum(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN l_extendedprice * l_discount
                    ELSE 0.0 END) AS saldo_mora,
           min({KEY('l_shipdate')}) AS first_ship_key
    FROM lineitem GROUP BY 1, 2) g
) m""")

cte("ledger_day", [], """
SELECT CAST(20010701 + p_partkey % 7 AS INTEGER) AS id_fecha, p_partkey AS credito,
       CAST(CASE WHEN p_partkey % 15 = 2 OR p_partkey % 5 = 0 THEN 71 ELSE 70 END AS INTEGER) AS tipo_producto,
       CASE WHEN p_size <= 3 THEN 0.0::DOUBLE ELSE p_retailprice END AS saldo_capital,
       CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_retailprice * 1.1 + c END AS valor_pago_ttl_canc,
       CAST(CASE WHEN p_size % 10 = 0 THEN 0 ELSE 1 END AS INTEGER) AS ind_cierre
FROM (SELECT *, unnest(CASE WHEN p_partkey % 59 = 0 THEN [0, 1] ELSE [0] END) AS c FROM part) p""")

cte("ltv", [], """
SELECT p_partkey AS credito, s.id_fecha,
       CAST(CASE WHEN p_partkey % 5 = 0 THEN 71 ELSE 70 END AS INTEGER) AS tipo_producto,
       CAST(c AS INTEGER) AS conteo_garantias,
       CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size / s.dv END AS "LTV",
       p_retailprice AS valor_garantia_final,
       CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_type END AS libre_inversion_o_vehicular
FROM (SELECT *, unnest(CASE WHEN p_partkey % 53 = 0 THEN [1, 2] ELSE [1] END) AS c FROM part) p,
     (VALUES (20010630, 25.0::DOUBLE), (20010531, 30.0::DOUBLE)) s(id_fecha, dv)""")

cte("restructuring_mark", [], f"""
SELECT o_custkey AS credito, CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE {KEY('o_orderdate')} END AS id_fecha,
       CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'S' WHEN 'P' THEN 'T' END AS marcacion,
       CASE WHEN o_orderkey % 47 = 0 THEN NULL ELSE o_orderkey END AS id_marca
FROM orders""")

cte("collections", [], f"""
SELECT o_custkey AS credito, {KEY('o_orderdate')} AS id_fecha_efe_mov,
       CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 88 ELSE 10 END AS INTEGER) AS cod_trans,
       o_totalprice AS valor_pago_capital
FROM orders""")

cte("purchase_tape", [], """
SELECT credito, suma_importe_base, precio_compra FROM (
  SELECT CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_partkey END AS credito,
         CASE WHEN p_size = 1 THEN 0.0::DOUBLE ELSE p_retailprice END AS suma_importe_base,
         CASE WHEN p_size % 17 = 0 THEN 0.0::DOUBLE ELSE p_retailprice * 0.3 END AS precio_compra
  FROM part) t
WHERE credito IS NOT NULL""")

# rows of one loan and date: ascending, missing values first, in this order of columns
_TIES = ", ".join(f"{c} ASC NULLS FIRST" for c in [
    "id_fecha", "tipo_producto", "id_fecha_desembolso", "numero_dias_mora", "saldo_capital", "saldo_interes", "saldo_seguros",
    "saldo_cargo_1", "saldo_cargo_2", "saldo_cargo_3", "saldo_mora", "valor_desembolso", "valor_canc_capital_intereses_seguros",
    "valor_garantia"])
cte("ledger_seq", ["ledger_month"], f"""
SELECT *, row_number() OVER (PARTITION BY credito ORDER BY {_TIES}) AS orden
FROM ledger_month""")

cte("p70", ["ledger_seq"], "SELECT * FROM ledger_seq WHERE tipo_producto = 70")

cte("p70b", ["p70"], f"""
SELECT *, substr(CAST(id_fecha AS VARCHAR), 5, 2) AS mes, substr(CAST(id_fecha AS VARCHAR), 1, 4) AS anio,
       {BUCKET('numero_dias_mora')} AS icvs
FROM p70""")

cte("daily", ["ledger_day"], f"""
SELECT saldo_capital, tipo_producto, credito, valor_pago_ttl_canc FROM ledger_day
WHERE tipo_producto IN (70, 71) AND saldo_capital > 0 AND id_fecha IN ({WINDOW_KEYS}) AND ind_cierre = 1""")

cte("first_mark", ["restructuring_mark"], """
SELECT credito, CASE WHEN marcacion = 'R' THEN 'Refinanciacion' ELSE 'Reestructuracion' END AS marc_desc
FROM (SELECT *, row_number() OVER (PARTITION BY credito ORDER BY id_fecha NULLS FIRST, id_marca NULLS FIRST, marcacion) AS n
      FROM restructuring_mark WHERE marcacion <> 'S') t
WHERE n = 1""")


def _ltv_snap(where: str) -> str:
    return f"""
SELECT l.credito, l.id_fecha, l.tipo_producto, l.conteo_garantias, l."LTV", l.valor_garantia_final,
       coalesce(l.libre_inversion_o_vehicular, '') AS libre_inversion_o_vehicular,
       coalesce(rr.marc_desc, '') AS marca_refi_restru
FROM ltv l LEFT JOIN first_mark rr ON l.credito = rr.credito
WHERE {where}"""


cte("ltv_snap", ["ltv", "first_mark"], _ltv_snap(f"l.id_fecha IN ({AS_OF_KEY})"))
cte("ltv_snap_v1", ["ltv", "first_mark"], _ltv_snap(f"l.tipo_producto = 70 AND l.id_fecha = {AS_OF_KEY}"))

cte("span", ["p70"], """
SELECT credito,
       CASE WHEN count(*) > count(id_fecha_desembolso) THEN NULL
            ELSE CAST(min(id_fecha_desembolso) AS DOUBLE) END AS Fecha_desembolso,
       CASE WHEN count(*) > count(id_fecha_desembolso) THEN NULL
            ELSE avg(CAST(id_fecha_desembolso AS DOUBLE)) END AS Fecha_desembolso_media,
       CASE WHEN count(*) > count(id_fecha) THEN NULL ELSE min(id_fecha) END AS fecha_inicio_p70,
       CASE WHEN count(*) > count(id_fecha) THEN NULL ELSE max(id_fecha) END AS fecha_vigencia,
       count(*) AS Duracion_p70, min(orden) AS Duracion_p10
FROM p70 GROUP BY credito""")

cte("firsts", ["p70"], """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY credito ORDER BY id_fecha, orden) AS rn FROM p70 WHERE id_fecha IS NOT NULL) t
WHERE rn = 1""")

cte("lasts", ["p70"], """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY credito ORDER BY id_fecha DESC, orden) AS rn FROM p70 WHERE id_fecha IS NOT NULL) t
WHERE rn = 1""")

_first_cols = ", ".join(f"f.{c} AS {c}_inicial" for c in OBS)
_last_cols = ", ".join(f"a.{c} AS {c}_actual" for c in OBS)
cte("bbb", ["span", "firsts", "lasts"], f"""
SELECT s.credito, s.Fecha_desembolso, s.fecha_inicio_p70, s.fecha_vigencia, s.Duracion_p70, s.Duracion_p10,
       {_first_cols}, {_last_cols},
       {EXPOSURE('f.')} AS Saldo_exposicion_inicial, {EXPOSURE('a.')} AS Saldo_exposicion_actual
FROM span s LEFT JOIN firsts f ON s.credito IS NOT DISTINCT FROM f.credito LEFT JOIN lasts a ON s.credito IS NOT DISTINCT FROM a.credito""")

cte("zero", ["bbb"], "SELECT credito FROM bbb WHERE Saldo_exposicion_inicial = 0")

cte("panterior", ["ledger_seq", "zero"], f"""
SELECT credito, capital_ant, saldo_ant FROM (
  SELECT credito, {EXPOSURE()} AS capital_ant, saldo_capital AS saldo_ant,
         row_number() OVER (PARTITION BY credito ORDER BY id_fecha DESC, orden) AS rn
  FROM ledger_seq l WHERE tipo_producto <> 70 AND id_fecha IS NOT NULL
    AND EXISTS (SELECT 1 FROM zero z WHERE z.credito IS NOT DISTINCT FROM l.credito)) t
WHERE rn = 1""")

_BBB_COLS = (["credito", "Fecha_desembolso", "fecha_inicio_p70", "fecha_vigencia", "Duracion_p70",
              "Duracion_p10"] + [f"{c}_inicial" for c in OBS] + [f"{c}_actual" for c in OBS]
             + ["Saldo_exposicion_inicial", "Saldo_exposicion_actual"])


def _adjusted(else_exposure: str) -> str:
    cols = []
    for c in _BBB_COLS:
        if c == "Saldo_exposicion_inicial":
            cols.append(IFELSE(f"{EQ('b.Saldo_exposicion_inicial', '0')} AND b.Duracion_p70 = 1",
                               "p.capital_ant", f"b.{else_exposure}") + f" AS {c}")
        elif c == "saldo_capital_inicial":
            cols.append(IFELSE(f"{EQ('b.saldo_capital_inicial', '0')} AND b.Duracion_p70 = 1",
                               "p.saldo_ant", "b.saldo_capital_inicial") + f" AS {c}")
        else:
            cols.append(f"b.{c}")
    return f"SELECT {', '.join(cols)} FROM bbb b LEFT JOIN panterior p ON b.credito IS NOT DISTINCT FROM p.credito"


cte("adj", ["bbb", "panterior"], _adjusted("Saldo_exposicion_actual"))
cte("adj_initial", ["bbb", "panterior"], _adjusted("Saldo_exposicion_inicial"))

_RATE_BASE = ["credito", "id_fecha_inicial", "id_fecha_actual", "Duracion_p70", "Duracion_p10",
              "saldo_capital_inicial", "saldo_capital_actual", "Saldo_exposicion_inicial",
              "Saldo_exposicion_actual", "saldo_mora_inicial", "saldo_mora_actual"]


def _exposure_rates(src: str) -> str:
    prop = DIV("Saldo_exposicion_inicial - Saldo_exposicion_actual", "Saldo_exposicion_inicial")
    return f"""
SELECT {', '.join(_RATE_BASE)}, {prop} AS prop_recuperado_exposicion,
       {prop} / (Duracion_p70 + 1) * 12 AS tasa_recuperacion_anual
FROM {src}"""


cte("df_saldos", ["adj"], _exposure_rates("adj"))
cte("df_saldos_initial", ["adj_initial"], _exposure_rates("adj_initial"))

_PM = IFELSE(LT("saldo_mora_inicial - saldo_mora_actual", "0"), "0.0",
             DIV("saldo_mora_inicial - saldo_mora_actual", "saldo_mora_inicial"))
_PC = IFELSE(LT("saldo_capital_inicial - saldo_capital_actual", "0"), "0.0",
             DIV("saldo_capital_inicial - saldo_capital_actual", "saldo_capital_inicial"))
cte("df_saldos2_raw", ["adj"], f"""
SELECT {', '.join(_RATE_BASE)},
       {_PM} AS prop_recuperado_mora, {_PM} / (Duracion_p70 + 1) * 12 AS tasa_recuperacion_anual_mora,
       {_PC} AS prop_recuperado_capital, {_PC} / (Duracion_p70 + 1) * 12 AS tasa_recuperacion_anual_capital
FROM adj""")

_M, _C = "tasa_recuperacion_anual_mora", "tasa_recuperacion_anual_capital"
cte("df_saldos2", ["df_saldos2_raw"], f"""
SELECT *,
  CASE WHEN isnan({_M}) THEN {_C}
       WHEN isnan({_C}) THEN {_M}
       WHEN ({_M} = 0 AND {_C} = 0) IS NULL THEN NULL
       WHEN {_M} = 0 AND {_C} = 0 THEN 0.0
       WHEN ({_M} > {_C}) IS NULL THEN NULL
       WHEN {_M} > {_C} THEN {_M} ELSE {_C} END AS tasa_recuperacion_anual
FROM df_saldos2_raw""")

cte("valuation", ["df_saldos", "df_saldos2", "ltv_snap", "daily"], """
SELECT s.credito, s.id_fecha_inicial, s.id_fecha_actual, s.Duracion_p10, s.Duracion_p70,
       s.tasa_recuperacion_anual AS tasa_recuperacion_anual_exp,
       s2.tasa_recuperacion_anual, s2.tasa_recuperacion_anual_capital,
       l."LTV", l.valor_garantia_final, l.libre_inversion_o_vehicular, l.marca_refi_restru,
       d.saldo_capital, d.tipo_producto, d.valor_pago_ttl_canc
FROM df_saldos s
LEFT JOIN df_saldos2 s2 ON s.credito IS NOT DISTINCT FROM s2.credito
LEFT JOIN ltv_snap l ON s.credito IS NOT DISTINCT FROM l.credito
LEFT JOIN daily d ON s.credito IS NOT DISTINCT FROM d.credito""")

cte("valued", ["valuation"], f"""
SELECT *,
  {FACTOR_INV('tasa_recuperacion_anual', '"LTV"', 'Duracion_p70')} AS Valoracion_pd,
  {FACTOR_INV('tasa_recuperacion_anual_exp', '"LTV"', 'Duracion_p70')} AS Valoracion_pd_mod,
  {FACTOR_INV('tasa_recuperacion_anual_capital', '"LTV"', 'Duracion_p70')} AS Valoracion_pd_cap
FROM valuation""")

_VALUED_COLS = ["id_fecha_inicial", "id_fecha_actual", "Duracion_p10", "Duracion_p70",
                "tasa_recuperacion_anual_exp", "tasa_recuperacion_anual", "tasa_recuperacion_anual_capital",
                '"LTV"', "valor_garantia_final", "libre_inversion_o_vehicular", "marca_refi_restru",
                "saldo_capital", "tipo_producto", "valor_pago_ttl_canc", "Valoracion_pd", "Valoracion_pd_mod",
                "Valoracion_pd_cap"]
cte("priced", ["purchase_tape", "valued"], f"""
SELECT t.credito, t.suma_importe_base AS saldo_actual, t.precio_compra,
       {', '.join('v.' + c for c in _VALUED_COLS)},
       t.precio_compra * v.Valoracion_pd AS Precio_y_valoracion,
       t.precio_compra * v.Valoracion_pd_mod AS Precio_y_valoracion_mod,
       t.precio_compra * v.Valoracion_pd_cap AS Precio_y_valoracion_capital
FROM purchase_tape t LEFT JOIN valued v ON t.credito = v.credito""")

cte("active", ["priced"], f"SELECT * FROM priced WHERE NOT {ISNA('valor_pago_ttl_canc')}")
cte("inactive", ["priced"], f"SELECT * FROM priced WHERE {ISNA('valor_pago_ttl_canc')}")

cte("summary", ["active"], f"""
SELECT tipo_producto, Creditos, Deuda_total, Saldo_a_capital, Precio_de_compra, Valoracion, Valoracion_mod,
       Valoracion_capital,
       {DIV('Valoracion', 'Precio_de_compra')} - 1 AS p,
       {DIV('Valoracion_mod', 'Precio_de_compra')} - 1 AS p_mod,
       {DIV('Valoracion_capital', 'Precio_de_compra')} - 1 AS p_cap
FROM (SELECT tipo_producto, count(*) AS Creditos,
             {NANSUM('valor_pago_ttl_canc')} AS Deuda_total,
             {NANSUM('saldo_actual')} AS Saldo_a_capital,
             {NANSUM('precio_compra')} AS Precio_de_compra,
             {NANSUM('Precio_y_valoracion')} AS Valoracion,
             {NANSUM('Precio_y_valoracion_mod')} AS Valoracion_mod,
             {NANSUM('Precio_y_valoracion_capital')} AS Valoracion_capital
      FROM active WHERE saldo_actual > 0.0001 GROUP BY tipo_producto) g""")


def _residual(src: str) -> str:
    return f"""
SELECT credito, valor_pago_ttl_canc, saldo_actual, precio_compra, Precio_y_valoracion
FROM {src} WHERE saldo_actual > 0.0001"""


def _residual_summary(src: str) -> str:
    return f"""
SELECT Creditos, Deuda_total, Saldo_a_capital, Precio_de_compra, Valoracion,
       {DIV('Valoracion', 'Precio_de_compra')} - 1 AS p
FROM (SELECT count(*) AS Creditos, {NANSUM('valor_pago_ttl_canc')} AS Deuda_total,
             {NANSUM('saldo_actual')} AS Saldo_a_capital, {NANSUM('precio_compra')} AS Precio_de_compra,
             {NANSUM('Precio_y_valoracion')} AS Valoracion
      FROM {src}) g"""


cte("residual", ["inactive"], _residual("inactive"))
cte("residual_summary", ["residual"], _residual_summary("residual"))

_VG = f"{DIV('Precio_y_valoracion_mod', 'precio_compra')} - 1"
cte("live70", ["active"], f"""
SELECT credito, saldo_actual AS saldo_a_capital, precio_compra AS compra, Precio_y_valoracion,
       Precio_y_valoracion_capital,
       CASE WHEN {ISNA(_VG)} THEN 0.0 ELSE {_VG} END AS valoracion_con_garantia
FROM active WHERE tipo_producto = 70""")

cte("live71", ["active"], """
SELECT credito, saldo_actual AS saldo_a_capital, precio_compra AS compra, 0.0::DOUBLE AS valoracion_con_garantia
FROM active WHERE tipo_producto = 71""")

# --- older pair (extract + report) ---
cte("cap_v1", ["span", "firsts", "lasts"], """
SELECT s.credito, s.Fecha_desembolso_media AS Fecha_desembolso, s.fecha_inicio_p70, s.fecha_vigencia,
       s.Duracion_p70, s.Duracion_p10, f.saldo_capital AS Saldo_capital_inicial,
       a.saldo_capital AS Saldo_capital_final, a.numero_dias_mora AS dias_mora_actual
FROM span s LEFT JOIN firsts f ON s.credito IS NOT DISTINCT FROM f.credito LEFT JOIN lasts a ON s.credito IS NOT DISTINCT FROM a.credito""")

cte("last_two", ["ledger_seq", "cap_v1"], """
SELECT l.credito, l.saldo_capital AS capital_ant
FROM ledger_seq l JOIN (
  SELECT credito, min(orden) FILTER (WHERE id_fecha = max_fecha) AS wm
  FROM (SELECT credito, id_fecha, orden, max(id_fecha) OVER (PARTITION BY credito) AS max_fecha
        FROM ledger_seq q
        WHERE EXISTS (SELECT 1 FROM cap_v1 z WHERE z.Saldo_capital_inicial = 0 AND z.credito IS NOT DISTINCT FROM q.credito)) t
  GROUP BY credito) w ON l.credito IS NOT DISTINCT FROM w.credito
WHERE l.orden BETWEEN w.wm - 1 AND w.wm AND l.tipo_producto <> 70""")

cte("adj_v1", ["cap_v1", "last_two"], f"""
SELECT c.credito, c.Fecha_desembolso, c.fecha_inicio_p70, c.fecha_vigencia, c.Duracion_p70, c.Duracion_p10,
       {IFELSE(EQ('c.Saldo_capital_inicial', '0') + ' AND c.Duracion_p70 = 1', 'p.capital_ant',
               'c.Saldo_capital_inicial')} AS Saldo_capital_inicial,
       c.Saldo_capital_final, c.dias_mora_actual
FROM cap_v1 c LEFT JOIN last_two p ON c.credito IS NOT DISTINCT FROM p.credito""")

_PV1 = IFELSE(LT("Saldo_capital_inicial - Saldo_capital_final", "0"), "0.0",
              DIV("Saldo_capital_inicial - Saldo_capital_final", "Saldo_capital_inicial"))
cte("valoracion_v1", ["adj_v1"], f"""
SELECT *, {_PV1} AS prop_recuperado, {_PV1} / (Duracion_p70 + 1) * 12 AS tasa_recuperacion_anual
FROM adj_v1""")

cte("extract_v1", ["valoracion_v1", "daily", "ltv_snap_v1"], f"""
SELECT v.*, d.saldo_capital, d.tipo_producto, d.valor_pago_ttl_canc,
       l."LTV", l.valor_garantia_final, l.libre_inversion_o_vehicular, l.marca_refi_restru,
       {FACTOR_DIRECT('v.tasa_recuperacion_anual', 'l."LTV"', 'v.Duracion_p70')} AS Valoracion_pd
FROM valoracion_v1 v LEFT JOIN daily d ON v.credito IS NOT DISTINCT FROM d.credito LEFT JOIN ltv_snap_v1 l ON v.credito IS NOT DISTINCT FROM l.credito""")

cte("extract_mod", ["extract_v1"], f"""
SELECT *, {FACTOR_INV('tasa_recuperacion_anual', '"LTV"', 'Duracion_p10')} AS Valoracion_pd_mod
FROM extract_v1""")

_EXTRACT_COLS = ["Fecha_desembolso", "fecha_inicio_p70", "fecha_vigencia", "Duracion_p70", "Duracion_p10",
                 "Saldo_capital_inicial", "Saldo_capital_final", "dias_mora_actual", "prop_recuperado",
                 "tasa_recuperacion_anual", "saldo_capital", "tipo_producto", "valor_pago_ttl_canc", '"LTV"',
                 "valor_garantia_final", "libre_inversion_o_vehicular", "marca_refi_restru", "Valoracion_pd",
                 "Valoracion_pd_mod"]
cte("priced_v1", ["purchase_tape", "extract_mod"], f"""
SELECT t.credito, t.suma_importe_base AS saldo_actual, t.precio_compra,
       {', '.join('e.' + c for c in _EXTRACT_COLS)},
       t.precio_compra * e.Valoracion_pd AS Precio_y_valoracion,
       t.precio_compra * e.Valoracion_pd_mod AS Precio_y_valoracion_mod
FROM (SELECT * FROM purchase_tape WHERE suma_importe_base > 0.0001) t
LEFT JOIN extract_mod e ON t.credito = e.credito""")

cte("active_v1", ["priced_v1"], f"SELECT * FROM priced_v1 WHERE NOT {ISNA('valor_pago_ttl_canc')}")
cte("inactive_v1", ["priced_v1"], f"SELECT * FROM priced_v1 WHERE {ISNA('valor_pago_ttl_canc')}")
cte("residual_v1", ["inactive_v1"], _residual("inactive_v1"))

# --- roll rates ---
# a loan with several rows in a month counts once: by its latest date there, then by the lowest number
for _t, _range in (("t0", T0), ("t1", T1)):
    cte(_t, ["p70b"], f"""
SELECT credito, icvs, anio, mes FROM p70b WHERE id_fecha BETWEEN {_range[0]} AND {_range[1]}
QUALIFY row_number() OVER (PARTITION BY credito ORDER BY id_fecha DESC, orden) = 1""")
cte("pairs", ["t0", "t1"], """
SELECT t0.credito, t0.icvs AS b0, t1.icvs AS b1 FROM t0 JOIN t1 ON t0.credito IS NOT DISTINCT FROM t1.credito
WHERE t0.icvs IS NOT NULL AND t1.icvs IS NOT NULL""")
_BUCKET_VALUES = ", ".join(f"({i}, '{b}')" for i, b in enumerate(BUCKETS, 1))
_UNIT_COLS = ", ".join(f"count(p.b1) FILTER (WHERE p.b1 = '{b}') AS \"{b}\"" for b in BUCKETS)
cte("units", ["pairs"], f"""
SELECT g.bucket AS bucket_from, {_UNIT_COLS}
FROM (VALUES {_BUCKET_VALUES}) g(ord, bucket) LEFT JOIN pairs p ON p.b0 = g.bucket
GROUP BY g.ord, g.bucket""")
_ROW_TOTAL = " + ".join(f'"{b}"' for b in BUCKETS)
cte("share", ["units"], f"""
SELECT bucket_from, {', '.join(DIV(f'"{b}"', _ROW_TOTAL) + f' AS "{b}"' for b in BUCKETS)} FROM units""")


def _resolve(names: list[str]) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return order


def with_ctes(needs: list[str], body: str) -> str:
    names = _resolve(needs)
    parts = ",\n".join(f"{n} AS ({CTES[n][1]}\n)" for n in names)
    return f"WITH {parts}\n{body}"


def _select_rounded(cols: list[str], doubles: set[str], src: str, where: str = "") -> str:
    out = [RND(f'"{c}"', c) if c in doubles else f'"{c}"' for c in cols]
    return f"SELECT {', '.join(out)} FROM {src}" + (f" WHERE {where}" if where else "")


# --- registered queries ---------------------------------------------------------------------

_D_BBB = {c for c in _BBB_COLS if c.startswith(("saldo_", "Saldo_", "Fecha_desembolso"))}
_D_RATE = {"saldo_capital_inicial", "saldo_capital_actual", "Saldo_exposicion_inicial",
           "Saldo_exposicion_actual", "saldo_mora_inicial", "saldo_mora_actual",
           "prop_recuperado_exposicion", "tasa_recuperacion_anual", "prop_recuperado_mora",
           "tasa_recuperacion_anual_mora", "prop_recuperado_capital", "tasa_recuperacion_anual_capital"}
_D_VALUED = {"tasa_recuperacion_anual_exp", "tasa_recuperacion_anual", "tasa_recuperacion_anual_capital", "LTV",
             "valor_garantia_final", "saldo_capital", "valor_pago_ttl_canc", "Valoracion_pd",
             "Valoracion_pd_mod", "Valoracion_pd_cap"}
_PRICED_COLS = (["credito", "saldo_actual", "precio_compra"] + [c.strip('"') for c in _VALUED_COLS]
                + ["Precio_y_valoracion", "Precio_y_valoracion_mod", "Precio_y_valoracion_capital"])
_D_PRICED = _D_VALUED | {"saldo_actual", "precio_compra", "Precio_y_valoracion", "Precio_y_valoracion_mod",
                         "Precio_y_valoracion_capital"}
_EXTRACT_OUT = (["credito"] + [c.strip('"') for c in _EXTRACT_COLS[:-1]])
_D_EXTRACT = {"Fecha_desembolso", "Saldo_capital_inicial", "Saldo_capital_final", "prop_recuperado",
              "tasa_recuperacion_anual", "saldo_capital", "valor_pago_ttl_canc", "LTV",
              "valor_garantia_final", "Valoracion_pd", "Valoracion_pd_mod"}
_PRICED_V1_COLS = (["credito", "saldo_actual", "precio_compra"] + [c.strip('"') for c in _EXTRACT_COLS]
                   + ["Precio_y_valoracion", "Precio_y_valoracion_mod"])
_D_PRICED_V1 = _D_EXTRACT | {"saldo_actual", "precio_compra", "Precio_y_valoracion", "Precio_y_valoracion_mod"}
_SUMMARY_COLS = ["tipo_producto", "Creditos", "Deuda_total", "Saldo_a_capital", "Precio_de_compra", "Valoracion",
                 "Valoracion_mod", "Valoracion_capital", "p", "p_mod", "p_cap"]
_D_SUMMARY = set(_SUMMARY_COLS) - {"tipo_producto", "Creditos"}
_RES_COLS = ["credito", "valor_pago_ttl_canc", "saldo_actual", "precio_compra", "Precio_y_valoracion"]
_RES_SUM_COLS = ["Creditos", "Deuda_total", "Saldo_a_capital", "Precio_de_compra", "Valoracion", "p"]


def _q(needs: list[str], cols: list[str], doubles: set[str], src: str, where: str = "") -> str:
    return with_ctes(needs, _select_rounded(cols, doubles, src, where))


def _ledger_query(src_cte: str, src: str, where: str = "") -> str:
    return with_ctes([src_cte], f"SELECT {_ledger_select()}, orden FROM {src}" + (f" WHERE {where}" if where else ""))


def _calendar_dates() -> str:
    return "(SELECT DISTINCT id_fecha, strptime(CAST(id_fecha AS VARCHAR), '%Y%m%d')::DATE AS d FROM ledger_month WHERE id_fecha IS NOT NULL) r"


ORACLE: dict[str, str] = {}

ORACLE["ledger_sequence"] = _ledger_query("ledger_seq", "ledger_seq")
ORACLE["daily_closing_snapshot"] = _q(["daily"], ["saldo_capital", "tipo_producto", "credito", "valor_pago_ttl_canc"],
                                      {"saldo_capital", "valor_pago_ttl_canc"}, "daily")
_LTV_SNAP_COLS = ["credito", "id_fecha", "tipo_producto", "conteo_garantias", "LTV", "valor_garantia_final",
                  "libre_inversion_o_vehicular", "marca_refi_restru"]
ORACLE["ltv_snapshot"] = _q(["ltv_snap"], _LTV_SNAP_COLS, {"LTV", "valor_garantia_final"}, "ltv_snap")
ORACLE["ltv_snapshot_product"] = _q(["ltv_snap_v1"], _LTV_SNAP_COLS, {"LTV", "valor_garantia_final"},
                                    "ltv_snap_v1", f"id_fecha = {AS_OF_KEY}")
ORACLE["first_restructuring_mark"] = with_ctes(["first_mark"], "SELECT credito, marc_desc FROM first_mark")
ORACLE["purchase_tape"] = _q(["purchase_tape"], ["credito", "suma_importe_base", "precio_compra"],
                             {"suma_importe_base", "precio_compra"}, "purchase_tape")
ORACLE["csv2_roundtrip"] = _q(["extract_v1"], _EXTRACT_OUT, _D_EXTRACT, "extract_v1")
ORACLE["csv2_roundtrip"] = f"""SELECT * REPLACE (
  NULLIF(libre_inversion_o_vehicular, '') AS libre_inversion_o_vehicular,
  NULLIF(marca_refi_restru, '') AS marca_refi_restru)
FROM ({ORACLE["csv2_roundtrip"]}) x"""
ORACLE["latest_extract"] = ORACLE["csv2_roundtrip"]

ORACLE["product_slice"] = with_ctes(["p70b"], f"SELECT {_ledger_select()}, orden, mes, anio FROM p70b")
ORACLE["year_month_parts"] = with_ctes(["p70b"], "SELECT credito, id_fecha, anio, mes FROM p70b")
ORACLE["exposure"] = with_ctes(["ledger_seq"], f"""
SELECT credito, id_fecha, tipo_producto, round({EXPOSURE()}, 6) AS saldo_exposicion FROM ledger_seq""")
cte("bad_loans", ["ledger_month"], "SELECT DISTINCT credito FROM ledger_month WHERE saldo_capital IS NULL OR saldo_interes < 0")
ORACLE["exclude_loans"] = with_ctes(["ledger_seq", "bad_loans"], f"""
SELECT {_ledger_select()}, orden FROM ledger_seq
WHERE CASE WHEN credito IS NULL THEN (SELECT count(*) FROM bad_loans WHERE credito IS NULL) = 0
           ELSE credito NOT IN (SELECT credito FROM bad_loans WHERE credito IS NOT NULL) END""")

ORACLE["loan_span"] = _q(["span"], ["credito", "Fecha_desembolso", "fecha_inicio_p70", "fecha_vigencia",
                                    "Duracion_p70", "Duracion_p10"], {"Fecha_desembolso"}, "span")
ORACLE["loan_span_mean"] = with_ctes(["span"], """
SELECT credito, round(Fecha_desembolso_media, 6) AS Fecha_desembolso, fecha_inicio_p70, fecha_vigencia,
       Duracion_p70, Duracion_p10 FROM span""")
_FL_COLS = ["credito"] + [f"{c}_inicial" for c in OBS] + [f"{c}_actual" for c in OBS]
ORACLE["first_last_observation"] = _q(["bbb"], _FL_COLS, _D_BBB, "bbb")
ORACLE["first_last_capital"] = with_ctes(["bbb"], """
SELECT credito, round(saldo_capital_inicial, 6) AS Saldo_capital_inicial,
       round(saldo_capital_actual, 6) AS Saldo_capital_final, numero_dias_mora_actual AS dias_mora_actual
FROM bbb""")
ORACLE["recovery_base"] = _q(["bbb"], _BBB_COLS, _D_BBB, "bbb")
ORACLE["zero_start_loans"] = _q(["bbb"], _BBB_COLS, _D_BBB, "bbb", "Saldo_exposicion_inicial = 0")
ORACLE["zero_start_history"] = _ledger_query("zero", "ledger_seq", "EXISTS (SELECT 1 FROM zero z WHERE z.credito IS NOT DISTINCT FROM ledger_seq.credito)")
ORACLE["prior_product_balance"] = _q(["panterior"], ["credito", "capital_ant", "saldo_ant"],
                                     {"capital_ant", "saldo_ant"}, "panterior")
ORACLE["last_two_non70"] = _q(["last_two"], ["credito", "capital_ant"], {"capital_ant"}, "last_two")
ORACLE["adjusted_recovery_base"] = _q(["adj"], _BBB_COLS, _D_BBB, "adj")
_ADJ_V1_COLS = ["credito", "Fecha_desembolso", "fecha_inicio_p70", "fecha_vigencia", "Duracion_p70",
                "Duracion_p10", "Saldo_capital_inicial", "Saldo_capital_final", "dias_mora_actual"]
ORACLE["adjusted_capital_v1"] = _q(["adj_v1"], _ADJ_V1_COLS,
                                   {"Fecha_desembolso", "Saldo_capital_inicial", "Saldo_capital_final"}, "adj_v1")

for _key in ("recovery_base", "prior_product_balance", "adjusted_capital_v1"):
    ORACLE[{"recovery_base": "recovery_base_by_month", "prior_product_balance": "prior_balance_by_month"}.get(_key, "adjusted_capital_by_month")] = ORACLE[_key]

_EXP_COLS = _RATE_BASE + ["prop_recuperado_exposicion", "tasa_recuperacion_anual"]
ORACLE["recovery_rate_exposure"] = _q(["df_saldos"], _EXP_COLS, _D_RATE, "df_saldos")
ORACLE["recovery_rate_exposure_initial"] = _q(["df_saldos_initial"], _EXP_COLS, _D_RATE, "df_saldos_initial")
ORACLE["recovery_rate_arrears"] = _q(["df_saldos2"], ["credito", "Duracion_p70", "saldo_mora_inicial",
                                                      "saldo_mora_actual", "prop_recuperado_mora",
                                                      "tasa_recuperacion_anual_mora"], _D_RATE, "df_saldos2")
ORACLE["recovery_rate_capital"] = _q(["df_saldos2"], ["credito", "Duracion_p70", "saldo_capital_inicial",
                                                      "saldo_capital_actual", "prop_recuperado_capital",
                                                      "tasa_recuperacion_anual_capital"], _D_RATE, "df_saldos2")
ORACLE["recovery_rate_combined"] = _q(["df_saldos2"], _RATE_BASE + [
    "prop_recuperado_mora", "tasa_recuperacion_anual_mora", "prop_recuperado_capital",
    "tasa_recuperacion_anual_capital", "tasa_recuperacion_anual"], _D_RATE, "df_saldos2")

_VALUATION_COLS = ["credito"] + [c.strip('"') for c in _VALUED_COLS[:-3]]
ORACLE["valuation_table"] = _q(["valuation"], _VALUATION_COLS, _D_VALUED, "valuation")
for _key, _rate, _factor in [("price_factor_combined", "tasa_recuperacion_anual", "Valoracion_pd"),
                             ("price_factor_exposure", "tasa_recuperacion_anual_exp", "Valoracion_pd_mod"),
                             ("price_factor_capital", "tasa_recuperacion_anual_capital", "Valoracion_pd_cap")]:
    ORACLE[_key] = _q(["valued"], ["credito", "Duracion_p70", "LTV", _rate, _factor], _D_VALUED, "valued")
ORACLE["price_factor_origin_duration"] = _q(["extract_mod"], ["credito", "Duracion_p10", "LTV",
                                                              "tasa_recuperacion_anual", "Valoracion_pd_mod"],
                                            _D_EXTRACT, "extract_mod")
ORACLE["price_factor_direct"] = _q(["extract_v1"], _EXTRACT_OUT, _D_EXTRACT, "extract_v1")
ORACLE["ltv_change"] = with_ctes(["extract_v1", "ltv"], f"""
SELECT e.credito, round(e.Saldo_capital_inicial, 6) AS Saldo_capital_inicial,
       round(e.Saldo_capital_final, 6) AS Saldo_capital_final, round(e.saldo_capital, 6) AS saldo_capital,
       round(e.tasa_recuperacion_anual, 6) AS tasa_recuperacion_anual, round(e."LTV", 6) AS "LTV",
       round(p."LTV", 6) AS "LTV_ant", round(e.valor_garantia_final, 6) AS valor_garantia_final,
       round(p.valor_garantia_final, 6) AS garantia_anterior
FROM extract_v1 e LEFT JOIN (SELECT * FROM ltv WHERE id_fecha = {PRIOR_KEY}) p ON e.credito IS NOT DISTINCT FROM p.credito""")

ORACLE["priced_portfolio"] = _q(["priced"], _PRICED_COLS, _D_PRICED, "priced")
ORACLE["priced_portfolio_v1"] = _q(["priced_v1"], _PRICED_V1_COLS, _D_PRICED_V1, "priced_v1")
ORACLE["active_loans"] = _q(["active"], _PRICED_COLS, _D_PRICED, "active")
ORACLE["inactive_loans"] = _q(["inactive"], _PRICED_COLS, _D_PRICED, "inactive")
ORACLE["portfolio_summary"] = _q(["summary"], _SUMMARY_COLS, _D_SUMMARY, "summary")
ORACLE["portfolio_summary_v1"] = with_ctes(["active_v1"], f"""
SELECT tipo_producto, Creditos, {", ".join(RND(c) for c in ("Deuda_total", "Saldo_a_capital", "Precio_de_compra", "Valoracion", "Valoracion_mod"))},
       round({DIV('Valoracion', 'Precio_de_compra')} - 1, 6) AS p,
       round({DIV('Valoracion_mod', 'Precio_de_compra')} - 1, 6) AS p_mod
FROM (SELECT tipo_producto, count(*) AS Creditos, {NANSUM('valor_pago_ttl_canc')} AS Deuda_total,
             {NANSUM('saldo_actual')} AS Saldo_a_capital, {NANSUM('precio_compra')} AS Precio_de_compra,
             {NANSUM('Precio_y_valoracion')} AS Valoracion, {NANSUM('Precio_y_valoracion_mod')} AS Valoracion_mod
      FROM active_v1 WHERE saldo_actual > 0.0001 GROUP BY tipo_producto) g""")
ORACLE["residual_loans"] = _q(["residual"], _RES_COLS, set(_RES_COLS) - {"credito"}, "residual")
ORACLE["residual_summary"] = _q(["residual_summary"], _RES_SUM_COLS, set(_RES_SUM_COLS) - {"Creditos"},
                                "residual_summary")
ORACLE["residual_summary_v1"] = with_ctes(["residual_v1"], _select_rounded(
    _RES_SUM_COLS, set(_RES_SUM_COLS) - {"Creditos"}, f"({_residual_summary('residual_v1')}) s"))
_LIVE70_COLS = ["credito", "saldo_a_capital", "compra", "Precio_y_valoracion", "Precio_y_valoracion_capital",
                "valoracion_con_garantia"]
ORACLE["live_product_70"] = _q(["live70"], _LIVE70_COLS, set(_LIVE70_COLS) - {"credito"}, "live70")
ORACLE["live_product_70_v1"] = with_ctes(["active_v1"], f"""
SELECT credito, round(saldo_actual, 6) AS saldo_a_capital, round(precio_compra, 6) AS compra,
       round(CASE WHEN {ISNA(_VG)} THEN 0.0 ELSE {_VG} END, 6) AS valoracion_con_garantia
FROM active_v1 WHERE tipo_producto = 70""")
_LIVE71_COLS = ["credito", "saldo_a_capital", "compra", "valoracion_con_garantia"]
ORACLE["live_product_71"] = _q(["live71"], _LIVE71_COLS, set(_LIVE71_COLS) - {"credito"}, "live71")
ORACLE["live_product_71_v1"] = with_ctes(["inactive_v1"], """
SELECT credito, round(saldo_actual, 6) AS saldo_a_capital, round(precio_compra, 6) AS compra,
       0.0::DOUBLE AS valoracion_con_garantia
FROM inactive_v1 WHERE tipo_producto = 71""")
ORACLE["report_bundle_counts"] = with_ctes(["purchase_tape", "summary", "residual", "live70", "live71"], """
SELECT 'Cartera' AS hoja, count(*) AS filas FROM purchase_tape
UNION ALL SELECT 'Resumen', count(*) FROM summary
UNION ALL SELECT 'residuo', count(*) FROM residual
UNION ALL SELECT 'Vigentes_70', count(*) FROM live70
UNION ALL SELECT 'Vigentes_71', count(*) FROM live71""")

_MONTHS_SQL = ", ".join(f"'{m}'" for m in [
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
    "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre"])
ORACLE["calendar_keys"] = with_ctes(["ledger_month"], f"""
SELECT id_fecha, {KEY("date_trunc('month', d) - INTERVAL 1 DAY")} AS fecha_actual,
       array_to_string(list_transform(
           generate_series(CAST(date_trunc('month', d) AS TIMESTAMP),
                           CAST(date_trunc('month', d) AS TIMESTAMP) + INTERVAL 4 DAY, INTERVAL 1 DAY),
           lambda x: strftime(x, '%Y%m%d')), ',') AS fechas_cierre
FROM {_calendar_dates()}""")
ORACLE["previous_month_name"] = with_ctes(["ledger_month"], f"""
SELECT id_fecha, [{_MONTHS_SQL}][month(date_trunc('month', d) - INTERVAL 1 DAY)] AS nombre_mes
FROM {_calendar_dates()}""")

ORACLE["month_ends_of_year"] = with_ctes(["ledger_month"], f"""
, by_month AS (SELECT id_fecha, count(*) AS filas FROM ledger_month WHERE id_fecha IS NOT NULL GROUP BY id_fecha),
ends AS (
  SELECT anio, numero, {KEY("last_day(make_date(anio, numero, 1))")} AS id_fecha
  FROM (SELECT DISTINCT (id_fecha // 10000)::BIGINT AS anio FROM by_month), (SELECT unnest(range(1, 13)) AS numero))
SELECT anio::INTEGER AS anio, numero::INTEGER AS numero, e.id_fecha, [{_MONTHS_SQL}][numero] AS nombre, coalesce(filas, 0) AS filas
FROM ends e LEFT JOIN by_month m ON e.id_fecha = m.id_fecha""")
ORACLE["default_report_dates"] = with_ctes(["ledger_month"], f"""
, d AS (SELECT date_trunc('month', current_date)::DATE AS first)
SELECT {KEY("first - INTERVAL 1 DAY")} AS fecha_actual,
       array_to_string(list_transform(range(0, 5), lambda x: strftime(first + CAST(x AS INTEGER), '%Y%m%d')), ',') AS fechas_cierre,
       strftime(first - INTERVAL 2 MONTH, '%Y%m') AS mes_t0, strftime(first - INTERVAL 1 MONTH, '%Y%m') AS mes_t1,
       (SELECT count(*) FROM ledger_month WHERE id_fecha <= {KEY("first - INTERVAL 1 DAY")}) AS filas
FROM d""")
ORACLE["fan_out_check"] = with_ctes(["priced", "df_saldos"], """
, n AS (
  SELECT (SELECT count(*) FROM df_saldos) AS rates,
         (SELECT count(*) FROM df_saldos s LEFT JOIN ltv_snap l ON s.credito IS NOT DISTINCT FROM l.credito) AS ltv,
         (SELECT count(*) FROM valuation) AS daily, (SELECT count(*) FROM purchase_tape) AS tape, (SELECT count(*) FROM priced) AS priced)
SELECT lado, antes AS filas_antes, despues AS filas_despues, despues - antes AS filas_de_mas
FROM (SELECT unnest(['ltv', 'daily', 'valuation']) AS lado, unnest([rates, ltv, tape]) AS antes, unnest([ltv, daily, priced]) AS despues FROM n)""")
ORACLE["jdbc_split_ranges"] = with_ctes(["ledger_month"], """
, dates AS (SELECT id_fecha, count(*) AS n FROM ledger_month GROUP BY id_fecha),
placed AS (
  SELECT *, ((2 * sum(n) OVER (ORDER BY id_fecha) - n) * 8 // (2 * sum(n) OVER ()))::BIGINT AS parte FROM dates WHERE id_fecha IS NOT NULL)
SELECT parte, min(id_fecha) AS desde, max(id_fecha) AS hasta, sum(n)::BIGINT AS filas FROM placed GROUP BY parte
UNION ALL SELECT -1, NULL, NULL, n FROM dates WHERE id_fecha IS NULL""")

ORACLE["dpd_bucket"] = with_ctes(["p70b"], "SELECT credito, id_fecha, anio, mes, numero_dias_mora, icvs FROM p70b")
_SHARE_PIVOT = ", ".join(f"round(max(p) FILTER (WHERE icvs = '{b}'), 6) AS \"{b}\"" for b in SHARE_BUCKETS)
ORACLE["bucket_share_history"] = with_ctes(["p70b"], f"""
, by_bucket AS (
  SELECT anio, mes, icvs,
         CASE WHEN count(*) > count(saldo_capital) THEN NULL ELSE {EXACT('saldo_capital')} END AS n
  FROM p70b GROUP BY anio, mes, icvs),
shares AS (
  SELECT anio, mes, icvs,
         {DIV('n', 'tot')} AS p
  FROM (SELECT *, CASE WHEN count(*) OVER w > count(n) OVER w THEN NULL ELSE sum(n) OVER w END AS tot
        FROM by_bucket WINDOW w AS (PARTITION BY anio, mes)) x)
SELECT anio, mes, {_SHARE_PIVOT} FROM shares GROUP BY anio, mes""")
_ONE_HOT = "SELECT anio, mes, credito, " + ", ".join(f"CASE WHEN icvs = '{b}' THEN 1 ELSE 0 END AS \"{b}\"" for b in BUCKETS)
ORACLE["bucket_one_hot"] = with_ctes(["t0", "t1"], f"{_ONE_HOT} FROM (SELECT * FROM t0 UNION ALL SELECT * FROM t1) m")
ORACLE["bucket_one_hot_common"] = with_ctes(["t0", "t1"], f"""
, common AS (SELECT credito FROM t0 INTERSECT SELECT credito FROM t1)
{_ONE_HOT} FROM (SELECT * FROM t0 UNION ALL SELECT * FROM t1) m
WHERE CASE WHEN credito IS NULL THEN (SELECT count(*) FROM common WHERE credito IS NULL) > 0
           ELSE credito IN (SELECT credito FROM common WHERE credito IS NOT NULL) END""")
ORACLE["common_loans"] = with_ctes(["t0", "t1"], "SELECT credito FROM t1 INTERSECT SELECT credito FROM t0")
ORACLE["roll_matrix_units"] = with_ctes(["units"], "SELECT * FROM units")
ORACLE["roll_matrix_share"] = with_ctes(["share"], "SELECT bucket_from, " + ", ".join(
    f"round(\"{b}\", 6) AS \"{b}\"" for b in BUCKETS) + " FROM share")
ORACLE["roll_matrix_check"] = with_ctes(["share"], f"SELECT bucket_from, round({_ROW_TOTAL}, 6) AS row_sum FROM share")
ORACLE["collections_flag"] = with_ctes(["p70", "collections"], f"""
, cod88 AS (SELECT DISTINCT credito, cod_trans FROM collections WHERE cod_trans = 88)
SELECT {_ledger_select('p')}, p.orden, c.cod_trans,
       substr(CAST(p.id_fecha AS VARCHAR), 5, 2) AS mes, substr(CAST(p.id_fecha AS VARCHAR), 1, 4) AS anio
FROM p70 p LEFT JOIN cod88 c ON p.credito IS NOT DISTINCT FROM c.credito""")


ORACLE["report_bundle_written"] = ORACLE["report_bundle_counts"]
ORACLE["bucket_share_written"] = ORACLE["bucket_share_history"]
ORACLE["roll_matrices_written"] = with_ctes(["share"], "SELECT u.bucket_from, " + ", ".join(
    f'u."{b}" AS "n_{b}", round(s."{b}", 6) AS "{b}"' for b in BUCKETS) + " FROM units u JOIN share s ON u.bucket_from = s.bucket_from")
ORACLE["purchase_tape_csv"] = ORACLE["purchase_tape"]
ORACLE["ledger_wide"] = with_ctes(["ledger_month"], f"""
SELECT {_ledger_select()}, CASE WHEN credito % 3 = 0 THEN 'NIT' ELSE 'CC' END AS tipo_id_deudor,
       id_fecha_desembolso + 1 AS id_fecha_primera_factura, round(saldo_capital * 0.5, 6) AS base_de_provision,
       round(saldo_capital + saldo_mora, 6) AS total_deuda FROM ledger_month""")


# Integer columns that can hold gaps, shown as doubles in every query (as in the registry's presentation).
KEYS_AS_DOUBLES = ("credito", "id_fecha", "id_fecha_desembolso", "id_fecha_primera_factura", "id_fecha_inicial", "id_fecha_actual",
                   "fecha_inicio_p70", "fecha_vigencia", "Duracion_p70", "Duracion_p10", "numero_dias_mora",
                   "numero_dias_mora_inicial", "numero_dias_mora_actual", "dias_mora_actual", "tipo_producto", "cod_trans", "desde", "hasta")
WITHOUT_KEYS = ("fan_out_check", "default_report_dates", "residual_summary", "residual_summary_v1", "report_bundle_counts", "report_bundle_written", "bucket_share_history",
                "bucket_share_written", "roll_matrix_units", "roll_matrix_share", "roll_matrix_check", "roll_matrices_written")


def _as_double(sql: str) -> str:
    keys, names = "|".join(KEYS_AS_DOUBLES), ", ".join(f"'{c}'" for c in KEYS_AS_DOUBLES)
    rest = "" if sql is ORACLE["common_loans"] else f", COLUMNS([c FOR c IN * IF c NOT IN ({names})])"
    return f"""SELECT COLUMNS('^({keys})$')::DOUBLE AS "\\0"{rest} FROM (\n{sql}\n) q"""


def oracle_sql() -> dict[str, str]:
    return {k: v if k in WITHOUT_KEYS else _as_double(v) for k, v in ORACLE.items()}
