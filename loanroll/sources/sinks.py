"""Sinks (K1-K4): report bundle, ';' / decimal-comma extract, matrices.

Spreadsheet output is re-aimed at one dataset per named table; column display
names (spaces, accents) are applied only here. Writers never coalesce to one
task: each dataset is a folder of part files. A bundle is published as a whole.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Output names the report consumers expect.
EXTRACT_PREFIX = "VALORACION_PRUEBA_pd70_total_"

# Display names of the report columns (snake_case inside the engine).
DISPLAY_NAMES = {
    "credito": "Credito",
    "suma_importe_base": "Suma de Importe base",
    "saldo_actual": "Saldo Actual",
    "precio_compra": "Precio de compra",
    "saldo_a_capital": "Saldo a capital",
    "compra": "Compra",
    "valoracion_con_garantia": "Valoracion con garantia",
    "anio": "Año",
    "mes": "Mes",
}


def with_display_names(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(DISPLAY_NAMES.get(c, c)) for c in df.columns])


def _csv2_text(f: T.StructField) -> F.Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return (
            F.when(F.isnan(c), F.lit("NaN"))
            .when(c == float("inf"), F.lit("Inf"))
            .when(c == float("-inf"), F.lit("-Inf"))
            .otherwise(F.regexp_replace(c.cast("string"), r"\.", ","))
        ).alias(f.name)
    return c.cast("string").alias(f.name)


def write_csv2(df: DataFrame, folder: str, key: int | str, mode: str = "overwrite") -> str:
    """K2: ``write_csv2`` - ';' separator, decimal comma, ``NA`` for missing;
    the dataset name carries the month-end key."""
    path = f"{folder.rstrip('/')}/{EXTRACT_PREFIX}{key}"
    (
        df.select(*[_csv2_text(f) for f in df.schema.fields])
        .write.mode(mode).option("header", "true").option("sep", ";")
        .option("nullValue", "NA").option("emptyValue", "").csv(path)
    )
    return path


MANIFEST = "manifiesto"  # the dataset beside the tables that says what was published


def write_bundle(bundle: dict[str, DataFrame], folder: str, fmt: str = "parquet",
                 display_names: bool = True, sort_by: str = "credito") -> dict[str, str]:
    """K1/K3/K4: one dataset per named table under ``folder``, all or nothing.

    Every table is first written beside the published ones; only when all are
    complete are they renamed into place, and the manifest (name, rows, time of
    each table; the rows are counted while writing) is written last. If a table
    fails, the former bundle stays as it was; if a rename fails, those before
    it are taken back.

    O1: tables that hold ``sort_by`` are written in its order (range
    partitions, so part files ascend), as the scripts present them.
    """
    base, run = folder.rstrip("/"), uuid.uuid4().hex[:12]
    staging, former = f"{base}/.nuevo-{run}", f"{base}/.anterior-{run}"
    spark, counted = next(iter(bundle.values())).sparkSession, {}
    try:
        for name, df in bundle.items():
            if sort_by in df.columns:
                df = df.orderBy(sort_by)
            counted[name] = Observation()
            out = with_display_names(df) if display_names else df
            out.observe(counted[name], F.count(F.lit(1)).alias("filas")).write.format(fmt).save(f"{staging}/{name}")
        rows = [(name, seen.get["filas"], run, dt.datetime.now(dt.timezone.utc)) for name, seen in counted.items()]
        schema = "hoja string, filas bigint, version string, publicado timestamp"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{staging}/{MANIFEST}")
        _swap(spark, staging, base, former, [*bundle, MANIFEST])
    finally:
        for folder in (staging, former):
            _delete(spark, folder)
    return {name: f"{base}/{name}" for name in bundle}


def _files(spark: SparkSession, path: str):
    """The file system that holds ``path``, and the path for it. Spark has no rename of its own."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _delete(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def _move(spark: SparkSession, source: str, target: str) -> None:
    files, at = _files(spark, source)
    to = _files(spark, target)[1]
    files.mkdirs(to.getParent())
    if not files.rename(at, to):
        raise OSError(f"{source} can't be renamed to {target}")


def _exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def _swap(spark: SparkSession, staging: str, base: str, former: str, names: list[str]) -> None:
    """Rename the staged datasets into place, the published ones out of the way; undone if a rename fails."""
    done: list[tuple[str, str]] = []
    try:
        for name in names:
            target = f"{base}/{name}"
            steps = [(target, f"{former}/{name}")] if _exists(spark, target) else []
            for source, to in (*steps, (f"{staging}/{name}", target)):
                _move(spark, source, to)
                done.append((source, to))
    except Exception:
        for source, to in reversed(done):
            _move(spark, to, source)
        raise


def read_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The published tables that the manifest names."""
    base = folder.rstrip("/")
    return {r.hoja: spark.read.parquet(f"{base}/{r.hoja}") for r in spark.read.parquet(f"{base}/{MANIFEST}").collect()}


def bundle_counts(bundle: dict[str, DataFrame]) -> DataFrame:
    """Row count of each named table of a bundle (one row per table)."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("filas")).select(F.lit(name).alias("hoja"), "filas")
        for name, df in bundle.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
