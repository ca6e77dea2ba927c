"""Readers for the report sources.

* Warehouse tables: Parquet (partitioned by ``id_fecha`` on disk, so date
  predicates prune partitions) or JDBC with a partition column, never a
  single-connection pull.
* Purchase tape: a CSV export of the accounting spreadsheet, cut by position.
* Hand-off extract: ``;``-separated, decimal comma, ``NA`` for missing.

No reader infers a schema.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanroll.session import write_and_read
from loanroll.sources import schemas
from loanroll.sources.layout import stored_ledger
from loanroll.sources.model import Sources
from loanroll.sources.schemas import PURCHASE_TAPE


def read_parquet_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A warehouse table exported to Parquet, read with its declared schema (and column order)."""
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def read_jdbc_table(spark: SparkSession, table: str, url: str, schema: T.StructType,
                    partition_column: str, bounds: tuple[int, int], num_partitions: int = 64,
                    query_timeout: int = 1000, properties: dict[str, str] | None = None,
                    predicates: list[str] | None = None) -> DataFrame:
    """A warehouse table over JDBC; connection details come from configuration.

    The read is always split into ``num_partitions`` range queries on
    ``partition_column``: one connection would be one task. The ranges are of
    equal width, or those of ``predicates`` (see :func:`range_predicates`: of
    about equal rows).
    """
    options = {"queryTimeout": str(query_timeout), **(properties or {})}
    if predicates:
        df = spark.read.jdbc(url, table, predicates=predicates, properties=options)
    else:
        df = (
            spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
            .option("partitionColumn", partition_column)
            .option("lowerBound", str(bounds[0])).option("upperBound", str(bounds[1]))
            .option("numPartitions", str(num_partitions)).load()
        )
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def split_ranges(rows: DataFrame, column: str, parts: int, width: int = 1) -> DataFrame:
    """Ranges of an integer column that hold about equal rows: ``parte``, ``desde``, ``hasta`` (inclusive), ``filas``.

    From a histogram of bins of ``width`` values (one aggregate over one
    column; the bins, not the rows, are put in order): a bin goes to the part
    that the middle of its rows falls in. A value that holds more than a part's
    rows is a range of its own size; rows without a value are one more part,
    without bounds. ``rows`` may be any stored table with the same ids, e.g.
    last month's.
    """
    bins = rows.groupBy(F.expr(f"floor({column} / {width})").alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    known = bins.filter("_bin IS NOT NULL")
    every = Window.orderBy("_bin")
    placed = known.withColumns({
        "_until": F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "_total": F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    placed = placed.withColumn("parte", F.expr(f"(2 * _until - _n) * {parts} DIV (2 * _total)"))
    ranges = placed.groupBy("parte").agg(F.min("_lo").alias("desde"), F.max("_hi").alias("hasta"), F.sum("_n").alias("filas"))
    missing = bins.filter("_bin IS NULL").select(
        F.lit(-1).cast("bigint").alias("parte"), F.col("_lo").alias("desde"), F.col("_hi").alias("hasta"), F.col("_n").alias("filas"))
    return ranges.unionByName(missing)


def range_predicates(ranges: DataFrame, column: str) -> list[str]:
    """Conditions that cut a table into the ranges (one row of ``ranges`` each: as many as the parts asked for).

    Together they hold for every row once: the first and last range are open, those between meet, and rows
    without a value have a condition of their own.
    """
    found = sorted(r.desde for r in ranges.filter("desde IS NOT NULL").collect())
    if not found:
        return [f"{column} IS NULL", f"{column} IS NOT NULL"]
    cuts = [f"{column} < {found[1]}" if len(found) > 1 else f"{column} IS NOT NULL"]
    cuts += [f"{column} >= {a} AND {column} < {b}" for a, b in zip(found[1:-1], found[2:], strict=True)]
    return [f"{column} IS NULL", *cuts, *([f"{column} >= {found[-1]}"] if len(found) > 1 else [])]


def read_purchase_tape_csv(spark: SparkSession, path: str, skip: int = 3) -> DataFrame:
    """CSV export of the tape: ``skip`` preamble lines and a header line, then data, one row per line.

    The preamble is cut by position, as the scripts' ``skip`` does: the first
    lines of each file. The text is read once and written with the order of the
    lines inside each split of a file; the splits' line counts and their sums
    over the splits before give every line its number in the file, whatever the
    size of a split and whichever task read it. Columns are taken by position. Rows without an id stay
    (the operators drop them); ids may be written as ``10`` or ``10.0``.
    """
    names = [f.name for f in PURCHASE_TAPE.fields]
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"))
    lines = write_and_read(lines, "tape-lines")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = (lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))  # one row per split
              .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("file", "start", "first", "before"))
    numbered = lines.join(splits, ["file", "start"]).withColumn("line", F.expr("before + at - first"))
    data = numbered.filter(F.col("line") > skip).filter(F.trim("value") != "")
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    row = F.from_csv("value", text.simpleString()[len("struct<"):-1].replace(":", " "))
    return data.select(row.alias("r")).select(
        parse_number(F.col("r.credito")).cast("bigint").alias("credito"),
        *[parse_number(F.col(f"r.{n}")).alias(n) for n in names[1:]])


def parse_number(c: Column) -> Column:
    """Number text -> double: with a decimal comma ``.`` groups digits, else ``.`` is the decimal point; null when not a number."""
    text = F.trim(c)
    comma = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(text.contains(","), comma).otherwise(text).try_cast("double")


def read_csv2(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``read_csv2`` - ';' separator, decimal comma; ``NA`` and empty text
    are missing (readr's default ``na = c("", "NA")``)."""
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = (
        spark.read.schema(as_text).option("header", "true").option("sep", ";")
        .option("nullValue", "NA").option("emptyValue", "").csv(path)
    )
    cols = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # '.' groups digits; what is no number is missing
            c = F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
        elif isinstance(f.dataType, T.StringType):
            c = F.when(c == "", F.lit(None)).otherwise(c)
        else:
            c = F.replace(c, F.lit("."), F.lit("")).try_cast(f.dataType)
        cols.append(c.alias(f.name))
    return raw.select(*cols)


def newest_path(spark: SparkSession, folder: str, prefix: str) -> str:
    """The dataset of ``folder`` named ``prefix*`` whose files are newest.

    Files are listed by the ``binaryFile`` source with only ``path`` and
    ``modificationTime`` selected (no file content is read); the newest
    dataset is one aggregate row brought to the driver.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        .select("path", "modificationTime")
        .withColumn("dataset", F.regexp_extract("path", rf"^(.*/{re.escape(prefix)}[^/]*)(/[^/]*)?$", 1))
        .filter(F.col("dataset") != "")
    )
    row = (
        files.groupBy("dataset").agg(F.max("modificationTime").alias("mtime"))
        .agg(F.max_by("dataset", F.struct("mtime", "dataset")).alias("newest"))
        .first()
    )
    if row is None or row["newest"] is None:
        raise FileNotFoundError(f"no {prefix}* under {folder}")
    return row["newest"]


def read_latest_csv2(spark: SparkSession, folder: str, prefix: str, schema: T.StructType) -> DataFrame:
    """S7 + S8: read the newest extract of the folder."""
    return read_csv2(spark, newest_path(spark, folder, prefix), schema)


def warehouse_sources(spark: SparkSession, tables: dict[str, str | dict], wide_ledger: bool = False) -> Sources:
    """S1-S6 from stored tables: ``tables`` maps each of ``model.TABLES`` to a
    Parquet folder, or to the keyword arguments of :func:`read_jdbc_table`
    (the purchase tape may be a ``.csv`` export instead). ``wide_ledger``
    reads the roll-rate report's wider ledger projection (S1b). A ledger given
    as ``table:name`` is the catalog table of :func:`loanroll.sources.layout.store_ledger`."""
    declared = {
        "ledger_month": schemas.LEDGER_MONTH_WIDE if wide_ledger else schemas.LEDGER_MONTH,
        "ledger_day": schemas.LEDGER_DAY, "ltv": schemas.LTV,
        "restructuring_mark": schemas.RESTRUCTURING_MARK, "collections": schemas.COLLECTIONS,
        "purchase_tape_raw": schemas.PURCHASE_TAPE,
    }
    read = {}
    for name, schema in declared.items():
        where = tables[name]
        if name == "ledger_month" and isinstance(where, str) and where.startswith("table:"):
            read[name], read["max_loan_rows"] = stored_ledger(spark, where.removeprefix("table:"))
        elif isinstance(where, dict):
            read[name] = read_jdbc_table(spark, schema=schema, **where)
        elif name == "purchase_tape_raw" and where.endswith(".csv"):
            read[name] = read_purchase_tape_csv(spark, where)
        else:
            read[name] = read_parquet_table(spark, where, schema)
    return Sources(**read)
