"""Reading and writing tables, with the declared schema of each source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

__all__ = [
    "POS_LINES",
    "SKUS",
    "STORES",
    "TOP_PATTERNS",
    "WEB_LINES",
    "jdbc_options",
    "list_tables",
    "load_csv",
    "load_table",
    "read_jdbc",
    "save_csv",
    "save_table",
]


_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "string": T.StringType(), "date": T.DateType(),
}


def _schema(columns: str) -> T.StructType:
    """Schema from "name type, name type"; parsed here because no session exists at import."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


WEB_LINES = _schema(
    "sku bigint, order_date date, order_number string, order_line_number double, "
    "order_entry_method int, amount double, standard_cost double, retail_price double, "
    "confirmed_quantity double, web_discount double"
)
POS_LINES = _schema(
    "store bigint, sku bigint, sale_date date, sale_quantity double, standard_cost double, "
    "retail_price double, net_sale_amount double, sale_discount double, misc_discount double, "
    "tax_amount double, slip string, slip_line string"
)
SKUS = _schema(
    "sku bigint, style_id string, style string, color_id string, pattern string, "
    "launch_date date, release_season string, retirement_date date, retirement_season string, "
    "department string, merchant_class string, fabrication string, web_active string, "
    "color_family string, color_season string, primary_color string, secondary_color string"
)
STORES = _schema(
    "store bigint, district_id string, district string, state string, store_type string, "
    "latitude double, longitude double, active string, square_footage double"
)
TOP_PATTERNS = _schema("pattern string")


def load_table(
    spark: SparkSession,
    name: str,
    root: str | None = None,
    columns: Sequence[str] | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """A whole table, or some of its columns.

    With a root, reads ``root/name.parquet``; without, a catalog table. The
    projection reaches the scan, so unread columns cost nothing. A declared
    schema saves the job that reads it off the files.
    """
    if root is None:
        df = spark.table(name)
    else:
        reader = spark.read if schema is None else spark.read.schema(schema)
        df = reader.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


def jdbc_options(
    url: str,
    table: str,
    partition_col: str | None = None,
    bounds: tuple[object, object] | None = None,
    n: int = 1,
    fetch_size: int = 10_000,
    extra: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Options of a JDBC read; with a partition column, one query per slice."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **(extra or {})}
    if partition_col is None:
        return options
    if bounds is None or n < 1:
        raise ValueError("a partitioned read needs bounds and at least one partition")
    return options | {
        "partitionColumn": partition_col,
        "lowerBound": str(bounds[0]),
        "upperBound": str(bounds[1]),
        "numPartitions": str(n),
    }


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_col: str | None = None,
    bounds: tuple[object, object] | None = None,
    n: int = 1,
    **extra: str,
) -> DataFrame:
    """Table of a remote database, read by many tasks; filters and columns are pushed to it."""
    options = jdbc_options(url, table, partition_col, bounds, n, extra=extra)
    return spark.read.format("jdbc").options(**options).load()


def load_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header row and a declared schema (nothing is inferred, so one pass)."""
    return spark.read.option("header", True).schema(schema).csv(path)


def save_table(
    df: DataFrame,
    name: str,
    mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
    bucket_by: tuple[int, Sequence[str]] | None = None,
) -> None:
    """Write a derived table, failing if it exists unless the mode says overwrite.

    A name holding ``/`` is a path, any other name a catalog table. Bucketing a
    catalog table on its join key lets later joins on that key skip the shuffle.
    """
    writer = df.write.mode(mode).format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if "/" in name:
        if bucket_by:
            raise ValueError("bucketing needs a catalog table, not a path")
        writer.save(name)
        return
    if bucket_by:
        buckets, cols = bucket_by
        writer = writer.bucketBy(buckets, *cols).sortBy(*cols)
    writer.saveAsTable(name)


def save_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables and views the session can see."""
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "name string, table_type string, is_temporary boolean")
