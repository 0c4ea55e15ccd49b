"""Reading and writing tables: CSV and JSON with explicit schemas, Parquet, and JSON-safe rows."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, or in local mode a new one where it names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="millrace-")


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in a new folder of the shared one, read again: nothing before it runs twice or hangs on an executor."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, by: list[str], most: int | None = None) -> DataFrame:
    """df with the rows of a group in one partition, of which there are as many as the session shuffles into: few bytes with much work each are not put together.

    most: rows of a partition, on average at the most; larger tables have more partitions (df is counted for it).
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n if most is None else max(n, -(-df.count() // most)), *by)


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """CSV with a schema; a file that cannot be read is an error, and NaN becomes null."""
    return without_nan(spark.read.csv(path, schema=schema, header=header, mode="FAILFAST", enforceSchema=False))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null, in every floating column."""
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))})


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text a row; NaN and infinities are null."""
    finite = {f.name: F.when(F.abs(F.col(f.name)) < F.lit(math.inf), F.when(~F.isnan(f.name), F.col(f.name))) for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.withColumns(finite).select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "errorifexists") -> None:
    """Parquet in folders by column, rows of a folder dealt to one task each unless they are many (then several)."""
    df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(path)
