"""Sources: the driver's Parquet tables, CSV and Parquet readers with
actionable errors (S1, S6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .files import exists

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events", "documents", "embeddings", "pages",
                 "benchmark", "labels", "conversations")


class SourceMissing(FileNotFoundError):
    """Raised when an input path is absent; the message names the producer."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, read lazily so Catalyst prunes columns and pushes filters."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if not exists(spark, path):
        raise SourceMissing(f"{path} not found; expected the driver table '{name}'")
    return spark.read.parquet(path)


def read_parquet(spark: SparkSession, path: str, produced_by: str = "") -> DataFrame:
    """Parquet source (S6) with an error that says which step writes it.  The
    path may be in any file system that the session reads."""
    if not exists(spark, path):
        hint = f"; run {produced_by} first" if produced_by else ""
        raise SourceMissing(f"{path} missing{hint}")
    return spark.read.parquet(path)


# Raw flat customer file of the reference (21 columns); TotalCharges stays a
# string so that blanks can be parsed leniently later.
RAW_CUSTOMER_SCHEMA = T.StructType([
    T.StructField("customerID", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("SeniorCitizen", T.IntegerType()),
    T.StructField("Partner", T.StringType()),
    T.StructField("Dependents", T.StringType()),
    T.StructField("tenure", T.IntegerType()),
    T.StructField("PhoneService", T.StringType()),
    T.StructField("MultipleLines", T.StringType()),
    T.StructField("InternetService", T.StringType()),
    T.StructField("OnlineSecurity", T.StringType()),
    T.StructField("OnlineBackup", T.StringType()),
    T.StructField("DeviceProtection", T.StringType()),
    T.StructField("TechSupport", T.StringType()),
    T.StructField("StreamingTV", T.StringType()),
    T.StructField("StreamingMovies", T.StringType()),
    T.StructField("Contract", T.StringType()),
    T.StructField("PaperlessBilling", T.StringType()),
    T.StructField("PaymentMethod", T.StringType()),
    T.StructField("MonthlyCharges", T.DoubleType()),
    T.StructField("TotalCharges", T.StringType()),
    T.StructField("Churn", T.StringType()),
])


def read_csv(spark: SparkSession, path: str,
             schema: T.StructType = RAW_CUSTOMER_SCHEMA) -> DataFrame:
    """CSV source (S1): explicit schema, header row, error naming the file."""
    if not exists(spark, path):
        raise SourceMissing(
            f"raw file not found at {path}; place the customer extract there")
    return spark.read.schema(schema).option("header", True).csv(path)
