"""Scans and sinks for the file formats that workloads use."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

PARAMETER_FILE = "parameter_set_id string, parameters array<struct<position:string,type:string,value:string>>"
MANIFEST_FILE = "query_file string, parameter_file string, held_out_parameter_file string, expected_candidate_source_detail string, workload_label string, workload_description string"


def scan_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = False) -> DataFrame:
    """CSV whose quotes are escaped with a backslash, as the join-order data set has it; an unquoted empty field is NULL."""
    return spark.read.schema(schema).option("header", header).option("quote", '"').option("escape", "\\").option("multiLine", True).option("nullValue", "").option("emptyValue", "").csv(path)


def scan_parameter_sets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARAMETER_FILE).option("multiLine", True).json(path)


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_FILE).option("multiLine", True).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def scan_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database, if its driver is on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def checksums(folder: str | Path) -> dict[str, str]:
    """SHA-256 of every file below a local folder, by relative path."""
    top = Path(folder)
    return {f.relative_to(top).as_posix(): hashlib.sha256(f.read_bytes()).hexdigest() for f in sorted(top.rglob("*")) if f.is_file()}
