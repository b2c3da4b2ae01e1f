"""Writing results: partitioned tables, strict JSON, bundles and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklane.functions.missing import finite


def write_table(df: DataFrame, path: str, by: list[str] | None = None, form: str = "parquet") -> None:
    """Write once: an output that exists already is an error, never overwritten."""
    w = df.write.mode("errorifexists").format(form)
    if form == "csv":
        w = w.option("header", True)
    (w.partitionBy(*by) if by else w).save(path)


def strict(df: DataFrame) -> DataFrame:
    """Columns in order of name, non-finite numbers as null: what strict JSON can hold."""
    number = (T.DoubleType, T.FloatType)
    return df.select(*(F.when(finite(F.col(f.name)), F.col(f.name)).alias(f.name) if isinstance(f.dataType, number) else F.col(f.name) for f in sorted(df.schema, key=lambda f: f.name)))


def write_json(df: DataFrame, path: str) -> None:
    write_table(strict(df), path, form="json")


def write_log(parts: list[DataFrame], time: str, keys: list[str], path: str) -> None:
    """Several message streams as one log: each file in order of time within its keys, files split by ranges of time."""
    log = parts[0]
    for p in parts[1:]:
        log = log.unionByName(p, allowMissingColumns=True)
    write_table(log.repartitionByRange(*keys, time).sortWithinPartitions(*keys, time), path)


def write_bundle(variants: dict[str, DataFrame], path: str, metrics: DataFrame | None = None) -> None:
    """Variants of one result in one table, partitioned by the variant's name; their metrics as strict JSON and a manifest of all files beside it."""
    out = None
    for name, df in variants.items():
        part = df.withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        return
    write_table(out, f"{path}/variants", by=["variant"])
    if metrics is not None:
        write_json(metrics, f"{path}/metrics")
    write_json(manifest(out.sparkSession, path), f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, sha256) of every file below a folder, hashed where the files are read; empty files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def write_run(spark: SparkSession, path: str, config: dict[str, str], inputs: list[str], outputs: list[str], status: str, elapsed_s: float) -> None:
    """The record of a run: one line of its settings, status and duration, and a line per input and output file with its hash."""
    head = spark.createDataFrame([(status, float(elapsed_s), config)], "status string, elapsed_s double, config map<string, string>").withColumn("part", F.lit("run"))
    rows = head
    for part, folders in (("input", inputs), ("output", outputs)):
        for folder in folders:
            rows = rows.unionByName(manifest(spark, folder).withColumn("part", F.lit(part)), allowMissingColumns=True)
    write_json(rows, path)
