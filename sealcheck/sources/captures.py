"""Capture files: inventory, digests, failures, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sealcheck.tables import CAPTURE_SUFFIXES, SKIPPED_FOLDERS


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Path, length and time of every file below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length", "modificationTime")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def capture_manifest(files: DataFrame, suffixes=CAPTURE_SUFFIXES, skipped=SKIPPED_FOLDERS) -> DataFrame:
    """Capture files outside generated-output folders, sorted by path."""
    endings = "|".join(s.replace(".", r"\.") for s in suffixes)
    parts = F.split(F.regexp_replace("path", "^[a-z]+:/*", "/"), "/")
    return (files.filter(F.lower("path").rlike(rf"(?:{endings})$"))
            .filter(~F.arrays_overlap(parts, F.array(*map(F.lit, skipped)))).orderBy("path"))


def with_sha256(files: DataFrame, content: str = "content") -> DataFrame:
    data = F.col(content).cast("binary")
    return files.withColumns({"sha256": F.sha2(data, 256), "size_bytes": F.octet_length(data).cast("bigint")})


def split_failures(records: DataFrame, corrupt: str = "_corrupt_record") -> tuple[DataFrame, DataFrame]:
    """Good records and (path, error) rows; a bad capture never stops the run."""
    bad = F.col(corrupt).isNotNull()
    return (records.filter(~bad).drop(corrupt),
            records.filter(bad).select("path", F.concat(F.lit("unreadable record: "), F.col(corrupt)).alias("error")))


def pending(manifest: DataFrame, done: DataFrame, limit: int = 0) -> DataFrame:
    """Captures without an earlier successful record."""
    todo = manifest.orderBy("path").limit(limit) if limit else manifest
    finished = done.filter(F.coalesce("ok", F.lit(False))).select("path")
    return todo.join(finished, "path", "left_anti")
