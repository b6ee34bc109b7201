"""Folders and marks in any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    files, p = _at(spark, path)
    return files.exists(p)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    files, p = _at(spark, path)
    return [f.getPath().getName() for f in files.listStatus(p)] if files.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    files, p = _at(spark, path)
    files.delete(p, True)


def mark(spark: SparkSession, path: str) -> None:
    """An empty file."""
    files, p = _at(spark, path)
    files.create(p, True).close()


def move(spark: SparkSession, path: str, folder: str) -> None:
    """A file into a folder, which is made if need be."""
    files, p = _at(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files.mkdirs(target)
    if not files.rename(p, spark._jvm.org.apache.hadoop.fs.Path(target, p.getName())):
        raise OSError(f"{path} could not be moved to {folder}")
