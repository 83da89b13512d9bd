"""Folders of runs: which there are, and removing them. Only names pass through the driver."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, folder: str) -> bool:
    fs, path = _path(spark, folder)
    return fs.exists(path)


def runs_below(spark: SparkSession, folder: str, key: str = "run_seq") -> list[int]:
    """Numbers of the ``<key>=<n>`` folders below a folder, ascending."""
    fs, path = _path(spark, folder)
    if not fs.exists(path):
        return []
    names = (x.getPath().getName() for x in fs.listStatus(path))
    return sorted(int(m.group(1)) for m in (re.fullmatch(rf"{key}=(\d+)", n) for n in names) if m)


def remove(spark: SparkSession, folder: str) -> None:
    fs, path = _path(spark, folder)
    fs.delete(path, True)
