"""Folders that appear one after another under numbers: written aside, then renamed, so that a reader sees all of one or nothing."""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _files(spark: SparkSession, root: str):
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    return path, path(root).getFileSystem(conf), conf


def number_of(name: str, prefix: str) -> int:
    """The number in a folder's name; 0 for any other name."""
    found = re.fullmatch(rf"{prefix}=(\d+)", name)
    return int(found.group(1)) if found else 0


def name_of(number: int, prefix: str) -> str:
    return f"{prefix}={number:010d}"


def numbers(spark: SparkSession, root: str, prefix: str) -> list[int]:
    """The numbers that are there, in order."""
    path, fs, _ = _files(spark, root)
    if not fs.exists(path(root)):
        return []
    return sorted(n for f in fs.listStatus(path(root)) if (n := number_of(f.getPath().getName(), prefix)))


def aside(root: str) -> str:
    """A name in ``root`` that readers pass over."""
    return f"{root}/_writing-{uuid.uuid4().hex}"


def commit(spark: SparkSession, written: str, root: str, prefix: str, number: int) -> bool:
    """Renames what was written aside to the number; False if another writer has taken it."""
    path, fs, conf = _files(spark, root)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    options = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        context.rename(path(written), path(f"{root}/{name_of(number, prefix)}"), options)
    except Py4JJavaError as e:
        if "exist" not in f"{e.java_exception.getClass().getName()} {e.java_exception.getMessage()}".lower():
            raise
        return False
    return True


def remove(spark: SparkSession, folder: str) -> None:
    path, fs, _ = _files(spark, folder)
    fs.delete(path(folder), True)


def write_text(spark: SparkSession, name: str, text: str) -> None:
    path, fs, _ = _files(spark, name)
    stream = fs.create(path(name))
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_text(spark: SparkSession, name: str) -> str:
    path, fs, _ = _files(spark, name)
    stream = fs.open(path(name))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def listed(spark: SparkSession, root: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    path, fs, _ = _files(spark, root)
    return sorted(f.getPath().getName() for f in fs.listStatus(path(root))) if fs.exists(path(root)) else []
