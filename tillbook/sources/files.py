"""Small files in whatever store Spark's paths lead to: text, folder names, deletion. For markers and manifests, never for rows."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _at(spark, path)
    return store.exists(where)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What is in a folder, ascending; nothing if there is none."""
    store, where = _at(spark, folder)
    return sorted(entry.getPath().getName() for entry in store.listStatus(where)) if store.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    store, where = _at(spark, path)
    stream = store.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """The file has its whole text or isn't there: it is written under another name and renamed."""
    store, where = _at(spark, path)
    _, draft = _at(spark, f"{where.getParent().toString()}/.{where.getName()}.draft")
    stream = store.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    store.delete(where, False)
    if not store.rename(draft, where):
        raise OSError(f"{draft.toString()} can't be renamed")


def delete(spark: SparkSession, path: str) -> None:
    store, where = _at(spark, path)
    store.delete(where, True)
