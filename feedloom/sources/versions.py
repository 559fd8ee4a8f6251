"""Data that is replaced as a whole while others read it.

A folder has numbered pointer files under ``_versions``, each a small JSON object that says
what is valid. The highest complete one counts. A new state is written beside the old one,
then its pointer: a reader sees the old state or the new one. What a pointer no longer names
stays until the next one is written, so that readers who had begun can end.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Superseded(RuntimeError):
    """Another writer has published the version that this one was about to."""


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    store, at = _store(spark, path)
    return sorted(found.getPath().getName() for found in store.listStatus(at)) if store.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    store, at = _store(spark, path)
    store.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _store(spark, path)
    return store.exists(at)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    names = (name.removesuffix(".json") for name in children(spark, f"{path}/_versions"))
    return sorted(int(name) for name in names if name.isdigit())


def _read(spark: SparkSession, path: str, number: int) -> dict | None:
    store, at = _store(spark, f"{path}/_versions/{number:012d}.json")
    stream = store.open(at)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    try:
        return json.loads(text)
    except ValueError:  # its writer failed, or has not ended
        return None


def newest(spark: SparkSession, path: str) -> dict:
    """What the newest complete pointer says, with its number as ``version``; 0 if there is none."""
    for number in reversed(_numbers(spark, path)):
        content = _read(spark, path, number)
        if content is not None:
            return content | {"version": number}
    return {"version": 0}


def publish(spark: SparkSession, path: str, seen: dict, content: dict) -> dict:
    """Make ``content`` the state that follows ``seen``, which `newest` returned.

    Raises :class:`Superseded` if another state was published since.
    """
    numbers = _numbers(spark, path)
    if newest(spark, path)["version"] != seen["version"]:
        raise Superseded(path)
    number = (numbers[-1] if numbers else 0) + 1
    store, at = _store(spark, f"{path}/_versions/{number:012d}.json")
    try:
        stream = store.create(at, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in str(error.java_exception.getClass().getName()):
            raise Superseded(path) from error
        raise
    try:
        stream.write(bytearray(json.dumps(content).encode()))
    finally:
        stream.close()
    for old in numbers:
        if old < seen["version"]:
            remove(spark, f"{path}/_versions/{old:012d}.json")
    return content | {"version": number}
