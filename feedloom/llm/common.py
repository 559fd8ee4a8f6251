"""What the operators share: the given tables, files in the shared folder, row batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from feedloom.operators.skew import join_by_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Deal out rows that are few but long in work.

    The number of partitions is given, so adaptive execution leaves them as they are.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *by)


def write_file(path: str, content: bytes) -> None:
    """Write a file of the shared folder from a task, whatever store the folder is in."""
    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    # As it is: by default the ending .gz would have it compressed.
    with store.open_output_stream(inner, compression=None) as out:
        out.write(content)


def open_file(path: str) -> pa.NativeFile:
    """Open a file of the shared folder for reads at any position."""
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def small(batches: Iterator[pa.RecordBatch], most: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches in slices of at most ``most`` rows, for what makes much of each row."""
    for batch in batches:
        for first in range(0, batch.num_rows, most):
            yield batch.slice(first, most)


# What this worker keeps from task to task. Workers outlive the stages of a job, so only
# the last thing asked for is kept.
_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]):
    """What ``make`` made under this key, unless the worker has since kept something else."""
    if key not in _KEPT:
        _KEPT.clear()
        release_memory()
        _KEPT[key] = make()
    return _KEPT[key]


def release_memory() -> None:
    """Give back to the system what earlier tasks of this worker have freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of a short task list; not for tables of documents."""
    for batch in batches:
        yield from batch.to_pylist()


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A column of texts, null counting as empty."""
    return [text or "" for text in batch.column(name).to_pylist()]


def record(values: dict[str, list | pa.Array], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v, pa.Array) else pa.array(v, kinds[k]) for k, v in values.items()],
        names=list(values),
    )


def keep_rows(docs: DataFrame, fates: DataFrame, names: list[str]) -> DataFrame:
    """The rows that stay, with the columns they have in the struct ``row``.

    ``docs`` has ``row`` and the columns ``names``, none of them null: apart from the row,
    so that no column of it can clash with these. ``fates`` has each distinct
    ``names`` of which a row goes or which several rows share, with ``kept``: whether one
    row stays. Rows that share all of ``names`` are the same document.
    """
    once = join_by_key(docs, fates.select(*names), names, "left_anti", names)
    shared = join_by_key(docs, fates.where("kept").select(*names), names, "left_semi", names)
    return once.unionByName(shared.dropDuplicates(names)).select("row.*")
