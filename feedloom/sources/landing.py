"""Payload files as a stream whose offsets are the order in which they arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from feedloom.schema import ARTICLE
from feedloom.sources.payload import CORRUPT, PAYLOAD_ORDER

NAME = "landed_files"

# Bytes of a file that one task reads.
SPLIT_BYTES = 64 << 20


def _source():
    """The data source, made in a function so that tasks need no import of this package."""
    import time
    from collections.abc import Iterator

    import pyarrow as pa
    from pyarrow import fs
    from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

    schema = "payload_time timestamp, payload_file string, payload_block bigint, payload_row bigint, text string"
    kinds = pa.schema(
        [
            ("payload_time", pa.timestamp("us", "UTC")),
            ("payload_file", pa.string()),
            ("payload_block", pa.int64()),
            ("payload_row", pa.int64()),
            ("text", pa.string()),
        ]
    )

    class Split(InputPartition):
        def __init__(self, path: str, moment: int, first: int, end: int):
            self.path, self.moment, self.first, self.end = path, moment, first, end

    class LandedReader(DataSourceStreamReader):
        """An offset is the time and name of the last file taken; times are in microseconds.

        Files go by time, then by name. All files of a time that are there are taken
        together, and only once the time is ``settle`` seconds past, so a batch never ends
        among files of one moment. What a batch reads follows from its two offsets alone.
        """

        def __init__(self, options: dict[str, str]):
            self._uri = options["path"]
            self._settle = float(options.get("settle", 0))
            self._whole = options.get("whole", "false") == "true"
            self._split = int(options["split"])

        def initialOffset(self) -> dict:
            return {"time": -1, "path": ""}

        def _files(self) -> list[tuple[int, str, int]]:
            store, folder = fs.FileSystem.from_uri(self._uri)
            found = store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
            return sorted(
                (f.mtime_ns // 1000, f.path, f.size)
                for f in found
                if f.is_file and not any(part[:1] in "._" for part in f.path[len(folder) :].strip("/").split("/"))
            )

        def latestOffset(self) -> dict:
            past = (time.time() - self._settle) * 1e6
            files = [f for f in self._files() if f[0] <= past or not self._settle]
            return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            after, last = (start["time"], start["path"]), (end["time"], end["path"])
            splits = []
            for moment, path, size in self._files():
                if after < (moment, path) <= last:
                    step = max(1, size) if self._whole else self._split
                    splits += [Split(path, moment, i, min(i + step, size)) for i in range(0, max(1, size), step)]
            return splits

        def read(self, split: InputPartition) -> Iterator[pa.RecordBatch]:
            store, _ = fs.FileSystem.from_uri(self._uri)
            with store.open_input_file(split.path) as file:
                row = 0
                for texts in self._texts(file, split):
                    n = len(texts)
                    columns = [[split.moment] * n, [split.path] * n, [split.first] * n, range(row, row + n), texts]
                    row += n
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds)], schema=kinds)

        def _texts(self, file, split) -> Iterator[list[str]]:
            """The lines that begin in the split, in lists of bounded size, or the file's text."""
            if self._whole:
                yield [file.read().decode(errors="replace")]
                return
            at = split.first
            if at:  # the line that ends here, or runs across, is another split's
                at -= 1
                while True:
                    piece = file.read_at(1 << 16, at)
                    if not piece:
                        return
                    cut = piece.find(b"\n")
                    at += len(piece) if cut < 0 else cut + 1
                    if cut >= 0:
                        break
            rest, lines, size = b"", [], 0
            while at - len(rest) < split.end:
                piece = file.read_at(1 << 20, at)
                if not piece:
                    if rest:
                        lines.append(rest)
                    break
                at += len(piece)
                begun = at - len(piece) - len(rest)
                *whole, rest = (rest + piece).split(b"\n")
                for line in whole:
                    if begun < split.end:
                        lines.append(line)
                        size += len(line)
                    begun += len(line) + 1
                if size >= 4 << 20:
                    yield [line.decode(errors="replace") for line in lines]
                    lines, size = [], 0
            if lines:
                yield [line.decode(errors="replace") for line in lines]

    class LandedFiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return "landed_files"

        def schema(self) -> str:
            return schema

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return LandedReader(dict(self.options))

    return LandedFiles


def landed_articles(
    spark: SparkSession, landing: str, array: bool = False, settle: float = 2.0, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """A stream of the articles in the files under ``landing``, with `PAYLOAD_ORDER`.

    Files hold JSON lines, which are split between tasks, or with ``array`` one JSON array
    each. Names beginning with a dot or underscore are left out. A line that is no article
    is a row without values with its text in `CORRUPT`. A file is taken once its time is
    ``settle`` seconds past: a store must not show a file later than that, nor give it an
    earlier time, or it is passed over.
    """
    spark.dataSource.register(_source())
    options = {"path": landing, "settle": settle, "whole": array, "split": split_bytes}
    lines = spark.readStream.format(NAME).options(**options).load()
    kept = StructType([*ARTICLE.fields, StructField(CORRUPT, StringType())])
    parsing = {"columnNameOfCorruptRecord": CORRUPT}
    if not array:
        read = lines.where(F.trim("text") != "").withColumn("_row", F.from_json("text", kept, parsing))
        unread = F.coalesce(F.col(f"_row.{CORRUPT}"), F.when(F.col("_row").isNull(), F.col("text")))
        return read.select(*[F.col(f"_row.{c}").alias(c) for c in ARTICLE.names], unread.alias(CORRUPT), *PAYLOAD_ORDER)
    read = lines.select(F.posexplode_outer(F.from_json("text", ArrayType(ARTICLE))), "text", *PAYLOAD_ORDER)
    nothing = F.regexp_replace("text", r"\s", "").isin("", "[]")
    return read.where(F.col("pos").isNotNull() | ~nothing).select(
        *[F.col(f"col.{c}").alias(c) for c in ARTICLE.names],
        F.when(F.col("pos").isNull(), F.col("text")).alias(CORRUPT),
        *[c for c in PAYLOAD_ORDER if c != "payload_row"],
        F.coalesce("pos", F.lit(0)).cast("bigint").alias("payload_row"),
    )
