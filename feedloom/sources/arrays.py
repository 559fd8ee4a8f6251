"""Files that hold one JSON array each, read by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StringType, StructType

from feedloom.schema import ARTICLE
from feedloom.session import materialize
from feedloom.sources.payload import CORRUPT, PAYLOAD_ORDER

_SPLIT = "payload_time timestamp, payload_file string, size bigint, first bigint, end bigint"
_STATE = f"{_SPLIT}, array boolean, inside boolean, pending boolean, depth bigint"


def _scanner():
    """Functions over bytes, made in a function so that tasks need no import of this package."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa
    from pyarrow import fs

    step = 1 << 20
    # What is read at first beyond the end of a split; doubled while the last element goes on.
    beyond = 1 << 12
    blank = b" \t\r\n\xef\xbb\xbf"
    marks = bytes(sign in b'"\\[{]},' for sign in range(256))

    def opened(path: str):
        store, inner = fs.FileSystem.from_uri(path)
        return store.open_input_file(inner)

    def marked(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The places and signs of the few bytes that can change the state or part elements."""
        at = np.flatnonzero(np.frombuffer(piece.translate(marks), np.bool_))
        return at, np.frombuffer(piece, np.uint8)[at]

    def structure(length: int, at: np.ndarray, signs: np.ndarray, inside: bool, pending: bool):
        """Which of the marked bytes stand outside strings, and the state behind the piece.

        The state is whether a string is open and whether the next sign is escaped.
        """
        quotes = signs == 0x22
        escaped = False
        slash = at[signs == 0x5C]
        if len(slash) or pending:
            # Backslashes up to each one of a run; behind an odd number the next sign is escaped.
            begins = np.diff(slash, prepend=-2) != 1
            place = np.arange(len(slash))
            run = place - np.maximum.accumulate(np.where(begins, place, 0)) + 1
            if pending and len(slash) and slash[0] == 0:
                run[slash == place] += 1  # the run goes on from the piece before
            ends = slash[run % 2 == 1] + 1
            if pending and not (len(slash) and slash[0] == 0):
                ends = np.concatenate([[0], ends])
            quotes[np.isin(at, ends, assume_unique=True)] = False
            escaped = bool(len(ends)) and int(ends[-1]) == length
        open_ = (np.cumsum(quotes) + int(inside)) % 2 == 1
        before = open_ ^ quotes
        return ~before & ~quotes, bool(open_[-1]) if len(open_) else inside, escaped

    def levels(signs: np.ndarray, outside: np.ndarray) -> np.ndarray:
        """The change of depth at each marked byte."""
        up = ((signs == 0x5B) | (signs == 0x7B)) & outside
        down = ((signs == 0x5D) | (signs == 0x7D)) & outside
        return up.astype(np.int64) - down

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a split makes of each state it may begin in, as ``to``, one row for each.

        ``array`` tells whether its first sign begins an array; a blank split cannot tell.
        """
        for batch in batches:
            arrays, begins, ends = [], [], []
            for row in batch.to_pylist():
                array = None
                with opened(row["payload_file"]) as file:
                    states = {(i, p): (i, p, 0) for i, p in ((False, False), (True, False), (True, True))}
                    for place in range(row["first"], row["end"], step):
                        piece = file.read_at(min(step, row["end"] - place), place)
                        if array is None and (text := piece.lstrip(blank)):
                            array = text.startswith(b"[")
                        at, signs = marked(piece)
                        for begun, (inside, pending, depth) in states.items():
                            outside, i, p = structure(len(piece), at, signs, inside, pending)
                            states[begun] = (i, p and i, depth + int(levels(signs, outside).sum()))
                arrays += [array] * 3
                begins += states
                ends += states.values()
            found = pa.Table.from_batches([batch]).take(np.repeat(np.arange(len(batch)), 3))
            for name, kind, values in (
                ("array", pa.bool_(), arrays),
                ("from_inside", pa.bool_(), [b[0] for b in begins]),
                ("from_pending", pa.bool_(), [b[1] for b in begins]),
                ("inside", pa.bool_(), [s[0] for s in ends]),
                ("pending", pa.bool_(), [s[1] for s in ends]),
                ("depth", pa.int64(), [s[2] for s in ends]),
            ):
                found = found.append_column(name, pa.array(values, kind))
            yield from found.to_batches()

    def chained(rows: pa.Table) -> pa.Table:
        """The state that each split of one file begins in."""
        splits: dict[int, dict] = {}
        for row in rows.to_pylist():
            splits.setdefault(row["first"], {})[row["from_inside"], row["from_pending"]] = row
        told = (splits[first][False, False]["array"] for first in sorted(splits))
        array = next((a for a in told if a is not None), False)
        inside, pending, depth, out = False, False, 0, []
        for first in sorted(splits):
            ways = splits[first]
            out.append({**ways[False, False], "array": array, "inside": inside, "pending": pending, "depth": depth})
            to = ways[inside, pending]
            inside, pending, depth = to["inside"], to["pending"], depth + to["depth"]
        names = ["payload_time", "payload_file", "size", "first", "end", "array", "inside", "pending", "depth"]
        return pa.Table.from_pylist(out, schema=pa.schema([rows.schema.field(n) for n in names]))

    texts = pa.schema(
        [
            ("payload_time", pa.timestamp("us", "UTC")), ("payload_file", pa.string()), ("payload_block", pa.int64()),
            ("payload_row", pa.int64()), ("text", pa.string()),
        ]
    )

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The elements that begin in each split; the last one is read to its end."""
        for batch in batches:
            held, size = [], 0
            for row in batch.to_pylist():
                for number, text in enumerate(_elements(row)):
                    held.append((row["payload_time"], row["payload_file"], row["first"], number, text.decode(errors="replace")))
                    size += len(text)
                    if size >= 4 << 20:
                        yield _rows(held)
                        held, size = [], 0
            if held:
                yield _rows(held)

    def _rows(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), texts)], schema=texts)

    def _elements(row: dict) -> Iterator[bytes]:
        inside, pending, depth = row["inside"], row["pending"], row["depth"]
        if not row["array"] and row["first"] > 0:
            return
        with opened(row["payload_file"]) as file:
            if not row["array"]:
                if (whole := file.read_at(row["size"], 0)).strip():
                    yield whole  # no array: a single value
                return
            # The text of the element that is open, if it began in this split.
            text: bytearray | None = None
            place, ahead = row["first"], beyond
            while place < row["size"] and (place < row["end"] or text is not None):
                if place >= row["end"]:
                    ahead *= 2
                piece = file.read_at(min(step, row["size"] - place, max(row["end"] - place, 0) + ahead), place)
                if not piece:
                    raise EOFError(f"{row['payload_file']} ends at {place} of {row['size']} bytes")
                at, signs = marked(piece)
                outside, inside, pending = structure(len(piece), at, signs, inside, pending)
                deltas = levels(signs, outside)
                after = np.cumsum(deltas) + depth
                depth = int(after[-1]) if len(after) else depth
                comma = (signs == 0x2C) & outside & (after == 1)
                bounds = np.flatnonzero(comma | ((deltas == 1) & (after == 1)) | ((deltas == -1) & (after == 0)))
                last = 0
                for b, delta in zip(at[bounds].tolist(), deltas[bounds].tolist()):
                    if text is not None:
                        text += piece[last:b]
                        if text.strip():
                            yield bytes(text)
                        text = None
                    if place + b >= row["end"]:
                        return
                    if delta != -1:
                        text = bytearray()
                    last = b + 1
                if text is not None:
                    text += piece[last:]
                place += len(piece)
            if text is not None and text.strip():
                yield bytes(text)  # the file ends in an element

    return transitions, chained, elements


def read_array_payload(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """Articles in files that hold a JSON array each, in splits of ``split_bytes``.

    A split cannot know whether it begins within a string, or how deep in the array. Every
    split therefore tells what it makes of each state it might begin in; these are chained
    from the start of the file, and then each reads the elements that begin in it. The rows
    are those of ``read_payload(array=True)``, but one element that is no article, or
    an array that does not end, does not cost the others. The place is any that ``pyarrow``
    can open.
    """
    transitions, chained, elements = _scanner()
    # Only names, times and lengths: the content column is not read.
    files = spark.read.format("binaryFile").load(path).select(
        F.col("modificationTime").alias("payload_time"), F.col("path").alias("payload_file"), F.col("length").alias("size")
    )
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint"))
    splits = files.select("*", F.explode(starts).alias("first")).withColumn("end", F.least("size", F.col("first") + split_bytes))
    # A split is a short row of long work, so tasks are given by their number.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions")) + 1
    told = splits.repartition(tasks, "payload_file", "first").mapInArrow(
        transitions, f"{_SPLIT}, array boolean, from_inside boolean, from_pending boolean, inside boolean, pending boolean, depth bigint"
    )
    states = materialize(told.groupBy("payload_file").applyInArrow(chained, _STATE), "array-splits")
    read = states.repartition(tasks, "payload_file", "first").mapInArrow(
        elements, "payload_time timestamp, payload_file string, payload_block bigint, payload_row bigint, text string"
    )
    kept = StructType([*ARTICLE.fields, StructField(CORRUPT, StringType())])
    parsed = read.withColumn("_row", F.from_json("text", kept, {"columnNameOfCorruptRecord": CORRUPT}))
    unread = F.coalesce(F.col(f"_row.{CORRUPT}"), F.when(F.col("_row").isNull(), F.col("text")))
    return parsed.select(*[F.col(f"_row.{c}").alias(c) for c in ARTICLE.names], unread.alias(CORRUPT), *PAYLOAD_ORDER)
