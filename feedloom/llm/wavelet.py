"""Token ids of a corpus in wavelet-matrix files: access, counting and lookup in place."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.llm.common import kept, open_file, record, rows, small, spread, texts, write_file
from feedloom.llm.tokens import encoder
from feedloom.session import materialize, scratch_path

# The file: a header, the documents, then for each bit from the highest a plane with its
# number of zeros and, by block, the place of its bytes and the ones before it. All
# numbers are little-endian.
MAGIC = b"WVMTRX01"
_HEADER = struct.Struct("<8sQQQQQ")  # magic, tokens, documents, bits, bits in a block, bytes of documents
_MANIFEST = "part int, shard int, path string, n_docs long, n_tokens long, n_bytes long"
_MANIFEST_TYPES = pa.schema(
    [
        ("part", pa.int32()),
        ("shard", pa.int32()),
        ("path", pa.string()),
        ("n_docs", pa.int64()),
        ("n_tokens", pa.int64()),
        ("n_bytes", pa.int64()),
    ]
)
_DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def encode_shard(ids: np.ndarray, doc_ids: list, lengths: list[int], block_bits: int = 1 << 16) -> bytes:
    """One file's bytes: the ids of whole documents, one after the other."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    values = ids.astype("<u2" if bits <= 16 else "<u4")
    press = zstandard.ZstdCompressor(level=1).compress
    known = np.array([i is not None for i in doc_ids], np.uint8)
    numbers = np.array([i or 0 for i in doc_ids], "<i8")
    docs = zlib.compress(known.tobytes() + numbers.tobytes() + np.array(lengths, "<u8").tobytes(), 1)
    out = [_HEADER.pack(MAGIC, len(values), len(doc_ids), bits, block_bits, len(docs)), docs]
    directories, bodies, at = [], [], 0
    step = block_bits // 8
    for k in reversed(range(bits)):
        ones = (values >> k & 1).astype(bool)
        packed = np.packbits(ones, bitorder="little")
        blocks = [press(packed[i : i + step].tobytes()) for i in range(0, len(packed), step)]
        counts = np.bitwise_count(packed)
        held = np.add.reduceat(counts, np.arange(0, len(packed), step), dtype=np.int64) if len(ones) else []
        places = at + np.concatenate([[0], np.cumsum([len(b) for b in blocks])])
        before = np.concatenate([[0], np.cumsum(held)])
        directories.append(
            np.array([len(ones) - int(before[-1]), *places, *before], "<u8").tobytes()
        )
        bodies += blocks
        at = int(places[-1])
        values = np.concatenate([np.compress(~ones, values), np.compress(ones, values)])
    return b"".join(out + directories + bodies)


class WaveletFile:
    """A file opened through ``read(offset, length)``; only the blocks asked for are read."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self._read = read
        magic, self.n, self.n_docs, self.bits, self.block_bits, n = _HEADER.unpack(read(0, _HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        docs = zlib.decompress(read(_HEADER.size, n)) if n else b""
        known = np.frombuffer(docs, np.uint8, self.n_docs)
        numbers = np.frombuffer(docs, "<i8", self.n_docs, self.n_docs)
        self.doc_ids = [int(i) if k else None for i, k in zip(numbers, known, strict=True)]
        lengths = np.frombuffer(docs, "<u8", self.n_docs, self.n_docs * 9)
        #: The first token of each document, and the end of the last.
        self.starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        blocks = -(-self.n // self.block_bits)
        width, at = 8 * (2 * blocks + 3), _HEADER.size + n
        self._body = at + width * self.bits
        tables = np.frombuffer(read(at, width * self.bits), "<u8").astype(np.int64)
        tables = tables.reshape(self.bits, 2 * blocks + 3)
        self._zeros = tables[:, 0]
        self._places = tables[:, 1 : blocks + 2]
        self._ranks = tables[:, blocks + 2 :]
        self._unpress = zstandard.ZstdDecompressor().decompress
        self._seen: dict[tuple[int, int], np.ndarray] = {}

    def _block(self, plane: int, block: int) -> np.ndarray:
        if (plane, block) not in self._seen:
            if len(self._seen) >= 64:
                self._seen.clear()
            first, end = self._places[plane, block : block + 2]
            packed = np.frombuffer(self._unpress(self._read(int(self._body + first), int(end - first))), np.uint8)
            count = min(self.block_bits, self.n - block * self.block_bits)
            self._seen[plane, block] = np.unpackbits(packed, count=count, bitorder="little")
        return self._seen[plane, block]

    def _rank1(self, plane: int, i: int) -> int:
        """Ones of a plane before position ``i``."""
        block, rest = divmod(i, self.block_bits)
        before = int(self._ranks[plane, block])
        return before + (int(self._block(plane, block)[:rest].sum()) if rest else 0)

    def _select(self, plane: int, bit: int, j: int) -> int:
        """The position of the ``j``-th such bit of a plane, from 0."""
        ranks = self._ranks[plane]
        if not bit:
            ranks = np.minimum(np.arange(len(ranks)) * self.block_bits, self.n) - ranks
        block = int(np.searchsorted(ranks, j, side="right")) - 1
        found = np.flatnonzero(self._block(plane, block) == bit)
        return block * self.block_bits + int(found[j - int(ranks[block])])

    def access(self, i: int) -> int:
        """The token at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for plane in range(self.bits):
            bit = int(self._block(plane, i // self.block_bits)[i % self.block_bits])
            ones = self._rank1(plane, i)
            i = int(self._zeros[plane]) + ones if bit else i - ones
            token = token << 1 | bit
        return token

    def _range(self, token: int, first: int, end: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for plane in range(self.bits):
            low, high = self._rank1(plane, first), self._rank1(plane, end)
            if token >> (self.bits - 1 - plane) & 1:
                first, end = int(self._zeros[plane]) + low, int(self._zeros[plane]) + high
            else:
                first, end = first - low, end - high
        return first, end

    def count(self, token: int, first: int = 0, end: int | None = None) -> int:
        """How often a token stands in positions ``first`` up to ``end``."""
        low, high = self._range(token, first, self.n if end is None else end)
        return high - low

    def locate(self, token: int, j: int) -> int:
        """The position of the ``j``-th occurrence of a token, from 0."""
        first, end = self._range(token, 0, self.n)
        if not 0 <= j < end - first:
            raise IndexError(j)
        at = first + j
        for plane in reversed(range(self.bits)):
            bit = token >> (self.bits - 1 - plane) & 1
            at = self._select(plane, bit, at - int(self._zeros[plane]) if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids in order, as unsigned 32-bit integers."""
        values = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for plane in reversed(range(self.bits)):
            places = self._places[plane]
            body = self._read(int(self._body + places[0]), int(places[-1] - places[0]))
            cuts = places - places[0]
            packed = b"".join(self._unpress(body[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
            ones = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n, bitorder="little").astype(bool)
            zeros = int(self._zeros[plane])
            above = np.empty_like(values)
            above[~ones] = values[:zeros]
            above[ones] = values[zeros:] | values.dtype.type(1 << (self.bits - 1 - plane))
            values = above
        return values.astype("<u4")


def opened(path: str) -> WaveletFile:
    file = open_file(path)
    return WaveletFile(lambda offset, length: file.read_at(length, offset))


def write_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    shard_tokens: int = 1 << 22,
    folder: str | None = None,
) -> DataFrame:
    """Encode ``doc_id, text`` and write the ids as wavelet-matrix files under ``folder``.

    Documents go in ascending ``doc_id`` order, rows without a number first and equal
    numbers in the order of a hash of their texts; a null text is empty. Each document
    ends with ``end_id``. A task owns a range of numbers and starts a new file after
    ``shard_tokens``, so its memory is bounded by one file and one document.

    Returns the manifest, one row per file with ``start``, the ids in all files before
    it. A file's name holds the task attempt, and only attempts that ended are in the
    manifest: files that a lost executor left behind are never read.
    """
    folder = folder or scratch_path(docs.sparkSession, "tokens")

    names = ("part", "shard", "path", "n_docs", "n_tokens", "n_bytes")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode = TaskContext.get(), encoder(tokenizer_path)
        end, width = np.array([end_id], encode.dtype).tobytes(), np.dtype(encode.dtype).itemsize
        shard, total, held, doc_ids, lengths = 0, 0, [], [], []

        def flushed() -> pa.RecordBatch:
            content = encode_shard(np.frombuffer(b"".join(held), encode.dtype), doc_ids, lengths)
            path = f"{folder}/shard-{task.partitionId():06d}-{shard:04d}-{task.taskAttemptId()}.wvm"
            write_file(path, content)
            values = (task.partitionId(), shard, path, len(doc_ids), total, len(content))
            return pa.RecordBatch.from_pylist([dict(zip(names, values, strict=True))], _MANIFEST_TYPES)

        for batch in small(batches):
            numbers = batch.column("doc_id").to_pylist()
            for doc_id, ids in zip(numbers, encode.encode(texts(batch)), strict=True):
                held.append(ids + end)
                doc_ids.append(doc_id)
                lengths.append(len(held[-1]) // width)
                total += lengths[-1]
                if total >= shard_tokens:
                    yield flushed()
                    shard, total, held, doc_ids, lengths = shard + 1, 0, [], [], []
        if held:
            yield flushed()

    order = ["doc_id", "_tie"]
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    files = materialize(ordered.mapInArrow(write, _MANIFEST), "tokens-manifest")
    # Files before in the same task, and tasks before: one row per task in the one window.
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    return files.withColumn("own", own).join(parts, "part").select(
        *files.columns, (F.col("before") + F.col("own")).alias("start")
    )


def read_tokens(manifest: DataFrame, ids: bool = True) -> DataFrame:
    """Every document in the files of a manifest: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it. With ``ids`` the rows carry their
    ``ids`` as unsigned little-endian 32-bit integers. One task reads one file at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("wavelet",), dict)  # nothing, in the place of the encoder
        for file in rows(batches):
            found = opened(file["path"])
            values, cuts = memoryview(found.decode()).cast("B"), found.starts * 4
            for first in range(0, found.n_docs, 4096):
                at = range(first, min(first + 4096, found.n_docs))
                own = [values[cuts[i] : cuts[i + 1]] for i in at]
                columns = {
                    "doc_id": pa.array(found.doc_ids[first : first + 4096], pa.int64()),
                    "start": pa.array(file["start"] + found.starts[at.start : at.stop]),
                    "n_tokens": pa.array(np.diff(found.starts[at.start : at.stop + 1])),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64()),
                }
                if ids:
                    columns["ids"] = pa.array([x.tobytes() for x in own], pa.binary())
                yield record(columns, {})

    schema = _DOCS + (", ids binary" if ids else "")
    return spread(manifest.select("path", "start"), "path").mapInArrow(read, schema)


def count_tokens(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """How often each of a few tokens occurs in each file: ``path, token, n``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file in rows(batches):
            found = opened(file["path"])
            counts = [found.count(token) for token in tokens]
            columns = {"path": [file["path"]] * len(tokens), "token": tokens, "n": counts}
            yield record(columns, {"path": pa.string(), "token": pa.int64(), "n": pa.int64()})

    return spread(manifest.select("path"), "path").mapInArrow(count, "path string, token long, n long")


def locate_tokens(manifest: DataFrame, token: int) -> DataFrame:
    """Every occurrence of a token: ``doc_id, position``, the position in the corpus."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file in rows(batches):
            found = opened(file["path"])
            for first in range(0, found.count(token), 4096):
                at = [found.locate(token, j) for j in range(first, min(first + 4096, found.count(token)))]
                docs = np.searchsorted(found.starts, at, side="right") - 1
                columns = {
                    "doc_id": [found.doc_ids[i] for i in docs],
                    "position": [file["start"] + i for i in at],
                }
                yield record(columns, {"doc_id": pa.int64(), "position": pa.int64()})

    return spread(manifest.select("path", "start"), "path").mapInArrow(locate, "doc_id long, position long")
