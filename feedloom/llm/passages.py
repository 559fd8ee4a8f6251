"""Removal of passages that repeat across documents, by sliding spans of sentences and words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import kept, small, spread
from feedloom.operators.skew import HOT_SHARE, join_by_key
from feedloom.session import materialize

_BOUNDARY = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")
_RANGES = "array<struct<first:int,last:int>>"
_WORD = re.compile(r"\S+")  # what str.split() gives

# Places that share a mark: a span (``last`` its last sentence) or runs of words that begin
# one after another from word ``first`` on (``last`` -1), with a digest of 8 bytes for
# each. What is equal has the same mark and the same digest.
_PLACES = "mark long, share int, doc_id long, tie long, first int, last int, digests binary"
_DECIDED = "doc_id long, tie long, first int, last int, span boolean, h1 long, h2 long"

# Which marks repeat is sent to all tasks in a table of 32 bits for each, rounded up, in
# pieces of so many. Two marks that share a bit cost rows and change no result.
_FEWEST, _MOST, _PIECE = 1 << 24, 1 << 29, 1 << 20
# A mark with fewer places than this is left to one task.
_COLD = 4_000
# Texts are read in blocks of about so many bytes, and so many runs go into a row.
_BLOCK, _TOGETHER = 1 << 20, 128

_SPACES = [c for c in range(0x10000) if chr(c).isspace()]
_BLANK, _LEADS, _STOPS = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[c for c in _SPACES if c < 128]] = True
_WIDE = [chr(c).encode() for c in _SPACES if c >= 128]
_LEADS[[c[0] for c in _WIDE]] = True
_WIDE = np.array([int.from_bytes(c.ljust(3, b"\0"), "big") for c in _WIDE], np.uint32)
_STOPS[list(b".!?")] = True
# The first so many bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_A, _B, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def sentences(text: str) -> list[tuple[int, int]]:
    """Where a text's sentences begin and end, each with the white space after it.

    A sentence ends with a line, or with a stop before white space. Together they are the
    whole text.
    """
    cuts = [0, *(m.end() for m in _BOUNDARY.finditer(text)), len(text)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values * _A
    values ^= values >> np.uint64(29)
    values *= _B
    values ^= values >> np.uint64(32)
    return values


def _blanks(content: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 texts are of white space, which is what `str.split` splits at."""
    blank = _BLANK[content]
    at = np.flatnonzero(_LEADS[content])
    if len(at):
        after = np.append(content, [0, 0]).astype(np.uint32)
        three = content[at] >= 0xE0
        code = (after[at] << 16) | (after[at + 1] << 8) | np.where(three, after[at + 2], 0)
        found = np.isin(code, _WIDE)
        at, three = at[found], three[found]
        blank[at] = blank[at + 1] = True
        blank[at[three] + 2] = True
    return blank


def _hashes(content: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from eight bytes at a time; long words by the library."""
    length = ends - starts
    hashes = _mixed(length.astype(np.uint64) + _A)
    padded = np.append(content, np.zeros(8, np.uint8))
    eight = np.ndarray(len(content) + 1, "<u8", padded, strides=(1,))
    at, left, own = starts, length, None
    for _ in range(8):
        chunk = eight[at] & _FIRST[np.minimum(left, 8)]
        if own is None:
            hashes = _mixed(hashes ^ chunk)
        else:
            hashes[own] = _mixed(hashes[own] ^ chunk)
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        own = more if own is None else own[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(length > 64).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(content[starts[i] : ends[i]].tobytes())
    return hashes


class _Block:
    """The words of some texts: their hashes, and the first of each text."""

    def __init__(self, content: np.ndarray, offsets: np.ndarray):
        filled = offsets[1:] > offsets[:-1]
        begins, ends = offsets[:-1][filled], offsets[1:][filled] - 1
        blank = _blanks(content)
        ink = ~blank
        first, last = ink.copy(), ink.copy()
        first[1:] &= blank[:-1]
        last[:-1] &= blank[1:]
        first[begins], last[ends] = ink[begins], ink[ends]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.hashes = _hashes(content, starts, ends)
        self.first = np.searchsorted(starts, offsets)
        self.owner = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self._lines = np.searchsorted(lines := np.flatnonzero(content == 10), starts)
        self._lines_before = np.searchsorted(lines, offsets)
        self._stops = _STOPS[content[ends - 1]]

    def spans(self, least: int, words: int, enough: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Of each span its text, first and last sentence and digest; see :func:`spans`."""
        count, lines = len(self.hashes), self._lines
        if not count:
            return self.owner, self.owner, self.owner, []
        begins = np.ones(count, bool)
        begins[1:] = self._stops[:-1] | (lines[1:] > lines[:-1])
        texts = self.first[:-1][np.diff(self.first) > 0]
        begins[texts] = True
        before = np.append(np.flatnonzero(begins), count)
        own = self.owner[before[:-1]]
        at = np.searchsorted(before[:-1], self.first)
        i = np.arange(len(own))
        enough_at, words_at = (np.searchsorted(before, before[:-1] + n) for n in (enough, words))
        to = np.minimum(enough_at, np.maximum(i + least, words_at))
        good = to <= at[own + 1]
        enough_at, words_at = (np.searchsorted(before, before[1:] - n, "right") - 1 for n in (enough, words))
        since = np.maximum(enough_at, np.minimum(i + 1 - least, words_at))
        other = since >= at[own]
        other[other] = ~(good[since[other]] & (to[since[other]] == i[other] + 1))
        first, last = np.concatenate([i[good], since[other]]), np.concatenate([to[good], i[other] + 1])
        marked = self.hashes.copy()
        marked[before[1:] - 1] ^= _LAST
        content = memoryview(marked.tobytes())
        digests = [xxhash.xxh3_128_digest(content[a:b]) for a, b in zip((8 * before[first]).tolist(), (8 * before[last]).tolist(), strict=True)]
        owner = own[first]
        # White space that holds a line's end before the first word is a sentence of its own.
        blank = np.zeros(len(self.first) - 1, np.int64)
        blank[own[at[:-1][np.diff(at) > 0]]] = lines[texts] > self._lines_before[:-1][np.diff(at) > 0]
        lead = blank[owner] - at[owner]
        return owner, first + lead, last - 1 + lead, digests

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The grams, where a run of ``size`` words begins, and the least hash of the grams of each run.

        A gram is up to 16 words in a row. Equal runs have equal least hashes, whatever is
        around them.
        """
        grams, width = self.hashes, 1
        if len(grams) < size:
            return grams[:0], np.zeros(0, np.int64), grams[:0]
        while width < 16 and width * 2 <= size:
            grams = grams[:-width] * _A + grams[width:] * _B
            grams ^= grams >> np.uint64(31)
            width *= 2
        least = _least(grams, size - width + 1)
        end = self.first[1:][self.owner]
        at = np.flatnonzero(np.arange(len(least)) + size <= end[: len(least)])
        return grams[np.arange(len(grams)) + width <= end[: len(grams)]], at, least[at]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, _Block]]:
    """Slices of batches with about ``_BLOCK`` bytes of texts each, or one text."""
    for batch in small(batches):
        column = batch.column("text").cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        buffers = column.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
        content = np.frombuffer(buffers[2] or b"", np.uint8)
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _BLOCK, "right")) - 1)
            last = min(last, batch.num_rows)
            own = offsets[first : last + 1]
            yield batch.slice(first, last - first), _Block(content[own[0] : own[-1]], own - own[0])
            first = last


def spans(text: str, least: int, words: int, enough: int) -> list[tuple[int, int, bytes]]:
    """Runs of consecutive sentences: (first, last, digest of their words).

    A run goes on until it has ``least`` sentences and ``words`` words, or ``enough``
    words in fewer sentences. There is the shortest such run from every sentence on and
    the shortest up to every sentence, so in a shared passage no sentence at either end
    is left out. White space between words does not count.
    """
    content = np.frombuffer(text.encode(), np.uint8)
    _, first, last, digests = _Block(content, np.array([0, len(content)])).spans(least, words, enough)
    return list(zip(first.tolist(), last.tolist(), digests, strict=True))


def _repeated(docs: DataFrame, by: tuple[int, int, int] | None, size: int | None) -> DataFrame:
    """What of each document repeated spans and runs cover, but for their first places.

    ``by`` is what a span needs, ``size`` the words of a run. Returns ``doc_id, tie, ranges,
    runs``, null where there is none. The mark of a span is half of its digest of 128 bits, that
    of a run the least of its grams, beside a digest of 64 bits. First the places of the marks are counted; then only what has a
    repeated mark is shuffled, all runs around one gram as one row. Rows of a mark are put
    in order and a task sees which are not the first; of a mark and a document it tells the
    stretches that these cover, not each place. A mark with many places is dealt out by
    documents; what a task cannot tell of it alone, the first places it has and what repeats
    in their documents, is compared once more.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("passages",), dict)  # nothing, in the place of what another stage has kept
        for _, block in _blocks(batches):
            marks, places = [], []
            if by:
                digests = np.frombuffer(b"".join(block.spans(*by)[3]), "<i8")[::2]
                distinct, n = np.unique(digests, return_counts=True)
                marks.append(distinct)
                places.append(n)
            if size:
                grams, _, least = block.runs(size)
                distinct, n = np.unique(grams, return_counts=True)
                at = np.searchsorted(distinct, np.unique(least))
                marks.append(distinct[at].view(np.int64))
                places.append(n[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(marks)), pa.array(np.concatenate(places).astype(np.int64))], names=["mark", "n"]
            )

    def table(group: pa.Table) -> pa.Table:
        bits = np.zeros(_PIECE, np.uint8)
        bits[group.column("bit").to_numpy() % _PIECE] = 1
        return pa.table({"piece": group.column("piece").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()])})

    wanted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), tie_of(F.col("text")).alias("tie"), F.col("text").cast("string").alias("text")
    )
    marks = materialize(
        wanted.mapInArrow(mark, "mark long, n long").groupBy("mark").agg(F.sum("n").alias("n")).where("n > 1"), "passages-marks"
    )
    distinct, total = marks.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    size_of_table = min(_MOST, max(_FEWEST, 1 << (32 * distinct).bit_length()))
    bit = F.pmod("mark", F.lit(size_of_table))
    placed_at = marks.select(bit.alias("bit"), F.expr(f"pmod(mark, {size_of_table}L) div {_PIECE}").alias("piece")).distinct()
    repeats = np.zeros(size_of_table // 8, np.uint8)
    for piece, bits in placed_at.groupBy("piece").applyInArrow(table, "piece long, bits binary").collect():
        repeats[piece * _PIECE // 8 : (piece + 1) * _PIECE // 8] = np.frombuffer(bits, np.uint8)
    # Fewer than a million, and a task holds what differs of one.
    hot = [row[0] for row in marks.where(F.col("n") > max(_COLD, total // 1_000_000)).select("mark").collect()]
    sent = docs.sparkSession.sparkContext.broadcast((repeats, np.sort(np.array(hot, np.int64))))
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("passages",), dict)
        repeats, hot = sent.value

        def again(marks: np.ndarray) -> np.ndarray:
            at = marks % size_of_table
            return (repeats[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1

        for batch, block in _blocks(batches):
            if by:
                owner, first, last, digests = block.spans(*by)
                digests = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                chosen = again(digests[:, 0])
                digests = digests[chosen]
                each = np.arange(len(digests) + 1)
                yield _placed(batch, hot, shares, digests[:, 0], owner[chosen], first[chosen], last[chosen], each, digests[:, 1].tobytes())
            if size:
                _, at, least = block.runs(size)
                least = least.view(np.int64)
                chosen = again(least)
                at, least = at[chosen], least[chosen]
                content = memoryview(block.hashes.tobytes())
                digests = [xxhash.xxh3_64_intdigest(content[i : i + 8 * size]) for i in (8 * at).tolist()]
                digests = np.array(digests, np.uint64).tobytes()
                owner = block.owner[at]
                breaks = np.ones(len(at), bool)
                breaks[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
                heads = np.flatnonzero(breaks)
                behind = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
                heads = np.flatnonzero(behind % _TOGETHER == 0)
                owner, first = owner[heads], at[heads] - block.first[owner[heads]]
                yield _placed(batch, hot, shares, least[heads], owner, first, np.full(len(heads), -1), np.append(heads, len(at)), digests)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("passages",), dict)
        known = None
        for batch in batches:
            if batch.num_rows:
                known, decided = _decided(known, batch, size or 0)
                yield decided

    order = ["mark", "share", F.col("doc_id").asc_nulls_last(), "tie", "first"]
    placed = spread(wanted.mapInArrow(cut, _PLACES), "mark", "share").sortWithinPartitions(*order)
    found = placed.mapInArrow(decide, _DECIDED)
    names = ["doc_id", "tie", "first", "last", "span"]
    if hot:
        found = materialize(found, "passages-found")
        more = _again(found.where("h1 IS NOT NULL"))
        own = ~F.col("span") & F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("tie") == F.col("kept.tie"))
        behind = F.when(own, F.greatest("first", F.col("kept.first") + (size or 0))).otherwise(F.col("first")).cast("int")
        more = more.withColumn("first", behind).where("first <= last")
        found = found.where("h1 IS NULL").select(*names).unionByName(more.select(*names))
    one = F.struct("first", "last")
    ranges = found.groupBy("doc_id", "tie").agg(
        F.collect_set(F.when(F.col("span"), one)).alias("ranges"), F.collect_set(F.when(~F.col("span"), one)).alias("runs")
    )
    merged = [F.when(F.size(name) > 0, _merged(F.array_sort(name))).alias(name) for name in ("ranges", "runs")]
    return materialize(ranges.select("doc_id", "tie", *merged), "passages-repeated")


def _placed(
    batch: pa.RecordBatch,
    hot: np.ndarray,
    shares: int,
    marks: np.ndarray,
    owner: np.ndarray,
    first: np.ndarray,
    last: np.ndarray,
    bounds: np.ndarray,
    digests: bytes,
) -> pa.RecordBatch:
    """Rows of ``_PLACES``, ``owner`` being their rows in the batch and ``bounds`` those of their digests."""
    doc_ids, ties = (batch.column(name).take(pa.array(owner)) for name in ("doc_id", "tie"))
    share = np.full(len(marks), -1, np.int32)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, marks), len(hot) - 1)
        document = doc_ids.fill_null(0).to_numpy().view(np.uint64) * _A ^ ties.to_numpy().view(np.uint64)
        share = np.where(hot[at] == marks, (_mixed(document) % np.uint64(shares)).astype(np.int32), share)
    bounds = pa.py_buffer((8 * bounds).astype(np.int32).tobytes())
    columns = [
        pa.array(np.ascontiguousarray(marks)),
        pa.array(share),
        doc_ids,
        ties,
        pa.array(first.astype(np.int32)),
        pa.array(last.astype(np.int32)),
        pa.Array.from_buffers(pa.binary(), len(marks), [None, bounds, pa.py_buffer(digests)]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["mark", "share", "doc_id", "tie", "first", "last", "digests"])


def _decided(known: dict | None, batch: pa.RecordBatch, size: int) -> tuple[dict, pa.RecordBatch]:
    """Rows of ``_DECIDED`` from sorted rows of ``_PLACES``: what is not the first of its digest.

    Places of a mark that overlap or follow one another in a document are one row. With a
    digest are rows of hot marks of which this task cannot tell. ``known`` has the first
    places of the last mark of the rows before; what is returned has those of this
    batch's last mark, one for each digest, which are all that a later batch may need.
    """
    mark, share, tie, first, last = (batch.column(name).to_numpy() for name in ("mark", "share", "tie", "first", "last"))
    doc_id = batch.column("doc_id").fill_null(0).to_numpy()
    missing = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
    column = batch.column("digests")
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    digests = np.frombuffer(column.buffers()[2], "<i8", (bounds[-1] - bounds[0]) // 8, bounds[0])
    count = np.diff(bounds) // 8
    row = np.repeat(np.arange(len(mark)), count)
    group = np.append(0, np.cumsum((mark[1:] != mark[:-1]) | (share[1:] != share[:-1])))
    span = last >= 0
    columns = {
        "digest": digests,
        "group": group[row],
        "doc_id": doc_id[row],
        "missing": missing[row],
        "tie": tie[row],
        "first": first[row].astype(np.int64) + np.arange(len(row)) - (bounds[:-1] - bounds[0])[row] // 8,
    }
    old = 0
    if known is not None and known["of"] == (mark[0], share[0]):
        old = len(known["group"])
        columns = {name: np.concatenate([known[name], values]) for name, values in columns.items()}
    digest, group = columns["digest"], columns["group"]
    order = np.argsort(digest, kind="stable")
    equal = digest[order][1:] == digest[order][:-1]
    same = equal & (group[order][1:] == group[order][:-1])
    if (equal != same).any():
        order = np.lexsort((digest, group))
        same = (digest[order][1:] == digest[order][:-1]) & (group[order][1:] == group[order][:-1])
    head = np.append(True, ~same)
    origin = np.empty(len(order), np.int64)
    origin[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    leads = origin == np.arange(len(origin))
    own = np.logical_and.reduce([columns[name] == columns[name][origin] for name in ("doc_id", "missing", "tie")])
    behind = columns["first"][origin] + size
    again = ~(own & (columns["first"] == columns["first"][origin]))
    known = {name: values[leads & (group == group[-1])] for name, values in columns.items()}
    known = known | {"of": (mark[-1], share[-1]), "group": np.zeros(len(known["group"]), np.int64)}
    leads, own, behind, again = leads[old:], own[old:], behind[old:], again[old:]
    begin = columns["first"][old:]
    span_of, hot = span[row], share[row] >= 0
    end = np.where(span_of, last[row], begin + size - 1)
    open_ = np.flatnonzero(hot & (leads | (again & own & ~span_of)))
    again &= ~(hot & own & ~span_of)
    begin_behind = np.where(own & ~span_of, np.maximum(begin, behind), begin)
    told = np.flatnonzero(again & (begin_behind <= end))
    f, l, r = begin_behind[told], end[told], row[told]
    turns = [values[1:] != values[:-1] for values in (mark, share, doc_id, missing, tie, span)]
    stretch = np.append(0, np.cumsum(np.logical_or.reduce(turns)))[r]
    breaks = np.ones(len(told), bool)
    breaks[1:] = (stretch[1:] != stretch[:-1]) | (f[1:] > l[:-1] + 1)
    heads = np.flatnonzero(breaks)
    if len(heads):
        f, l, r = np.minimum.reduceat(f, heads), np.maximum.reduceat(l, heads), r[heads]
    rows = pa.array(np.concatenate([r, row[open_]]))
    none = pa.nulls(len(r), pa.int64())
    halves = [pa.concat_arrays([none, pa.array(values)]) for values in (mark[row[open_]], digests[open_])]
    columns = [
        batch.column("doc_id").take(rows),
        batch.column("tie").take(rows),
        pa.array(np.concatenate([f, begin[open_]]).astype(np.int32)),
        pa.array(np.concatenate([l, end[open_]]).astype(np.int32)),
        pa.array(span).take(rows),
        *halves,
    ]
    return known, pa.RecordBatch.from_arrays(columns, names=["doc_id", "tie", "first", "last", "span", "h1", "h2"])


def repeated_runs(docs: DataFrame, size: int) -> DataFrame:
    """Words of each document that a repeated run of ``size`` words covers, but for its first place.

    Like :func:`repeated_spans`, the ranges being of word numbers. A run begins and ends
    at any word. Of a run that overlaps its own first place, only what lies behind that
    place counts.
    """
    return _repeated(docs, None, size).select("doc_id", "tie", F.col("runs").alias("ranges"))


def repeated_spans(docs: DataFrame, least: int = 3, words: int = 15, enough: int = 50) -> DataFrame:
    """Sentences of each document that a repeated span covers, but for its first place.

    ``docs`` has ``doc_id, text``. Returns ``doc_id, tie, ranges`` for the documents that
    have any: ranges of sentence numbers, both ends included. ``tie`` is a hash of the
    text, for numbers that stand for several texts. A span's first place is in the
    smallest ``doc_id`` (a missing one comes last), then the smallest ``tie``, then the
    first in the text; repeated rows are one document here.
    """
    return _repeated(docs, (least, words, enough), None).select("doc_id", "tie", "ranges")


def _again(placed: DataFrame) -> DataFrame:
    """The places of repeated spans but for the first, which is in ``kept``."""
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "tie", "first")
    often = materialize(
        placed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("kept")).where("n > 1"),
        "passages-often",
    )
    hot = often.where(F.col("n") * HOT_SHARE > placed.count())
    # By a shuffle at any size: what repeats grows with the corpus.
    return join_by_key(
        placed, often.drop("n"), ["h1", "h2"], "inner", ["doc_id", "first"], fits=False, hot=hot
    ).where(place != F.col("kept"))


def _merged(ranges: Column) -> Column:
    """Sorted ranges, those that overlap or follow one another as one."""

    def add(done: Column, one: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["first"].alias("first"), F.greatest(last["last"], one["last"]).alias("last"))
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))
        return F.when(one["first"] <= last["last"] + 1, joined).otherwise(F.concat(done, F.array(one)))

    return F.aggregate(ranges, F.array().cast(_RANGES), add)


def tie_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _without(text: pd.Series, ranges: pd.Series, runs: pd.Series) -> pd.DataFrame:
    """The text without the sentences and words in the ranges, and what was removed."""
    kept, gone = [], []
    for content, own, inner in zip(text, ranges, runs, strict=True):
        if content is None or (own is None and inner is None):
            kept.append(content)
            gone.append([])
            continue
        cut = sentences(content)
        parts = [(cut[r["first"]][0], cut[r["last"]][1]) for r in (own if own is not None else [])]
        if inner is not None:
            at = [m.span() for m in _WORD.finditer(content)]
            # The white space behind a run goes with it.
            ends = [a for a, _ in at[1:]] + [len(content)]
            parts += [(at[r["first"]][0], ends[r["last"]]) for r in inner]
        joined: list[list[int]] = []
        for a, b in sorted(parts):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        edges = [0, *(x for part in joined for x in part), len(content)]
        kept.append("".join(content[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        gone.append([content[a:b] for a, b in joined])
    return pd.DataFrame({"text": kept, "removed": gone})


def drop_repeated_passages(
    docs: DataFrame,
    least: int = 3,
    words: int = 15,
    enough: int = 50,
    report: str | None = "removed",
    anywhere: int | None = None,
) -> DataFrame:
    """``docs`` without repeated passages, those taken out being in the column ``report``.

    The report takes the place of a column of that name; None makes none. All other
    columns stay, and so do all rows: a document that consists of repeated
    passages ends with an empty text. Texts without a repeated span, null ones among
    them, are as they were. Short sentences repeat by chance, so only spans of ``least``
    sentences and ``words`` words, or of ``enough`` words, count. With ``anywhere``, runs
    of that many words count as well, wherever in a sentence they begin and end.
    """
    ranges = _repeated(docs, (least, words, enough), anywhere)
    names = ["_id", "_tie"]
    ranges = ranges.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("tie").alias("_tie"),
        F.struct("ranges", "runs").alias("_ranges"),
    )
    rows = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
        tie_of(F.col("text")).alias("_tie"),
    )
    joined = join_by_key(rows, ranges, names, "left", names)
    touched, text = F.col("_ranges").isNotNull(), F.col("row").getField("text").cast("string")
    without = F.pandas_udf(_without, "text string, removed array<string>")
    done = joined.withColumn("_done", without(F.when(touched, text), F.col("_ranges.ranges"), F.col("_ranges.runs")))
    kept = [
        F.when(touched, F.col("_done.text")).otherwise(text).alias(name)
        if name == "text"
        else F.col("row").getField(name).alias(name)
        for name in docs.columns
        if name != report
    ]
    if report:
        kept.append(F.coalesce("_done.removed", F.array().cast("array<string>")).alias(report))
    return done.select(*kept)
