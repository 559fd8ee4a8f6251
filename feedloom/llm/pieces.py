"""N-best segmentation by a SentencePiece file, and decoding."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.common import kept, record

# Fixed values of the format: the mark that stands for a space, and what an unknown
# character costs beyond the worst piece.
SPACE = "▁"
UNKNOWN_PENALTY = 10.0

# Texts are encoded in blocks of about so many bytes, their words in groups of one length up
# to ``_LONGEST``. Ways whose scores differ by less than ``_CLOSE`` are put in order by `n_best`.
_BLOCK, _WORDS, _LONGEST, _CLOSE = 1 << 22, 1 << 14, 64, 1e-9
_CHANGES = "array<array<struct<at:int,drop:int,ids:array<int>>>>"
_ENCODED = f"doc_id long, ids binary, n_pieces long, scores array<double>, changes {_CHANGES}"
_CHANGE_TYPE = pa.list_(
    pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))]))
)


class Pieces:
    """The pieces of a model file and what each is worth.

    Scores of a unigram file are log probabilities. A BPE file has merge ranks instead:
    there the piece of rank r gets Zipf's probability 1 / (r H), H making them add to one.
    Byte pieces spell out characters that are no piece. Nothing is trained.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        self.spelt = [b""] * len(ids)
        self.byte_ids: dict[int, int] = {}
        raw: dict[str, tuple[float, int]] = {}
        for i in ids:
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
                self.spelt[i] = bytes([int(piece[3:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                raw[piece] = (model.get_score(i), i)
                self.spelt[i] = piece.replace(SPACE, " ").encode()
        if all(score <= 0 and score == int(score) for score, _ in raw.values()):
            whole = sum(1 / max(1.0, -score) for score, _ in raw.values())
            raw = {p: (-math.log(max(1.0, -score) * whole), i) for p, (score, i) in raw.items()}
        self.scored = raw
        #: A node has, by character, the next node and the piece that ends there, if one does.
        self.trie: dict[str, list] = {}
        for piece, (score, i) in raw.items():
            node, step = self.trie, [None, None]
            for character in piece:
                step = node.setdefault(character, [{}, None])
                node = step[0]
            step[1] = (score, i.to_bytes(4, "little"))
        self.unknown = min(score for score, _ in raw.values()) - UNKNOWN_PENALTY
        # A text falls apart before a space unless a piece has one after another character.
        self.falls_apart = not any(SPACE in piece.lstrip(SPACE) for piece in raw)
        #: Characters that stand next to each other in some piece.
        self.neighbours = {pair for piece in raw for pair in zip(piece, piece[1:], strict=False)}

    def fallback(self, character: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in character.encode("utf-8", "replace"))


class _Trie:
    """The trie of some pieces as arrays, by which many words are walked at once."""

    def __init__(self, pieces: Pieces):
        edges, worth, ids, nodes = [], [-math.inf], [0], [pieces.trie]
        for at, node in enumerate(nodes):
            for character, (below, piece) in node.items():
                edges.append((at << 21 | ord(character), len(nodes)))
                nodes.append(below)
                worth.append(piece[0] if piece else -math.inf)
                ids.append(int.from_bytes(piece[1], "little") if piece else 0)
        edges = np.array(sorted(edges), np.int64).reshape(-1, 2)
        self._keys, self._below = np.append(edges[:, 0], np.iinfo(np.int64).max), np.append(edges[:, 1], 0)
        self._worth, self._ids = np.array(worth), np.array(ids, np.uint32)
        self._deepest = max(map(len, pieces.scored))
        self.single = np.array(sorted(ord(piece) for piece in pieces.scored if len(piece) == 1), np.int64)

    def solve(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words of one length, a row of characters each: best scores, pieces of the best, their number.

        There are the three best scores, added up from the end like those of `n_best`, and
        therefore the same to the last bit. Characters must be pieces themselves.
        """
        count, length = words.shape
        best = np.full((length + 1, 3, count), -np.inf)
        best[length, 0] = 0.0
        ends, ids = np.zeros((length, count), np.int64), np.zeros((length, count), np.uint32)
        every = np.arange(count)
        for begin in range(length - 1, -1, -1):
            here, rows, node = best[begin], every, np.zeros(count, np.int64)
            for end in range(begin + 1, min(length, begin + self._deepest) + 1):
                key = node << 21 | words[rows, end - 1]
                at = np.searchsorted(self._keys, key)
                found = self._keys[at] == key
                rows, node = rows[found], self._below[at[found]]
                if not len(rows):
                    break
                worth = self._worth[node]
                piece = worth > -np.inf
                own = rows[piece]
                c1, c2, c3 = best[end][:, own] + worth[piece]
                b1, b2, b3 = here[:, own]
                higher = c1 > b1
                ends[begin, own[higher]] = end
                ids[begin, own[higher]] = self._ids[node[piece][higher]]
                low, high = np.minimum(b1, c1), np.maximum(b1, c1)
                third = np.maximum(np.maximum(b3, c3), np.maximum(np.minimum(b1, c2), np.minimum(b2, c1)))
                here[:, own] = high, np.maximum(low, np.maximum(b2, c2)), third
        out, number = np.zeros((count, length), np.uint32), np.zeros(count, np.int64)
        rows, at = every, np.zeros(count, np.int64)
        while len(rows):
            out[rows, number[rows]] = ids[at, rows]
            number[rows] += 1
            at = ends[at, rows]
            rows, at = rows[at < length], at[at < length]
        return best[0], out, number


def _ragged(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Stretches of the values, one after another."""
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(begins - before, lengths) + np.arange(lengths.sum())]


def _distinct(content: bytes | np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of stretches of bytes, equal ones having the same, and the distinct ones: their bytes and bounds."""
    buffers = [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(content)]
    encoded = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, buffers).dictionary_encode()
    _, bounds, content = encoded.dictionary.buffers()
    bounds = np.frombuffer(bounds, np.int64, len(encoded.dictionary) + 1)
    return encoded.indices.to_numpy(), np.frombuffer(content or b"", np.uint8), bounds


def n_best(text: str, pieces: Pieces, n: int) -> list[tuple[float, bytes]]:
    """The ``n`` segmentations of highest score, best first: (score, ids as 32-bit integers).

    A forward Viterbi pass over the lattice gives every place the best score up to it.
    That is exactly what is still to be had from there, so a backward A* search that adds
    it to what it has scored from the end takes complete segmentations off its heap in
    order. Of equal ones the search order decides, which is the same in every run.
    """
    best = [0.0] + [-math.inf] * len(text)
    arcs: list[list[tuple[int, float, bytes]]] = [[] for _ in range(len(text) + 1)]
    scored, trie = pieces.scored, pieces.trie
    for begin, character in enumerate(text):
        here = best[begin]
        if character not in scored:
            spelt = np.array(pieces.fallback(character), "<u4").tobytes()
            arcs[begin + 1].append((begin, pieces.unknown, spelt))
            best[begin + 1] = max(best[begin + 1], here + pieces.unknown)
        node = trie
        for end in range(begin, len(text)):
            step = node.get(text[end])
            if step is None:
                break
            node, piece = step
            if piece is not None:
                worth, ids_of = piece
                arcs[end + 1].append((begin, worth, ids_of))
                if here + worth > best[end + 1]:
                    best[end + 1] = here + worth
    found, count = [], 0
    heap: list[tuple] = [(-best[-1], len(text), 0, 0.0, None)]
    # Scores of disjoint sets of segmentations seen so far, the n best of them: what is
    # below all of these is not among the n best.
    seen = [best[-1]]
    while heap and len(found) < n:
        _, at, _, score, path = heapq.heappop(heap)
        if at == 0:
            ids = []
            while path is not None:
                ids.append(path[0])
                path = path[1]
            found.append((score, b"".join(ids)))
            continue
        goes_on = False
        for begin, worth, ids_of in arcs[at]:
            total = score + worth
            to_have = best[begin] + total
            if not goes_on and best[begin] + worth == best[at]:
                goes_on = True  # the best of what was already seen
            elif len(seen) < n:
                heapq.heappush(seen, to_have)
            elif to_have > seen[0]:
                heapq.heapreplace(seen, to_have)
            elif to_have < seen[0] - 1e-6:
                continue
            count += 1
            heapq.heappush(heap, (-to_have, begin, count, total, (ids_of, path)))
    return found


def _joined(ways: list[list], n: int) -> list[tuple[float, bytes]]:
    """The n best of a text from the n best of parts it falls into."""
    out = ways[0]
    for more in ways[1:]:
        sums = [(a[0] + b[0], a[1] + b[1]) for a in out for b in more]
        out = heapq.nlargest(n, sums, key=lambda way: way[0])
    return out


class _Ways(dict):
    """The n best of words, each solved alone, of which at most ``most`` are kept."""

    def __init__(self, pieces: Pieces, n: int, most: int, longest: int = 40):
        self._pieces, self._n, self._most, self._longest = pieces, n, most, longest

    def __missing__(self, word: str) -> list:
        found = n_best(word, self._pieces, self._n)
        if len(word) <= self._longest:
            if len(self) >= self._most:
                self.clear()
            self[word] = found
        return found


class _Parts:
    """The distinct parts of some texts: ids and number of their best, its score and what the second best loses.

    Parts fall apart into words where no piece joins two characters. Each distinct word is
    solved once, those of one length together. What such a pass cannot tell apart by its
    scores, and words that are long or hold a character that is no piece, are solved alone.
    """

    def __init__(self, content: np.ndarray, bounds: np.ndarray, trie: _Trie, joined: np.ndarray, ways: _Ways):
        self._ways, self._alone = ways, {}
        self._chars = np.frombuffer(content[: bounds[-1]].tobytes().decode().encode("utf-32-le"), "<u4").astype(np.int64)
        self._chars[self._chars == 32] = ord(SPACE)
        # A byte that goes on with a character begins none.
        before = np.append(0, np.cumsum(content[: bounds[-1]] & 0xC0 != 0x80))
        pairs = self._chars[:-1] << 21 | self._chars[1:]
        cuts = np.ones(len(self._chars) + 1, bool)
        cuts[1:-1] = joined[np.searchsorted(joined, pairs)] != pairs
        cuts[before[bounds]] = True
        self._cuts = np.flatnonzero(cuts)
        self._first = np.searchsorted(self._cuts, before[bounds])
        wide = self._chars.astype("<u4").tobytes()
        codes, words, word_bounds = _distinct(wide, 4 * self._cuts)
        ids, lengths, best, second = self._solved(np.frombuffer(words, "<u4").astype(np.int64), word_bounds // 4, trie)
        number = lengths[codes]
        self.ids = _ragged(ids, (np.cumsum(lengths) - lengths)[codes], number)
        ends = np.append(0, np.cumsum(number))
        self.begins = ends[self._first[:-1]]
        self.number = ends[self._first[1:]] - self.begins
        count = np.diff(self._first)
        self.score, after = best[codes[self._first[:-1]]], second[codes[self._first[:-1]]]
        rows = np.flatnonzero(count > 1)
        place = 1
        while len(rows):
            word = codes[self._first[rows] + place]
            score = self.score[rows]
            after[rows] = np.maximum(score + second[word], after[rows] + best[word])
            self.score[rows] = score + best[word]
            place += 1
            rows = rows[count[rows] > place]
        self.loss = self.score - after

    def _solved(self, chars: np.ndarray, bounds: np.ndarray, trie: _Trie) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word the ids, one after another, their number, the best and second best score."""
        length = np.diff(bounds)
        single = np.append(trie.single, 0)
        known = single[np.searchsorted(trie.single, chars)] == chars
        alone = (length > _LONGEST) | ~np.logical_and.reduceat(known, bounds[:-1])
        number, best, second = np.zeros(len(length), np.int64), np.zeros(len(length)), np.zeros(len(length))
        rows, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for size in np.unique(length[~alone]).tolist():
            every = np.flatnonzero((length == size) & ~alone)
            for at in range(0, len(every), _WORDS):
                own = every[at : at + _WORDS]
                scores, pieces, number[own] = trie.solve(chars[bounds[own][:, None] + np.arange(size)])
                with np.errstate(invalid="ignore"):
                    alone[own] = (-np.diff(scores, axis=0) < _CLOSE).any(axis=0)
                best[own], second[own] = scores[0], scores[1]
                told = np.where(alone[own], 0, number[own])
                rows.append(np.repeat(own, told))
                ids.append(pieces[np.arange(size) < told[:, None]])
        for word in np.flatnonzero(alone).tolist():
            spelt = _spelt(chars[bounds[word] : bounds[word + 1]])
            ways = self._alone[spelt] = self._ways[spelt]
            ids.append(np.frombuffer(ways[0][1], "<u4"))
            number[word], best[word] = len(ids[-1]), ways[0][0]
            second[word] = ways[1][0] if len(ways) > 1 else -np.inf
            rows.append(np.full(len(ids[-1]), word))
        return np.concatenate(ids)[np.argsort(np.concatenate(rows), kind="stable")], number, best, second

    def ways(self, part: int, n: int) -> list[tuple[float, bytes]]:
        cuts = self._cuts[self._first[part] : self._first[part + 1] + 1].tolist()
        words = [_spelt(self._chars[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        return _joined([self._alone.get(word) or self._ways[word] for word in words], n)


def _spelt(chars: np.ndarray) -> str:
    return chars.astype("<u4").tobytes().decode("utf-32-le")


class NBest:
    """N-best segmentation of whole texts; ``most`` bounds the words a worker keeps."""

    def __init__(self, path: str, n: int, most: int = 100_000):
        self.pieces, self.n = Pieces(path), n
        self._trie, self._ways = _Trie(self.pieces), _Ways(self.pieces, n, most)
        pairs = sorted(ord(a) << 21 | ord(b) for a, b in self.pieces.neighbours)
        self._joined = np.array([*pairs, np.iinfo(np.int64).max])

    def encode(self, text: str) -> tuple[bytes, int, list[float], list]:
        """(ids, pieces, scores of the n best, changes that make each from the best)."""
        return next(self.encode_all(pa.array([text], pa.large_string())))

    def encode_all(self, texts: pa.LargeStringArray) -> Iterator[tuple[bytes, int, list[float], list]]:
        """What :meth:`encode` returns of each text, null ones being empty.

        A text falls apart before its spaces, and the n best of the whole are sums of the
        n best of its parts. Only the n - 1 parts that lose least can differ in them.
        """
        filled = pc.greater(pc.binary_length(texts.fill_null("")), 0)
        nothing, space = (pa.scalar(text, pa.large_string()) for text in ("", " "))
        led = pc.binary_join_element_wise(nothing, texts.filter(filled), space)
        if not len(led):
            yield from ((b"", 0, [0.0], []) for _ in range(len(texts)))
            return
        bounds = np.frombuffer(led.buffers()[1], np.int64)[led.offset : led.offset + len(led) + 1]
        content = np.frombuffer(led.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        cuts = np.zeros(len(content) + 1, bool)
        if self.pieces.falls_apart:
            blank = content == 32
            cuts[1:-1] = blank[1:] & ~blank[:-1]
        cuts[bounds] = True
        cuts = np.flatnonzero(cuts)
        first = np.searchsorted(cuts, bounds)
        codes, part_content, part_bounds = _distinct(content, cuts)
        parts = _Parts(part_content, part_bounds, self._trie, self._joined, self._ways)
        number = parts.number[codes]
        ids = _ragged(parts.ids, parts.begins[codes], number)
        ends = np.append(0, np.cumsum(number))
        scores, losses, known = parts.score[codes], parts.loss[codes], {}
        at = iter(zip(first.tolist(), first[1:].tolist(), strict=False))
        for has in filled.to_pylist():
            if not has:
                yield b"", 0, [0.0], []
                continue
            a, b = next(at)
            score = math.fsum(scores[a:b].tolist())
            least = np.sort(a + np.argsort(losses[a:b], kind="stable")[: self.n - 1]).tolist()
            sums: list[tuple[float, tuple]] = [(0.0, ())]
            for place in least:
                code = int(codes[place])
                ways = known.get(code) or known.setdefault(code, parts.ways(code, self.n))
                more = [
                    (loss + ways[0][0] - way[0], (*chosen, (place, k)) if k else chosen)
                    for loss, chosen in sums
                    for k, way in enumerate(ways)
                ]
                sums = heapq.nsmallest(self.n, more)
            changes = [
                [
                    {
                        "at": int(ends[place] - ends[a]),
                        "drop": int(number[place]),
                        "ids": np.frombuffer(known[codes[place]][k][1], "<u4").tolist(),
                    }
                    for place, k in chosen
                ]
                for _, chosen in sums[1:]
            ]
            yield ids[ends[a] : ends[b]].astype("<u4").tobytes(), int(ends[b] - ends[a]), [score - loss for loss, _ in sums], changes


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about ``_BLOCK`` bytes of texts each, or one text."""
    for batch in batches:
        before = np.append(0, np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(), dtype=np.int64))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(before, before[first] + _BLOCK, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def alternative(ids: list[int], changes: list[dict]) -> list[int]:
    """The ids of another segmentation, made from those of the best."""
    out, at = [], 0
    for change in changes:
        out += ids[at : change["at"]] + change["ids"]
        at = change["at"] + change["drop"]
    return out + ids[at:]


def encode_pieces(docs: DataFrame, model_path: str, n: int = 4) -> DataFrame:
    """Segment every whole text of ``doc_id, text``, a null text being empty.

    Returns ``doc_id``, ``ids`` of the best segmentation as unsigned little-endian 32-bit
    integers, ``n_pieces``, ``scores`` of the ``n`` best (fewer where there are fewer) and
    ``changes``, by which `alternative` makes the second and later ones. A text is what
    the file's own normaliser makes of it: a space in front, spaces marked, nothing else.
    An empty text has no pieces. Other columns are not read; nothing is shuffled.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("pieces", model_path, n), lambda: NBest(model_path, n))
        kinds = {"ids": pa.binary(), "n_pieces": pa.int64(), "scores": pa.list_(pa.float64()), "changes": _CHANGE_TYPE}
        for batch in _blocks(batches):
            done = list(encoder.encode_all(batch.column("text").cast(pa.large_string())))
            columns = {"doc_id": batch.column("doc_id")}
            columns |= {name: [d[i] for d in done] for i, name in enumerate(kinds)}
            yield record(columns, kinds)

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return wanted.mapInArrow(encode, _ENCODED)


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` with ``text`` spelt from its ``ids``, which go; null ids give an empty text.

    Pieces are spelt out as bytes, marks become spaces and the one in front goes. Bytes
    that are no UTF-8, which encoding never makes, become the replacement character.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Encoding may share this worker and its turn, so its cache is left alone.
        spelt = Pieces(model_path).spelt
        for batch in batches:
            done = []
            for ids in batch.column("ids").to_pylist():
                whole = b"".join(map(spelt.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))
                done.append(whole.decode("utf-8", "replace").removeprefix(" "))
            at = batch.schema.get_field_index("ids")
            yield batch.set_column(at, "text", pa.array(done, pa.string()))

    fields = [T.StructField("text", T.StringType()) if f.name == "ids" else f for f in encoded.schema]
    return encoded.mapInArrow(decode, T.StructType(fields))
