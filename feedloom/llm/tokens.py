"""Token ids of whole texts by a byte-level BPE file of the tokenizers library.

Byte-level BPE first cuts a text into words and merges inside them only. The library
spends most of its time on the cutting, so that is done here for texts in Latin letters,
and the library's model merges each word that a worker does not remember. Texts with other
letters are left to the library as a whole, whose own tables of letters decide there; so
are those with the name of an added token, such as <|endoftext|>, which has an id of its
own.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from feedloom.llm.common import kept

# The file's pattern of words, spelt out for the Latin letters and numbers,
# and the printable bytes that the byte-level alphabet keeps.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
_WORD = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+"
    rf"| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+"
)
_OTHER = re.compile(r"[^\t\n\r -~¡-ɏ]")
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]

# The other bytes follow from 256 on, in their order.
_ALPHABET = {b: chr(b) for b in _KEPT}
_ALPHABET |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _ALPHABET)}

# Between a space that follows no white space and the next, no word reaches across.
_SPACE_AFTER_SPACE = tuple(blank + " " for blank in " \t\n\r\x0b\x0c")

# White space here but not for the library.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def _left_to_library(text: str) -> bool:
    if text.isascii():
        return any(sign in text for sign in _SEPARATORS)
    return _OTHER.search(text) is not None


class _Words(dict):
    """Ids of words, each merged by the library's model where it is not remembered.

    Two generations of at most ``most`` / 2 words: what is asked for again moves to the
    young one, and when that is full the old one goes.
    """

    def __init__(self, model, dtype: str, most: int, longest: int):
        self._tokenize, self._half, self._longest = model.tokenize, most // 2, longest
        self._packed = "<%dH" if dtype == "<u2" else "<%dI"
        self._old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = self._old.get(word)
        if found is None:
            if word.isascii() and word.isprintable():
                spelt = word.replace(" ", _ALPHABET[32])
            else:
                spelt = word.encode().decode("latin-1").translate(_ALPHABET)
            ids = [token.id for token in self._tokenize(spelt)]
            found = struct.pack(self._packed % len(ids), *ids)
        if len(word) <= self._longest:
            if len(self) >= self._half:
                self._old = dict(self)
                self.clear()
            self[word] = found
        return found


class WordEncoder:
    """Ids as little-endian bytes, ``dtype`` being the narrowest that holds the vocabulary.

    Texts are cut at spaces, and only the distinct stretches of a block of texts are cut
    into words; numpy puts the ids of the block together. ``most`` bounds the words that a
    worker remembers and ``block`` the characters of a block beside its last text; both
    change speed and nothing else. With ``added``, the name of an added token in a text has
    the token's id, as by the library's own call; else it is ordinary text.
    """

    def __init__(
        self,
        path: str,
        most: int = 500_000,
        longest: int = 40,
        added: bool = False,
        block: int = 1 << 21,
    ):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = not added
        tokens = self._library.get_added_tokens_decoder().values() if added else ()
        self._names = tuple(token.content for token in tokens)
        self.dtype = dtype_for(self._library.get_vocab_size())
        self._words = _Words(self._library.model, self.dtype, most, longest)
        self._block = block

    def encode(self, texts: list[str]) -> list[bytes]:
        found = [b""] * len(texts)
        block: list[int] = []
        size = 0
        for at, text in enumerate(texts):
            if _left_to_library(text) or any(name in text for name in self._names):
                ids = self._library.encode(text, add_special_tokens=False).ids
                found[at] = np.array(ids, self.dtype).tobytes()
            elif any(pair in text for pair in _SPACE_AFTER_SPACE):
                found[at] = self._cut(text)
            else:
                block.append(at)
                size += len(text)
            if block and (size > self._block or at == len(texts) - 1):
                for i, ids in zip(block, self._block_of([texts[i] for i in block]), strict=True):
                    found[i] = ids
                block, size = [], 0
        return found

    def _cut(self, text: str) -> bytes:
        return b"".join(map(self._words.__getitem__, _WORD.findall(text)))

    def _stretches(self, stretches: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The ids of the words of stretches, and the first word of each.

        Each stretch follows a space and does not end in white space, so the words that
        begin with a space are the first ones.
        """
        words = _WORD.findall(" " + " ".join(stretches))
        first = np.fromiter((word[0] == " " for word in words), bool, len(words))
        return list(map(self._words.__getitem__, words)), np.flatnonzero(first)

    def _block_of(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, none of which has white space before a space."""
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        bounds = cut.offsets.to_numpy()
        coded = cut.values.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # White space ends a text only, and what a text begins with follows no space: these
        # get entries of their own.
        ids, first = self._stretches([s if s and not s[-1].isspace() else "-" for s in distinct])
        own, places = [], []
        for text, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            begin, space, _ = text.partition(" ")
            own.append(self._cut(begin))
            places.append(a)
            if space and text[-1].isspace():
                own.append(self._cut(text[text.rindex(" ") :]))
                places.append(b - 1)
        codes[places] = len(distinct) + np.arange(len(own))
        first = np.append(first, len(ids) + np.arange(len(own)))
        ids += own
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(self.dtype).itemsize
        lengths = np.add.reduceat(size, first)
        starts = (np.cumsum(size) - size)[first]
        pool = np.frombuffer(b"".join(ids), self.dtype)
        ends = np.append(0, np.cumsum(lengths[codes]))[bounds]
        whole = np.empty(ends[-1], self.dtype)
        at = 0
        for begin in range(0, len(codes), 1 << 18):
            some = codes[begin : begin + (1 << 18)]
            n = lengths[some]
            before = np.cumsum(n) - n
            total = int(n.sum())
            whole[at : at + total] = pool[np.repeat(starts[some] - before, n) + np.arange(total)]
            at += total
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield whole[a:b].tobytes()


def stored_dtype(path: str) -> str:
    """The ``dtype`` of a file's ids, without keeping an encoder."""
    return dtype_for(Tokenizer.from_file(path).get_vocab_size())


def dtype_for(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def encoder(path: str) -> WordEncoder:
    """This worker's encoder of a file."""
    return kept(("words", path), lambda: WordEncoder(path, added=True))
