import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from feedloom.llm.packing import pack, shortest_pack_first
from feedloom.llm.queries import BYTE_BPE
from feedloom.llm.tokens import WordEncoder, encoder
from feedloom.llm.wavelet import (
    WaveletFile,
    count_tokens,
    encode_shard,
    locate_tokens,
    read_tokens,
    write_tokens,
)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    tokenizer.encode_special_tokens = True
    return tokenizer


HARD = ["", "a\x1cb c", "x\x0b y", "\x00 \x7f", "  a  b", "a \n\nb ", "x\n \ny", "日本 語", "It's we'll", "<|endoftext|> hi", "a\tb c", " lead", "x² 3.5"]


def test_words_are_encoded_as_by_the_library(library, cases):
    encoder = WordEncoder(BYTE_BPE, most=3)
    for text in [*HARD, *(row[1] or "" for row in cases.rows)]:
        ids = np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("block", [1, 50, 1 << 21])
def test_blocks_of_texts_are_encoded_as_by_the_library(library, block):
    rng = np.random.default_rng(block)
    signs = ["a", "Bc", "é", " ", " ", " ", "\n", "\t", "'s", "12", "²", ".", "!?", "-", "\x0b", "日", "\x1d", "the"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(3000)] + HARD
    encoder = WordEncoder(BYTE_BPE, most=200, longest=4, block=block)
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        found = np.frombuffer(ids, encoder.dtype).tolist()
        assert found == library.encode(text, add_special_tokens=False).ids, text
    assert encoder.encode([]) == [] and encoder.encode([""]) == [b""]


def test_the_operators_ids_are_those_of_an_untouched_library():
    plain, own = Tokenizer.from_file(BYTE_BPE), encoder(BYTE_BPE)
    named = ["<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|><|endoftext|>\n", "日本<|endoftext|>", "<|endoftext |>"]
    for text in [*HARD, *named]:
        ids = np.frombuffer(own.encode([text])[0], own.dtype).tolist()
        assert ids == plain.encode(text, add_special_tokens=False).ids
    assert 50256 in plain.encode(named[1], add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(20))
def test_packs_are_full_and_every_token_is_placed(seed):
    rng = np.random.default_rng(seed)
    capacity = 64
    histogram = {int(n): int(rng.integers(1, 40)) for n in rng.integers(1, capacity, rng.integers(1, 30))}
    slots = shortest_pack_first(histogram, capacity)
    packs, tails = {}, {}
    for tail, low, high, start, length, first, offset in slots:
        for k in range(high - low):
            packs.setdefault(first + k, []).append((offset, length))
            tails.setdefault((tail, low + k), []).append((start, length))
    for places in [*packs.values(), *tails.values()]:
        end = 0
        for at, length in sorted(places):
            assert at == end
            end += length
    assert {k: sum(n for _, n in v) for k, v in tails.items()} == {
        (n, r): n for n, c in histogram.items() for r in range(c)
    }
    used = [sum(n for _, n in places) for places in packs.values()]
    assert max(used) <= capacity and len(packs) == -(-sum(used) // capacity)


def test_pack(cases, library):
    pieces = pack(cases.docs(), BYTE_BPE).collect()
    expected = sorted(
        (row[0] or -1, library.encode(row[1] or "", add_special_tokens=False).ids + [0]) for row in cases.rows
    )
    assert sum(p.length for p in pieces) == sum(len(ids) for _, ids in expected)
    sequences = {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        own = np.frombuffer(p.ids, "<u4").tolist()
        assert any(
            doc == (p.doc_id or -1) and len(ids) == p.doc_tokens and ids[p.start : p.start + p.length] == own
            for doc, ids in expected
        )
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    used = []
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        used.append(end)
    assert sum(1024 - n for n in used) < 1024
    assert pack(cases.empty(), BYTE_BPE).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000, 9000):
        ids = (rng.zipf(1.3, n) % 50257).astype("<u4")
        content = encode_shard(ids, [5, None], [n // 2, n - n // 2], block_bits=1024)
        file = WaveletFile(lambda offset, length, content=content: content[offset : offset + length])
        assert (file.decode() == ids).all() and file.doc_ids == [5, None]
        assert [file.access(i) for i in range(0, n, 97)] == ids[::97].tolist()
        for token in (1, 2, 50000, 70000):
            at = np.flatnonzero(ids == token)
            assert file.count(token) == len(at)
            assert file.count(token, n // 3, n // 2) == ((at >= n // 3) & (at < n // 2)).sum()
            assert [file.locate(token, j) for j in range(min(5, len(at)))] == at[:5].tolist()


def test_tokens_round_trip(cases, library):
    manifest = write_tokens(cases.docs(), BYTE_BPE, end_id=2, shard_tokens=1000)
    rows = sorted(read_tokens(manifest).collect(), key=lambda row: row.start)
    assert [r.doc_id for r in rows] == sorted((r[0] for r in cases.rows), key=lambda i: (i is not None, i))
    texts = {}
    for row in cases.rows:
        texts.setdefault(row[0], []).append(library.encode(row[1] or "", add_special_tokens=False).ids + [2])
    at = 0
    for row in rows:
        ids = np.frombuffer(row.ids, "<u4").tolist()
        assert ids in texts[row.doc_id] and row.start == at and row.n_tokens == len(ids)
        assert row.ids_crc32 == zlib.crc32(row.ids)
        at += len(ids)
    assert manifest.count() > 1
    whole = np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows])
    token = int(np.bincount(whole).argmax())
    assert sum(r.n for r in count_tokens(manifest, [token]).collect()) == (whole == token).sum()
    found = sorted(r.position for r in locate_tokens(manifest, token).collect())
    assert found == np.flatnonzero(whole == token).tolist()
    assert read_tokens(write_tokens(cases.empty(), BYTE_BPE)).count() == 0
