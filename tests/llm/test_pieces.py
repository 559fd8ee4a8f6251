import random

import numpy as np
import pyarrow as pa

from feedloom.llm import pieces as module
from feedloom.llm.pieces import SPACE, NBest, alternative, decode_pieces, encode_pieces
from feedloom.llm.queries import PIECES


def brute(text, pieces):
    """All segmentations and their scores."""
    text, out = (" " + text).replace(" ", SPACE), {}

    def go(at, score, ids):
        if at == len(text):
            out[tuple(ids)] = score
            return
        if text[at] not in pieces.scored:
            go(at + 1, score + pieces.unknown, ids + list(pieces.fallback(text[at])))
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in pieces.scored:
                go(end, score + pieces.scored[text[at:end]][0], ids + [pieces.scored[text[at:end]][1]])

    go(0, 0.0, [])
    return out


def test_n_best_against_all_segmentations():
    rng = random.Random(1)
    texts = ["the cat", "hello  wor", "a", "日x ", "\n🙂é ab", " x", "aa aa", "x.y,z"]
    texts += ["".join(rng.choice("the an.") for _ in range(9)) for _ in range(15)]
    for n in (1, 2, 5):
        encoder = NBest(PIECES, n)
        for text in texts:
            every = brute(text, encoder.pieces)
            ids, count, scores, changes = encoder.encode(text)
            ids = np.frombuffer(ids, "<u4").tolist()
            assert count == len(ids)
            assert np.allclose(scores, sorted(every.values(), reverse=True)[:n])
            ways = [tuple(ids), *(tuple(alternative(ids, c)) for c in changes)]
            assert len(set(ways)) == len(ways) == len(scores)
            assert np.allclose([every[w] for w in ways], scores)


def test_texts_come_back(cases):
    encoded = encode_pieces(cases.docs(), PIECES)
    back = sorted((r.doc_id or -1, r.text) for r in decode_pieces(encoded, PIECES).collect())
    assert back == sorted((row[0] or -1, row[1] or "") for row in cases.rows)
    assert encode_pieces(cases.empty(), PIECES).count() == 0


def test_a_text_without_spaces_is_bounded():
    ids, count, scores, _ = NBest(PIECES, 4).encode("abcde" * 4000)
    assert count == len(ids) // 4 and len(scores) == 4 and scores == sorted(scores, reverse=True)


def test_words_of_a_block_are_solved_together(monkeypatch):
    rng, alone = random.Random(2), []
    words = ["".join(rng.choice(["the", "ing", "ou", "er", "a", "n", ".", "日", "aa"]) for _ in range(rng.randrange(1, 6))) for _ in range(3000)]
    texts = [" ".join(words[at : at + 60]) for at in range(0, len(words), 60)] + [None, "", "  ", " a  b ", "x" * 65]
    solve = module.n_best
    monkeypatch.setattr(module, "n_best", lambda word, *more: alone.append(word) or solve(word, *more))
    encoder = NBest(PIECES, 4)
    done = list(encoder.encode_all(pa.array(texts, pa.large_string())))
    assert len(alone) < len(set(words)) / 3
    assert done == [encoder.encode(text or "") for text in texts]
    assert done[-5] == done[-4] == (b"", 0, [0.0], [])
    trie = module._Trie(encoder.pieces)
    for word in sorted({SPACE + word.replace("日", "n") for word in words}):
        scores, ids, number = trie.solve(np.array([[ord(c) for c in word]]))
        ways = solve(word, encoder.pieces, 3)
        assert np.allclose(scores[: len(ways), 0], [way[0] for way in ways], rtol=0, atol=1e-9)
        if len(ways) < 2 or ways[0][0] - ways[1][0] > 1e-9:
            assert scores[0, 0] == ways[0][0] and ids[0, : number[0]].tobytes() == ways[0][1]
