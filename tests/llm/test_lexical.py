import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from feedloom.llm import lexical
from feedloom.llm.lexical import Shard, best, encode_shard, ranked_search

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return PATTERN.findall((text or "").translate(FOLD))


def brute_force(docs, items, k):
    """Every score by the formula, in Python's integers."""
    counted = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    counted = [(doc_id, c) for doc_id, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    out = []
    for item_id, text in set(items):
        scores = []
        for doc_id, c in counted:
            m, score = 50 + 50 * sum(c.values()) * n_docs // n_terms, 0
            for term in set(terms(text)):
                df = sum(term in other for _, other in counted)
                if c[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    score += w * (1_000_000_000 * c[term] // (1000 * c[term] + 20 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def searched(spark, docs, items, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    asked = spark.createDataFrame(items, "item_id long, text string")
    extra = [lexical.F.lit("x").alias(name) for name in ("query", "term", "score", "rank", "path")]
    got = ranked_search(df.select("*", *extra), asked.select("*", *extra), **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def corpus(n, seed=3):
    chance = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(chance.choices(words, weights, k=chance.randrange(1, 120)))) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"prime": 1}, {"block_terms": 20}])
def test_search_against_brute_force(spark, options):
    docs = corpus(300)
    docs += [(1000 + i, docs[i][1]) for i in range(40)]
    chance = random.Random(4)
    items = [(i, " ".join(chance.choices([f"w{j}" for j in range(320)], k=12))) for i in range(25)]
    items += [(25, "w0"), (26, "nothing of it"), (27, ""), (28, None), (None, "w1 w2"), (0, items[0][1]), (3, "w5 w250")]
    assert searched(spark, docs, items, k=10, **options) == brute_force(docs, items, 10)


def test_odd_documents(spark, cases):
    docs = [(r[0], r[1]) for r in cases.rows] + [(20, "ÀÉ É"), (21, "É k İ K"), (22, "a_b-c\x7fd e")]
    items = [(1, "plain WORDS the fox"), (2, "É İ"), (3, "日本語のテキスト"), (4, "d e b"), (5, cases.long)]
    assert searched(spark, docs, items, k=50) == brute_force(docs, items, 50)


def test_no_documents_or_no_items(spark):
    assert searched(spark, [], [(1, "w1")]) == []
    assert searched(spark, [(1, None), (2, " ")], [(1, "w1")]) == []
    assert searched(spark, [(1, "w1")], []) == []


def one_shard(docs):
    words, codes_of = [], {}
    held, codes, tfs, lengths = [], [], [], []
    for _, text in docs:
        c = Counter(lexical.terms_of(text.encode()))
        codes += [codes_of.setdefault(w, len(codes_of)) for w in c]
        tfs += c.values()
        held.append(len(c))
        lengths.append(sum(c.values()))
    words = list(codes_of)
    content = encode_shard([d for d, _ in docs], lengths, held, np.array(codes), np.array(tfs), words)
    return Shard(content, len(docs), sum(lengths)), {w: codes.count(i) for w, i in codes_of.items()}


def test_a_shard_reads_back_and_rejects_blocks_before_decoding():
    docs = corpus(6000, seed=9)
    shard, dfs = one_shard(docs)
    for term in (b"w0", b"w7", b"w299"):
        p = shard.postings(term)
        p.decode(range(len(p.last)))
        want = [(i, c) for i, (_, text) in enumerate(docs) if (c := text.split().count(term.decode()))]
        assert p.docs.tolist() == [i for i, _ in want]
        m = shard.m[p.docs]
        assert p.impacts.tolist() == [1_000_000_000 * c // (1000 * c + 20 * int(x)) for (_, c), x in zip(want, m)]
        assert all(p.impacts[b * 128 : b * 128 + 128].max() <= x for b, x in enumerate(p.block_max))
    fresh, _ = one_shard(docs)
    query = [(w, lexical.weight(len(docs), dfs[w])) for w in (b"w0", b"w1", b"w2", b"w250", b"w280", b"w299")]
    places, scores = best(fresh, query, 10, window=256)
    everything = np.zeros(len(docs), np.int64)
    for term, w in query:
        p = shard.postings(term)
        p.decode(range(len(p.last)))
        everything[p.docs] += w * p.impacts
    order = np.lexsort((np.arange(len(docs)), -everything))[:10]
    assert places.tolist() == order.tolist() and scores.tolist() == everything[order].tolist()
    common = fresh.postings(b"w0")
    assert common.decoded.mean() < 0.8
    assert best(fresh, query, 10, floor=int(scores[-1]))[1].tolist() == [s for s in scores.tolist() if s > scores[-1]]


def test_term_frequencies_of_any_size():
    docs = [(i, "a " * n + "b") for i, n in enumerate((1, 255, 256, 65_535, 65_536, 70_000))]
    shard, _ = one_shard(docs)
    p = shard.postings(b"a")
    p.decode(range(len(p.last)))
    assert p.impacts.tolist() == [1_000_000_000 * n // (1000 * n + 20 * int(m)) for n, m in zip((1, 255, 256, 65_535, 65_536, 70_000), shard.m)]
