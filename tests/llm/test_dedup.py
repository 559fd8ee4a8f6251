import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from feedloom.llm.components import components
from feedloom.llm.exact import directory, drop_exact_duplicates, exact_duplicates
from feedloom.llm.minhash import _similar, choose_bands, drop_near_duplicates, gram_set, near_duplicates
from feedloom.llm import passages
from feedloom.llm.queries import op10_passages
from feedloom.llm.passages import drop_repeated_passages, sentences, spans


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("hash_bits", [63, 1])
def test_exact_duplicates(cases, hash_bits):
    """With one bit of hash all texts share two chains and bytes decide."""
    groups = defaultdict(list)
    for row in cases.rows:
        groups[norm(row[1])].append(row)
    found = exact_duplicates(cases.docs(), hash_bits=hash_bits, bucket_keys=2).collect()
    assert len(found) == len(cases.rows)
    for row in found:
        group = next(g for n, g in groups.items() if hashlib.sha256(n.encode()).hexdigest() == row.text_sha256)
        best = min(group, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0]))
        assert (row.keep_id, row.group_size) == (best[0], len(group))
    assert sum(row.kept for row in found) == len(groups)
    assert exact_duplicates(cases.empty()).count() == 0


def test_exact_duplicates_are_dropped(cases):
    docs = cases.docs()
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(norm(r.text) for r in kept.collect()) == sorted({norm(r[1]) for r in cases.rows})
    assert drop_exact_duplicates(cases.empty()).count() == 0


def test_directory_splits_overfull_buckets(spark):
    keys = spark.createDataFrame([(i,) for i in [*range(8), 64, 128]], "key long")
    slots = {r.slot: (r.bucket, r.local_depth) for r in directory(keys, 8, 4).collect()}
    # 0-7 need a sixth bit; 64 and 128 are alone at their shorter prefixes.
    assert slots == {0: (0, 6), 1: (1, 6), 16: (16, 2), 32: (32, 1)}


def grams(text):
    words = (text or "").split()
    width = min(5, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else frozenset()


def brute(rows, threshold=0.8):
    """(class, links) by doc_id, null numbers last."""
    sets = defaultdict(list)
    for i, row in enumerate(rows):
        sets[grams(row[1])].append(i)
    keys = list(sets)
    root = list(range(len(keys)))
    links = [0] * len(keys)
    for a in range(len(keys)):
        for b in range(a):
            if keys[a] and keys[b] and len(keys[a] & keys[b]) / len(keys[a] | keys[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    members = defaultdict(list)
    for k, key in enumerate(keys):
        members[root[k]] += [rows[i][0] for i in sets[key]]
    least = {r: min(m, key=lambda i: (i is None, i)) for r, m in members.items()}
    return sorted(
        ((rows[i][0], least[root[k]], links[k], len(sets[key])) for k, key in enumerate(keys) for i in sets[key]),
        key=str,
    )


def test_near_duplicates(cases):
    base = [f"t{i}" for i in range(60)]
    rows = list(cases.rows)
    for k in range(40):  # a chain and a bunch of near copies
        words = list(base)
        words[k % 30] = f"other{k}"
        rows.append((100 + k, " ".join(words), "en", "a", 1))
    found = near_duplicates(cases.docs(rows)).collect()
    assert sorted(((r.doc_id, r.class_id, r.links, r.copies) for r in found), key=str) == brute(rows)
    assert near_duplicates(cases.empty()).count() == 0


def test_near_duplicates_are_dropped(cases):
    docs = cases.docs()
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    classes = {row[1] if row[1] is not None else "null" for row in brute(cases.rows)}
    assert kept.count() == len(classes)
    assert drop_near_duplicates(cases.empty()).count() == 0


def test_large_blocks_agree_with_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(1 << 63, size=300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) < 0.93], rng.integers(1 << 63, size=9, dtype=np.uint64)])) for _ in range(60)]
    mask = np.triu(np.ones((60, 60), bool), 1)
    found = {tuple(p) for p in _similar(sets, mask, 0.8)}
    expected = {
        (i, j)
        for i in range(60)
        for j in range(i + 1, 60)
        if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8
    }
    assert found == expected and found


def test_bands_reach_the_recall():
    bands, rows = choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999
    assert len(gram_set("a b c")) == 1 and len(gram_set("")) == 0


def test_components(spark):
    chain = [(str(i), str(i + 1)) for i in range(100, 180)]
    star = [("z", f"z{i}") for i in range(50)]
    edges = spark.createDataFrame(chain + star, "a string, b string")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert len(roots) == 81 + 51
    assert set(roots.values()) == {"100", "z"}


def test_repeated_passages(cases):
    docs = cases.docs()
    out = drop_repeated_passages(docs)
    assert sorted(out.columns) == sorted(docs.columns)
    by = {(r.doc_id, r.lang): r for r in out.collect() if r.doc_id not in (7, 9)}
    assert cases.passage.strip() in by[8, "en"].text and by[8, "en"].removed == []
    nine = [r for r in out.collect() if r.doc_id == 9]
    assert sorted(r.text for r in nine) == [
        "A second text under the number nine, all by itself.",
        "Another start of its own. Another end.",
    ]
    assert by[5, "en"].text == cases.long and by[6, "de"].text == ""
    assert by[2, "en"].text is None and by[3, None].text == ""
    assert drop_repeated_passages(cases.empty()).count() == 0
    assert "removed" not in drop_repeated_passages(docs.drop("removed"), report=None).columns


def test_passages_against_brute_force(cases, spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = {r.doc_id: r.text for r in drop_repeated_passages(docs).collect()}
    seen = set()
    for doc_id, text in sorted((r.doc_id, r.text) for r in docs.collect()):
        covered = set()
        for first, last, digest in sorted(spans(text, 3, 15, 50)):
            if digest in seen:
                covered |= set(range(first, last + 1))
            seen.add(digest)
        kept = "".join(text[a:b] for k, (a, b) in enumerate(sentences(text)) if k not in covered)
        assert out[doc_id] == kept


def repeated_words(texts, size):
    """Words that a run of ``size`` words covers whose first place is elsewhere, as tuples."""
    first, out = {}, []
    for n, text in enumerate(texts):
        words = text.split()
        covered = set()
        for i in range(len(words) - size + 1):
            doc, at = first.setdefault(tuple(words[i : i + size]), (n, i))
            if (doc, at) != (n, i):
                covered |= set(range(max(i, at + size) if doc == n else i, i + size))
        out.append(covered)
    return out


@pytest.mark.parametrize("cold", [20_000, 1])
def test_shared_runs_of_words_against_brute_force(spark, monkeypatch, cold):
    """Passages glued in mid-sentence; with ``cold`` 1 all that repeats takes the way of hot runs."""
    monkeypatch.setattr(passages, "_COLD", cold)
    monkeypatch.setattr(passages, "HOT_SHARE", 1_000_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    glued = " ".join(f"glued{i}{'.' if i in (20, 43) else ''}" for i in range(60))
    short = " ".join(f"short{i}" for i in range(49))
    top = max(r[0] for r in rows)
    rows += [(top + i, f"Host{i} begins{i} {glued} and{i} it\n goes on{i}. Then{i} {short} ends{i}.") for i in (1, 2, 3)]
    rows += [(top + 4, "spam " * 120), (top + 5, "one two three " * 60 + "end")]
    given = spark.createDataFrame(rows, "doc_id long, text string")
    by = sorted(rows)
    expected = repeated_words([text for _, text in by], 50)
    found = {r.doc_id: {w for p in r.ranges for w in range(p.first, p.last + 1)} for r in passages.repeated_runs(given, 50).collect()}
    assert found == {doc_id: words for (doc_id, _), words in zip(by, expected) if words}
    assert sum(len(e) for e in expected) > 2000
    out = {r.doc_id: r for r in drop_repeated_passages(given, anywhere=50).collect()}
    assert out[top + 1].text == rows[-5][1] and "glued" not in out[top + 2].text
    assert out[top + 2].text == f"Host2 begins2 and2 it\n goes on2. Then2 {short} ends2."
    assert out[top + 2].removed == [glued + " "]
    for (doc_id, text), words in zip(by, expected):
        whole = "".join(out[doc_id].removed).split()
        assert len(whole) + len(out[doc_id].text.split()) == len(text.split()) and len(whole) >= len(words)


def test_the_query_removes_what_is_glued_in_mid_sentence(spark, tmp_path):
    glued = " ".join(f"glued{i}" for i in range(55))
    rows = [(i, f"Host says{i} {glued} and{i} ends.") for i in (1, 2)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r.text for r in op10_passages(spark, str(tmp_path)).collect()}
    assert out == {1: rows[0][1], 2: "Host says2 and2 ends."}


def test_long_sentences_count_alone():
    one = " ".join(f"w{i}" for i in range(60)) + "."
    assert [s[:2] for s in spans("Short. " + one + " Short.", 3, 15, 50)] == [(0, 1), (1, 1), (1, 2)]
    assert spans("Of. The. And.", 3, 15, 50) == []
    assert "".join("a. b\n\nc! "[a:b] for a, b in sentences("a. b\n\nc! ")) == "a. b\n\nc! "


@pytest.mark.parametrize("cold", [4_000, 1])
def test_places_of_a_common_passage_are_not_joined_one_by_one(spark, monkeypatch, cold):
    """What a task can tell alone is told there; only the first places of each task meet again."""
    monkeypatch.setattr(passages, "_COLD", cold)
    compared = []
    again = passages._again

    def counted(placed):
        found = again(placed)
        compared.append(found.count())
        return found

    monkeypatch.setattr(passages, "_again", counted)
    passage = " ".join(f"word{i}{'.' if i % 6 == 5 else ''}" for i in range(90))
    rows = [(i, f"Own{i} start{i}. {passage} Own{i} end{i}.") for i in range(400)] + [(None, passage), (7, "loop " * 150), (7, "loop " * 150)]
    given = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in drop_repeated_passages(given, anywhere=50).collect())
    left = [(False, i, f"Own{i} start{i}. Own{i} end{i}.") for i in range(400)] + [(False, 7, "loop " * 50)] * 2 + [(True, 0, "")]
    left[0] = (False, 0, rows[0][1])
    assert out == sorted(left)
    spans_and_runs = 30 + 41
    assert sum(compared) <= 8 * spans_and_runs + 2 * 101


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_places_are_told_across_batches(rows):
    """Sorted places, some of them twice, in batches of any size give what all at once give."""
    rng = random.Random(3)
    places = []
    for mark in range(6):
        for doc_id in sorted(rng.choices(range(9), k=12)):
            places.append((mark, mark % 3 - 1, doc_id, 5, rng.randrange(40), -1, [rng.randrange(4) for _ in range(rng.randint(1, 5))]))
    places += [(6, 0, 1, 5, 2, 4, [9]), (6, 0, 2, 5, 2, 4, [9]), (6, 0, 2, 5, 2, 4, [9]), (6, 0, None, 5, 0, 2, [9])]
    places.sort(key=lambda p: (p[0], p[1], p[2] is None, p[2] or 0, p[4]))
    schema = pa.schema([("mark", pa.int64()), ("share", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("digests", pa.binary())])
    columns = [list(c) for c in zip(*places, strict=True)]
    columns[6] = [np.array(d, "<i8").tobytes() for d in columns[6]]
    whole = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    seen, expected, open_ = {}, set(), set()
    for mark, share, doc_id, _, first, last, digests in places:
        for at, digest in enumerate(digests, first):
            lead = seen.setdefault((mark, digest), (doc_id, at))
            if lead == (doc_id, at):
                if share >= 0:
                    open_.add((doc_id, at, mark, digest))
            elif last >= 0:
                expected.add((doc_id, mark, at, last))
            elif share >= 0 and lead[0] == doc_id:
                open_.add((doc_id, at, mark, digest))
            else:
                start = max(at, lead[1] + 3) if lead[0] == doc_id else at
                expected |= {(doc_id, mark, w, w) for w in range(start, at + 3)}
    known, found, left = None, set(), set()
    for at in range(0, len(places), rows):
        batch = whole.slice(at, rows)
        known, decided = passages._decided(known, batch, 3)
        for r in decided.to_pylist():
            if r["h1"] is not None:
                left.add((r["doc_id"], r["first"], r["h1"], r["h2"]))
            elif r["span"]:
                found.add((r["doc_id"], r["first"], r["last"]))
            else:
                found |= {(r["doc_id"], w, w) for w in range(r["first"], r["last"] + 1)}
    assert left == open_
    assert found == {(d, a, b) for d, _, a, b in expected}


@pytest.mark.parametrize("share", [-1, 0])
def test_overlapping_places_of_a_document_are_told_as_one(share):
    """A line that a document repeats makes a span at each line, and one row for them all."""
    schema = pa.schema([("mark", pa.int64()), ("share", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("digests", pa.binary())])
    places = [(1, share, doc_id, 5, at, at + 2, b"\1" * 8) for doc_id in (1, 2) for at in range(50)] + [(1, share, 2, 5, 70, 72, b"\1" * 8)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*places, strict=True), schema, strict=True)], schema=schema)
    _, decided = passages._decided(None, batch, 0)
    told = [(r["doc_id"], r["first"], r["last"]) for r in decided.to_pylist() if r["h1"] is None]
    assert told == [(1, 1, 51), (2, 0, 51), (2, 70, 72)]


def test_words_and_sentences_are_those_of_python():
    """Cut from bytes, texts have the words of str.split and the sentences of the regular expression."""
    texts = ["", " \n\t ", "\n\n a b. c\n", "a.b  c! d e　f\x85g\x1ch", "日本語。 x. é​q\n y", "w" * 300 + " " + "w" * 301 + "é" * 40]
    contents = [text.encode() for text in texts]
    block = passages._Block(np.frombuffer(b"".join(contents), np.uint8), np.append(0, np.cumsum([len(c) for c in contents])))
    words = [text.split() for text in texts]
    assert np.diff(block.first).tolist() == [len(own) for own in words]
    hashes = dict(zip([w for own in words for w in own], block.hashes.tolist(), strict=True))
    assert len(set(hashes.values())) == len(hashes)
    for row, text in enumerate(texts):
        held = [k for k, (a, b) in enumerate(sentences(text)) if text[a:b].split()]
        owner, first, last, _ = block.spans(1, 1, 1)
        assert first[owner == row].tolist() == last[owner == row].tolist() == held
