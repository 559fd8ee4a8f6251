import hashlib
import heapq
import random
import zlib

import pytest

from feedloom.llm.conversations import damaged, repair_report, repaired, suffix_automaton

SCHEMA = "conv_id long, turn long, role string, text string, cost string"
BLANKS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Least cost and audit by a search over all edits, cheapest and ASCII-least first.

    ``rows`` are (initial, must go, is cut off).
    """
    queue, seen = [(0, "", 0, "")], set()
    while queue:
        cost, audit, at, made = heapq.heappop(queue)
        if (at, made[-1:], made == "s") in seen:
            continue
        seen.add((at, made[-1:], made == "s"))
        body = made.removeprefix("s")
        if at == len(rows) and (not made or (body and body == "ua" * (len(body) // 2))):
            return cost, audit
        wanted = "a" if made.endswith("u") else "u"
        heapq.heappush(queue, (cost + 2, audit + "I", at, made + wanted))
        if at < len(rows):
            initial, gone, cut = rows[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, made))
            if not gone:
                heapq.heappush(queue, (cost + 2 + cut, audit + "R", at + 1, made + wanted))
                if initial == wanted or (initial == "s" and not made):
                    heapq.heappush(queue, (cost + cut, audit + "K", at + 1, made + initial))
    raise AssertionError("inserting is always possible")


def expected(rows):
    """The report of one conversation from its (turn, role, text), by the rules themselves."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        solid = text.strip(BLANKS)
        faults.append(
            "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"
        )
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit = cheapest(
        [(i, f in ("blank", "duplicate"), int(f == "truncated")) for i, f in zip(initials, faults, strict=True)]
    )
    made, at, lines, edits = "", 0, [], []
    for letter in audit:
        role = "assistant" if made.endswith("u") else "user"
        text = "" if letter == "I" else rows[at][2]
        if letter == "K":
            role = rows[at][1]
        at += letter != "I"
        if letter != "D":
            made += role[0]
            lines.append(f"{role}:{text}")
            edits.append((letter, role, text))
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    ), edits


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check(spark, rows, ids=None):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    groups = {}
    for conv, turn, role, text, _ in rows:
        groups.setdefault(conv, []).append((turn, role, text))
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in repair_report(df).collect()}
    assert got == {conv: expected(group)[0] for conv, group in groups.items()}
    mended = {}
    for r in repaired(df).orderBy("conv_id", "position").collect():
        mended.setdefault(r.conv_id, []).append((r.position, r.edit, r.role, r.text))
    want = {conv: [(i, *e) for i, e in enumerate(expected(group)[1])] for conv, group in groups.items()}
    assert mended == {conv: edits for conv, edits in want.items() if edits}


def test_reports_against_a_search_over_all_edits(spark):
    chance = random.Random(5)
    rows = []
    for conv in range(400):
        for turn in range(chance.randrange(1, 9)):
            role = chance.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Ürole"])
            text = chance.choice(["Fine.", "Cut off", " \n", "", None, "What? \t", f"Own {turn}!", "Line one\nline two."])
            rows.append((conv, turn if chance.random() < 0.9 else chance.choice([None, 3]), role, text, "x"))
    check(spark, rows)


def test_odd_conversations(spark):
    long = "word " * 200_000
    rows = [
        (None, 0, "user", "No number.", "x"),
        (None, None, "assistant", "No turn.", "x"),
        (1, 5, "user", "Same.", "x"),
        (1, 5, "user", "Same.", "x"),
        (1, 5, "user", "Same.", "x"),
        (2, None, None, None, None),
        (3, 2**62, "assistant", long + ".", "x"),
        (3, -5, "user", long, "x"),
        (4, 1, "system", "Only a system.", "x"),
        (5, 1, "system", "First.", "x"),
        (5, 2, "user", "Second.", "x"),
        (5, 3, "assistant", "Third. ", "x"),
    ]
    rows += [(6, i // 2, ("user", "assistant")[i % 3 % 2], f"Row {i % 700}.", "x") for i in range(3000)]
    check(spark, rows)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair_report(empty).collect() == []
    assert repaired(empty).collect() == []
    lone = repair_report(empty, spark.createDataFrame([(7,)], "conv_id long")).collect()
    assert [tuple(r) for r in lone] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_pieces_of_long_conversations_fit_together(spark):
    """Batches of a few rows cut conversations anywhere."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows = [
        (conv, i // 2 if i % 5 else None, ("user", "assistant", "system")[i * conv % 3], f"Row {i % 11}" + "." * (i % 2), "x")
        for conv in range(1, 6)
        for i in range(40)
    ]
    spark.conf.set(name, "3")
    try:
        check(spark, rows)
    finally:
        spark.conf.set(name, before)


def test_damage(spark):
    rows = [(c, t, r, x, "z") for c in (*range(60), None) for t in (0, 1, None) for r, x in (("system", "A. b!"), (None, None))]
    want = []
    for c, t, r, x, _ in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        if fate == 1:
            x = ""
        if fate == 2:
            x = x.translate({ord(i): None for i in ".!?"})
        if fate == 4:
            r = "user"
        want += [(c, t, r, x)] * (fate != 0) + [(c, t, r, x)] * (fate == 3)
    got = [tuple(r) for r in damaged(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("n", [1, 5, 9])
def test_the_automaton_shares_suffixes(monkeypatch, n):
    """Nodes are made once per suffix, however many words end in it."""
    from feedloom.llm import conversations

    made = []
    real = conversations._before
    monkeypatch.setattr(conversations, "_before", lambda *args: made.append(args) or real(*args))
    words = sorted({"".join(random.Random(i).choices("suax", k=1 + i % n)) for i in range(300)}, key=lambda w: w[::-1])
    assert [w for w, _, _ in suffix_automaton(iter(words))] == words
    assert len(made) == len({w[i:] for w in words for i in range(len(w))})
