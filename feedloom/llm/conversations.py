"""Conversations with broken structure, and the cheapest edits that mend them.

A conversation is sound when the initials of its roles read ``(s?(ua)+)?``. Each of its rows
becomes one symbol (the role's initial and whether the row must go or is cut off), so a
conversation is a word, its signature, and what its edits cost depends on that word alone.
Words share their suffixes in one automaton, built from the end: a node is a suffix, and its
cost to go and next edit are found once for each state of the grammar, for all conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import record, small
from feedloom.operators.skew import join_by_key
from feedloom.session import materialize

# The characters that do not count, 0x20 and 0x09 to 0x0D, the characters a
# text may end with, and what the edits cost.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1

# States of the grammar: nothing yet, after s, after u, after a. The first and the last may end.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)  # by a user or assistant, whichever may come
_KEEP = {
    "s": {_START: _SYSTEM},
    "u": {_START: _USER, _SYSTEM: _USER, _ASSISTANT: _USER},
    "a": {_USER: _ASSISTANT},
}
#: The symbol of a row that has to be deleted; others are s, u, a or o, in capitals if cut off.
GONE = "x"

Node = tuple[tuple[int, ...], tuple[tuple[str, int], ...]]


def _closed(direct: list[tuple[int, str, int]]) -> Node:
    """Costs and choices of a node once rows may be inserted before what it does next.

    ``direct`` has, by state, the cost, letter and next state without an insertion. Two
    insertions lead back to the same state, so at most one goes before users and
    assistants, at most two before anything else. Letters of equal cost differ, so the
    least audit takes the least letter.
    """
    out: list[tuple[int, str, int]] = list(direct)
    for state in (_USER, _ASSISTANT):
        other = _NEXT[state]
        out[state] = min(direct[state], (INSERT + direct[other][0], "I", other))
    for state in (_START, _SYSTEM):
        out[state] = min(direct[state], (INSERT + out[_USER][0], "I", _USER))
    return tuple(c for c, _, _ in out), tuple((letter, to) for _, letter, to in out)


_NEVER = 1 << 60
_END = _closed([(0, "", _START), (_NEVER, "", _SYSTEM), (_NEVER, "", _USER), (0, "", _ASSISTANT)])


def _before(symbol: str, after: tuple[int, ...]) -> Node:
    """The node of ``symbol`` and the suffix whose costs by state are ``after``."""
    kind, cut = symbol.lower(), CUT if symbol.isupper() else 0
    direct = []
    for state in range(4):
        best = (DELETE + after[state], "D", state)
        if symbol != GONE:
            to = _KEEP.get(kind, {}).get(state)
            if to is not None:
                best = min(best, (cut + after[to], "K", to))
            best = min(best, (REROLE + cut + after[_NEXT[state]], "R", _NEXT[state]))
        direct.append(best)
    return _closed(direct)


def _audit(nodes: list[Node]) -> str:
    """The letters from the last node, which stands for the whole word, down to the end."""
    letters, state, at = [], _START, len(nodes) - 1
    while True:
        letter, state = nodes[at][1][state]
        if not letter:
            return "".join(letters)
        letters.append(letter)
        at -= letter != "I"


def suffix_automaton(words: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """Each word with its least cost and audit; words come sorted by their reversed letters.

    In that order words with a common suffix stand together, so the nodes that a later word
    can share are those on the path of the word before it: one path is all that is held, and
    every node is made once.
    """
    path, nodes = "", [_END]
    for word in words:
        turned = word[::-1]
        shared, most = 0, min(len(turned), len(path))
        while shared < most and turned[shared] == path[shared]:
            shared += 1
        del nodes[shared + 1 :]
        for symbol in turned[shared:]:
            nodes.append(_before(symbol, nodes[-1][0]))
        path = turned
        yield word, nodes[-1][0][_START], _audit(nodes)


_PLANNED = {"signature": pa.string(), "cost": pa.int64(), "audit": pa.string()}


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = (word for batch in batches for word in batch.column("signature").to_pylist())
    held: list[tuple[str, int, str]] = []
    size = 0
    for planned in suffix_automaton(words):
        held.append(planned)
        size += len(planned[2])
        if len(held) == 1024 or size > 4 << 20:
            yield record(dict(zip(_PLANNED, map(list, zip(*held, strict=True)), strict=True)), _PLANNED)
            held, size = [], 0
    if held:
        yield record(dict(zip(_PLANNED, map(list, zip(*held, strict=True)), strict=True)), _PLANNED)


def _rows(conversations: DataFrame) -> DataFrame:
    """The columns used, none of them null but ``conv_id`` and ``turn``; nulls are one space."""
    conv_id = F.col("conv_id")
    return conversations.select(
        F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit("")).alias("conv"),
        conv_id,
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    ).withColumn("sha", F.unhex(F.sha2("text", 256)))


# Rows of a conversation go in this order. Rows that agree in all of it are the same.
_ORDER = ["turn", "role", "sha"]

_PIECE = {
    "conv": pa.string(),
    "part": pa.int64(),
    "signature": pa.string(),
    "blank": pa.int64(),
    "duplicate": pa.int64(),
    "truncated": pa.int64(),
    "illegal": pa.int64(),
    "first_initial": pa.string(),
    "last_initial": pa.string(),
    "first_turn": pa.int64(),
    "last_turn": pa.int64(),
    "turns": pa.int64(),
}
_PIECE_DDL = (
    "conv string, part long, signature string, blank long, duplicate long, truncated long, "
    "illegal long, first_initial string, last_initial string, first_turn long, last_turn long, turns long"
)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, as one row for each conversation and batch."""
    part = TaskContext.get().partitionId() << 33
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        convs, turns = batch.column("conv"), batch.column("turn")

        def changed(name: str) -> np.ndarray:
            column = batch.column(name)
            same = pc.equal(column.slice(1), column.slice(0, n - 1))
            nulls = pc.and_(pc.is_null(column.slice(1)), pc.is_null(column.slice(0, n - 1)))
            return ~pc.if_else(pc.is_null(same), nulls, same).to_numpy(zero_copy_only=False)

        new_conv = np.concatenate([[True], changed("conv")])
        new_turn = new_conv | np.concatenate([[True], changed("turn")])
        new_row = new_turn | np.concatenate([[True], changed("role") | changed("sha")])
        here = tuple(batch.column(name)[0].as_py() for name in ("conv", *_ORDER))
        new_row[0] = here != last
        last = tuple(batch.column(name)[n - 1].as_py() for name in ("conv", *_ORDER))

        blank = batch.column("blank").to_numpy(zero_copy_only=False)
        later = batch.column("later").to_numpy(zero_copy_only=False)
        duplicate = ~blank & (later | ~new_row)
        truncated = ~blank & ~duplicate & batch.column("cut").to_numpy(zero_copy_only=False)
        initials = batch.column("initial").to_pylist()
        kinds = np.array([ord(i) if i in ("s", "u", "a") else ord("o") for i in initials], np.uint8)
        symbols = np.where(blank | duplicate, ord(GONE), kinds - 32 * truncated).astype(np.uint8)
        pairs = np.array([False] + [a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])])
        pairs &= ~new_conv
        dated = pc.is_valid(turns).to_numpy(zero_copy_only=False)
        times = pc.fill_null(turns, 0).to_numpy(zero_copy_only=False)

        starts = np.flatnonzero(new_conv)
        ends = np.append(starts[1:], n)
        word = symbols.tobytes().decode("ascii")

        def sums(flags: np.ndarray) -> np.ndarray:
            return np.add.reduceat(flags.astype(np.int64), starts)

        # Missing turns come first, so a piece has dated rows if its last row is dated.
        first_dated = ends - sums(dated)
        some = first_dated < ends
        firsts = [int(times[i]) if ok else None for i, ok in zip(first_dated, some, strict=True)]
        lasts = [int(times[e - 1]) if ok else None for e, ok in zip(ends, some, strict=True)]
        yield record(
            {
                "conv": convs.take(pa.array(starts)),
                "part": pa.array(part + np.zeros(len(starts), np.int64)),
                "signature": [word[a:b] for a, b in zip(starts, ends, strict=True)],
                "blank": pa.array(sums(blank)),
                "duplicate": pa.array(sums(duplicate)),
                "truncated": pa.array(sums(truncated)),
                "illegal": pa.array(sums(pairs)),
                "first_initial": [initials[a] for a in starts],
                "last_initial": [initials[b - 1] for b in ends],
                "first_turn": firsts,
                "last_turn": lasts,
                "turns": pa.array(sums(new_turn & dated)),
            },
            _PIECE,
        )
        part += 1


def _counted(pieces: DataFrame) -> DataFrame:
    """The pieces of each conversation put together, one for some 10,000 rows of it."""
    names = [name for name in _PIECE if name not in ("conv", "part")]
    whole = pieces.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", *names))).alias("p"))
    seams = F.when(F.size("p") > 1, F.sequence(F.lit(1), F.size("p") - 1)).otherwise(F.array().cast("array<int>"))

    def total(name: str) -> Column:
        return F.aggregate(f"p.{name}", F.lit(0).cast("long"), lambda a, b: a + b)

    def between(test) -> Column:
        """Seams between two pieces that pass the test."""
        return F.size(F.filter(seams, lambda i: test(F.get("p", i - 1), F.get("p", i)))).cast("long")

    def one_turn(a: Column, b: Column) -> Column:
        return F.coalesce(a["last_turn"] == b["first_turn"], F.lit(False))

    def unlike(a: Column, b: Column) -> Column:
        return ~F.concat(a["last_initial"], b["first_initial"]).isin("su", "ua", "au")

    span = F.array_max("p.last_turn") - F.array_min("p.first_turn") + 1
    return whole.select(
        "conv",
        F.array_join("p.signature", "").alias("signature"),
        F.coalesce(span - (total("turns") - between(one_turn)), F.lit(0)).cast("long").alias("gaps"),
        *(total(name).alias(name) for name in ("blank", "duplicate", "truncated")),
        (total("illegal") + between(unlike)).alias("illegal"),
    )


def _planned(rows: DataFrame) -> DataFrame:
    """One row per conversation: its counts, the least cost and the audit."""
    solid = F.rtrim("text", F.lit(BLANKS))
    light = materialize(
        rows.select(
            "conv",
            *_ORDER,
            F.substring("role", 1, 1).alias("initial"),
            (solid == "").alias("blank"),
            (~F.substring(solid, -1, 1).isin(*ENDS)).alias("cut"),
        ),
        "conversation-rows",
    )
    same = ["conv", "role", "sha"]
    times = F.struct(F.col("turn").isNotNull().alias("dated"), "turn")
    repeated = materialize(
        light.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min(times).alias("first")).where("n > 1").drop("n"),
        "conversation-repeats",
    )
    flagged = join_by_key(light, repeated, same, "left", _ORDER)
    flagged = materialize(
        flagged.withColumn("later", F.coalesce(times > F.col("first"), F.lit(False))).drop("first"), "conversation-flags"
    )
    # By ranges, so that a conversation of any length is dealt over many tasks.
    pieces = (
        flagged.repartitionByRange("conv", *_ORDER)
        .sortWithinPartitions("conv", *_ORDER)
        .mapInArrow(_pieces, _PIECE_DDL)
    )
    counted = materialize(_counted(pieces), "conversation-counts")
    turned = F.reverse("signature")
    words = counted.select("signature").distinct().repartitionByRange(turned).sortWithinPartitions(turned)
    audits = materialize(words.mapInArrow(_solve, "signature string, cost long, audit string"), "conversation-audits")
    return join_by_key(counted, audits, ["signature"], "inner", ["conv"]).drop("signature")


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _streamed(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """The rows of each conversation in order, after a row with its counts and audit."""
    heads = planned.select(
        "conv", F.lit(0).alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in zip(_ORDER, ("long", "string", "binary"), strict=True)),
        F.col("audit").alias("text"), *_COUNTS,
    )
    nothing = [F.lit(None).cast("long").alias(c) for c in _COUNTS]
    body = rows.select("conv", F.lit(1).alias("kind"), *_ORDER, "text", *nothing)
    return heads.unionByName(body).repartition("conv").sortWithinPartitions("conv", "kind", *_ORDER)


class _Mending:
    """The edits of one conversation, applied to its rows as they come by."""

    def __init__(self, audit: str):
        self.audit, self.at, self.made = audit, 0, 0
        self.system = 0

    def _role(self) -> str:
        return "assistant" if (self.made - self.system) % 2 else "user"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """Edits that need no row."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield "I", self._role(), ""
            self.at += 1
            self.made += 1

    def row(self, role: str, text: str) -> Iterator[tuple[str, str | None, str | None]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "D":
            yield letter, None, None
            return
        if letter == "K" and role.startswith("s"):
            self.system = 1
        yield letter, role if letter == "K" else self._role(), text
        self.made += 1


_REPORT = {"conv": pa.string(), **dict.fromkeys(_COUNTS, pa.int64()), "audit": pa.string(), "repaired_sha256": pa.string()}
_REPORT_DDL = ", ".join(f"{c} {'long' if t == pa.int64() else 'string'}" for c, t in _REPORT.items())


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest per conversation; only the digest's state is held while its rows go by."""
    head, mending, digest = None, None, None

    def add(edits: Iterator[tuple[str, str | None, str | None]]) -> None:
        for _, role, text in edits:
            if role is not None:
                digest.update((f"\n{role}:{text}" if mending.made else f"{role}:{text}").encode())

    def done() -> dict:
        add(mending.inserted())
        return head | {"repaired_sha256": digest.hexdigest()}

    for batch in small(batches):
        out = []
        convs, kinds, roles, texts = (batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text"))
        for i, kind in enumerate(kinds):
            if kind:
                add(mending.row(roles[i], texts[i]))
                continue
            if head is not None:
                out.append(done())
            head = {"conv": convs[i], "audit": texts[i]} | {c: batch.column(c)[i].as_py() for c in _COUNTS}
            mending, digest = _Mending(texts[i]), hashlib.sha256()
        if out:
            yield record({c: [row[c] for row in out] for c in _REPORT}, _REPORT)
    if head is not None:
        last = done()
        yield record({c: [last[c]] for c in _REPORT}, _REPORT)


def repair_report(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """What is wrong with each conversation, and what mending it at least takes.

    ``conversations`` has ``conv_id, turn, role, text``; other columns are not read. Rows go
    by turn, missing turns first, then by role and a digest of the text. A missing role or
    text is one space, and rows without a ``conv_id`` are one conversation. Each row's first
    fault counts: blank, duplicate (role and text were there before), truncated (its last
    character that is no blank is none of ``.!?``). ``illegal`` counts neighbours whose
    initials are not su, ua or au, ``gaps`` the turns missing between least and greatest.

    Edits: K keeps a row (0), R makes it a user's or assistant's (2), D deletes it (3; a
    blank or duplicate row has to go), I inserts an empty user or assistant row (2). A
    truncated row that stays adds 1. ``audit`` has the letters of the cheapest edits after
    which the initials read ``(s?(ua)+)?``, the ASCII-least of equal ones, ``cost`` what
    they cost, ``repaired_sha256`` the digest of the repaired ``role:text`` lines.

    ``ids`` has every ``conv_id`` to report, by default those of the rows; one without rows
    gets zeros, an empty audit and the digest of an empty string. Everything but the digest
    is found from pieces of conversations, so one of any length is shared by many tasks. A
    digest is a chain: the texts of one conversation pass through one task, as a stream.
    """
    rows = _rows(conversations)
    planned = materialize(_planned(rows), "conversation-plans")
    found = _streamed(rows, planned).mapInArrow(_reports, _REPORT_DDL)
    ids = (conversations if ids is None else ids).select("conv_id").distinct()
    named = ids.withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    return named.join(found, "conv", "left").select(
        "conv_id",
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _COUNTS),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


_EDITS = {"conv": pa.string(), "position": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, mending, position = None, None, 0
    for batch in small(batches):
        out: list[tuple] = []

        def add(edits: Iterator[tuple[str, str | None, str | None]]) -> None:
            nonlocal position
            for letter, role, text in edits:
                if role is not None:
                    out.append((conv, position, letter, role, text))
                    position += 1

        rows = (batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text"))
        for name, kind, role, text in zip(*rows, strict=True):
            if kind:
                add(mending.row(role, text))
                continue
            if mending is not None:
                add(mending.inserted())
            conv, mending, position = name, _Mending(text), 0
        if out:
            yield record(dict(zip(_EDITS, map(list, zip(*out, strict=True)), strict=True)), _EDITS)
    if mending is not None:
        ends = [(conv, position + i, *edit) for i, edit in enumerate(mending.inserted())]
        if ends:
            yield record(dict(zip(_EDITS, map(list, zip(*ends, strict=True)), strict=True)), _EDITS)


def repaired(conversations: DataFrame) -> DataFrame:
    """The mended conversations: ``conv_id, position, edit, role, text``.

    ``position`` counts from 0 in a conversation and ``edit`` is K, R or I. Deleted rows,
    and conversations of which nothing stays, are left out. The rest is as in
    :func:`repair_report`.
    """
    rows = _rows(conversations)
    planned = materialize(_planned(rows), "conversation-plans")
    mended = _streamed(rows, planned).mapInArrow(_edits, "conv string, position long, edit string, role string, text string")
    kind = conversations.schema["conv_id"].dataType
    conv_id = F.nullif(F.col("conv"), F.lit("")).substr(F.lit(2), F.length("conv")).cast(kind)
    return mended.select(conv_id.alias("conv_id"), "position", "edit", "role", "text")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults put in by a hash of ``conv_id:turn``.

    Of its remainders by 20, 0 drops a row, 1 empties its text, 2 takes ``.!?`` out of it, 3
    has the row twice and 4 makes it a user's. Nulls are one space here and in what comes out.
    """

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    copies = F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (
        conversations.withColumn("_fate", fate)
        .where("_fate <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("_fate") == 4, "user").otherwise(text("role")).alias("role"),
            F.when(F.col("_fate") == 1, "")
            .when(F.col("_fate") == 2, F.translate(text("text"), ENDS, ""))
            .otherwise(text("text"))
            .alias("text"),
            F.explode(copies).alias("_copy"),
        )
        .drop("_copy")
    )
