"""Calls of a caller-supplied model.

A *client* is a function without arguments that returns the function to call with
an article's text. It runs once per task, so connections are made there. The
inner function returns the answer's fields, or None; an exception counts as None
for that row only. Time-outs and pauses are its own business.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from feedloom.functions.fixed import ARTICLES_PER_FEED
from feedloom.functions.response import has_answer
from feedloom.operators.harvest import first_rows
from feedloom.operators.skew import join_by_key, numbered, rows_numbered
from feedloom.schema import ANSWER
from feedloom.session import materialize
from feedloom.sources.answers import AnswerStore

Client = Callable[[], Callable[[str], Mapping[str, object] | None]]

def json_client(send: Callable[[], Callable[[str], str]]) -> Client:
    """A client from one that returns the raw two-layer JSON envelope."""

    def connect():
        call = send()
        return lambda text: json.loads(json.loads(call(text))["response"])

    return connect


def _asker():
    """The guarded call, as a closure so that tasks need no import of this package."""

    def as_text(value):
        return value if value is None or isinstance(value, str) else json.dumps(value)

    def ask(call, text):
        try:
            answer = call(text)
            return None if answer is None else [(str(k), as_text(v)) for k, v in answer.items()]
        except Exception:
            return None

    return ask, pa.map_(pa.string(), pa.string())


def _column(text: str | Column) -> Column:
    return F.col(text) if isinstance(text, str) else text


def _with_answer(df: DataFrame, out: str) -> StructType:
    return StructType([*df.schema.fields, StructField(out, ANSWER)])


def enrich(
    df: DataFrame,
    client: Client,
    text: str | Column = "clean",
    out: str = "answer",
    parallelism: int | None = None,
    answers: AnswerStore | None = None,
) -> DataFrame:
    """Add the model's answer to ``text`` to every row.

    As many calls run at once as there are tasks; ``parallelism`` redistributes
    the rows first when the input has too few partitions for that. With ``answers`` stored
    ones are used, each other text is asked once, however many rows have it, and what comes
    back is stored before this returns.
    """
    if answers is not None:
        return _enrich_once(df, client, text, out, parallelism, answers)

    ask, answer_type = _asker()

    def call_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = client()
        for batch in batches:
            answers = [ask(call, t) for t in batch.column("_text").to_pylist()]
            yield batch.append_column(out, pa.array(answers, answer_type))

    if parallelism:
        df = df.repartition(parallelism)
    df = df.withColumn("_text", _column(text))
    return df.mapInArrow(call_batches, _with_answer(df, out)).drop("_text")


def _enrich_once(
    df: DataFrame, client: Client, text: str | Column, out: str, parallelism: int | None, answers: AnswerStore
) -> DataFrame:
    # A text that is a column already is not written twice.
    is_column = isinstance(text, str) and text in df.columns
    asked = text if is_column else "_asked"
    rows = df if is_column else df.withColumn("_asked", _column(text))
    rows = numbered(rows.withColumn("_digest", answers.digest(F.col(asked))), "asked")
    questions = rows.where(F.col("_digest").isNotNull()).groupBy("_digest").agg(F.min("_row").alias("_row"))
    told = materialize(answers.known(questions, "_digest", None), "known", compression="zstd")
    missing = rows_numbered(rows, told.where(F.col("_known").isNull()).select("_row"))
    missing = missing.select("_digest", F.col(asked).alias("_asked"))
    tasks = parallelism or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1
    given = enrich(missing, client, "_asked", "_given", tasks).drop("_asked")
    given = materialize(given, "given", compression="zstd")
    answers.add(given, "_digest", "_given")
    all_answers = told.where(F.col("_known").isNotNull()).select("_digest", F.col("_known").alias(out)).unionByName(
        given.select("_digest", F.col("_given").alias(out))
    )
    joined = join_by_key(rows, all_answers, ["_digest"], "left", ["_row"])
    return joined.select(*df.columns, out)


def enrich_capped(
    df: DataFrame,
    client: Client,
    feed: tuple[str, ...] = ("category", "feed_url"),
    order: tuple[str, ...] = ("pos",),
    text: str | Column = "clean",
    out: str = "answer",
    n: int = ARTICLES_PER_FEED,
    blocks: tuple[int, ...] = (32, 256, 704),
    parallelism: int | None = None,
    answers: AnswerStore | None = None,
) -> DataFrame:
    """The first ``n`` rows of each feed that get an answer, with few calls.

    Same rows as :func:`enrich`, ``enriched_only`` and ``cap_per_feed``, but a feed
    stops being asked once it has ``n`` answers. Work goes in rounds: the first
    takes the first ``blocks[0]`` rows of every feed and asks them one by one in
    feed order; the next takes the following ``blocks[1]`` rows of the feeds that
    are still short, and so on, the last size being used until no feed is short of
    answers and has more rows. A task therefore never holds more than a block of one
    feed, and no row behind a feed's ``n``-th answer is ever asked.

    Answers of a round are written to the shared folder before the next begins: no
    call is repeated when a later round is planned or an executor is lost. A later
    round reads the input again, narrowed to the feeds that are short and to the rows
    behind those asked, so a dear input should be stored first. ``blocks`` are below
    1000, up to which Spark limits groups before the shuffle. ``text`` may be an
    expression; it is evaluated for the rows of a block only. A missing value in
    ``feed`` is a feed like any other; ``order`` must be unique within a feed. Each
    round is a Spark job, so this runs when called; it has ``parallelism`` tasks, by
    default about as many as there are shuffle partitions.

    With ``answers`` a row whose text was answered before takes that answer, in its turn and
    without a call; what a round is told is stored before the next begins.
    """
    order_cols = list(order)
    # One column that is never NULL, so that feeds without a value are joined as well.
    columns, df = df.columns, df.withColumn("_feed", F.to_json(F.struct(*feed)))
    # A block is small in bytes but long in calls, so AQE must not merge its
    # partitions. It leaves alone those of a fixed number, and a number other than
    # the window's keeps this exchange from being dropped as redundant.
    tasks = parallelism or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1
    window = Window.partitionBy("_feed").orderBy(*order_cols)

    ask, answer_type = _asker()

    def ask_feed(rows: pa.Table) -> pa.Table:
        call = client()
        rows = rows.sort_by([("_rank", "ascending")])
        missing = rows.column("_need")[0].as_py()
        stored = rows.column("_known").to_pylist() if "_known" in rows.column_names else None
        replies = []
        for i, t in enumerate(rows.column("_text").to_pylist()):
            replies.append(stored[i] if stored and stored[i] else ask(call, t))
            missing -= bool(replies[-1])
            if missing == 0:
                break
        return rows.slice(0, len(replies)).append_column(out, pa.array(replies, answer_type))

    def feed_state(asked: DataFrame, size: int) -> DataFrame:
        """Feeds that are short of answers and may have more rows."""
        done = F.count_if(has_answer(F.col(out)))
        return (
            asked.groupBy("_feed")
            .agg(
                (F.min("_need") - done).alias("_need"),
                F.max("_rank").alias("_last_rank"),
                F.max(F.struct(*order_cols)).alias("_last"),
            )
            .where((F.col("_need") > 0) & (F.col("_last_rank") == size))
            .drop("_last_rank")
        )

    asked_rounds: list[DataFrame] = []
    waiting = df.withColumn("_need", F.lit(n).cast("bigint"))
    while True:
        size = blocks[min(len(asked_rounds), len(blocks) - 1)]
        block = (
            waiting.withColumn("_rank", F.row_number().over(window))
            .where(F.col("_rank") <= size)
            .select(*df.columns, "_rank", "_need", _column(text).alias("_text"))
        )
        if answers is not None:
            asking = materialize(block.withColumn("_digest", answers.digest(F.col("_text"))), "asking")
            block = answers.known(asking, "_digest", ["_feed", *order_cols])
        asked = materialize(
            block.repartition(tasks, "_feed")
            .groupBy("_feed")
            .applyInArrow(ask_feed, _with_answer(block, out)),
            "asked",
        )
        if answers is not None:
            answers.add(asked.where(F.col("_known").isNull()), "_digest", out)
        asked_rounds.append(asked.drop("_rank", "_need", "_text", "_digest", "_known"))
        short = materialize(feed_state(asked, size), "short")
        if short.isEmpty():
            break
        waiting = join_by_key(df, short, ["_feed"], "inner", order_cols)
        waiting = waiting.where(F.struct(*order_cols) > F.col("_last")).drop("_last")

    answered = asked_rounds[0]
    for more in asked_rounds[1:]:
        answered = answered.unionByName(more)
    best = first_rows(answered.where(has_answer(F.col(out))), ["_feed"], order_cols, n)
    return best.select(*columns, out)
