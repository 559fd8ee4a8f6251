"""URLs unique for all time, remembered in the state of a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.functions.dates import Instant
from feedloom.operators.publish import KEY, append_new, with_derived
from feedloom.session import materialize
from feedloom.sources import versions
from feedloom.sources.keys import all_ids
from feedloom.sources.landing import landed_articles
from feedloom.sources.news import append_news
from feedloom.sources.payload import PAYLOAD_ORDER
from feedloom.streaming.publish import _utc_now, _write_rejects

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Long texts pass through Python: a batch of them is bounded by bytes, not only by rows.
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_CONF = {_STORE: _ROCKS, _BATCH_BYTES: str(4 << 20)}


def _first_ever(order: list[str]):
    """The processor of one key, made in a function so that tasks need no import of this package."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class FirstEver(StatefulProcessor):
        """Lets the first row of a key through, once; holds one row at a time."""

        def init(self, handle) -> None:
            self._seen = handle.getValueState("seen", "seen boolean")

        def handleInitialState(self, key, initialState, timerValues) -> None:
            self._seen.update((True,))

        def handleInputRows(self, key, rows, timerValues) -> Iterator:
            if self._seen.exists():
                return
            self._seen.update((True,))
            yield min(rows, key=lambda row: tuple(row[name] for name in order))

        def close(self) -> None:
            pass

    return FirstEver()


def _one_per_batch(key: str, order: list[str]):
    """Of each Arrow batch the first row of every key.

    A key with very many rows would send them all to one task: this way it sends one for
    each batch of some thousand rows.
    """

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by([(name, "ascending") for name in order])
            at = table.append_column("_at", pa.array(range(table.num_rows), pa.int64()))
            first = at.group_by(key, use_threads=False).aggregate([("_at", "min")]).column("_at_min")
            yield from table.take(first).to_batches()

    return reduce


def first_ever(rows: DataFrame, known: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each ``key`` of a stream that neither came before nor is in ``known``.

    Rows of one micro-batch go in ``order``. Keys are kept in state for ever, in RocksDB, so
    on disk rather than in memory. ``known``, a batch frame with the column ``key``, is put
    into the state by the first micro-batch of a checkpoint and not read again. Rows without
    a key have to be taken out before.
    """
    reduced = rows.mapInArrow(_one_per_batch(key, order), rows.schema)
    seed = known.select(key).where(F.col(key).isNotNull()).distinct()
    return reduced.groupBy(key).transformWithState(
        _first_ever(order), rows.schema, "append", "none", initialState=seed.groupBy(key)
    )


def stream_publish_unique(
    spark: SparkSession,
    landing: str,
    news: str,
    checkpoint: str,
    clock: Callable[[], Instant] = _utc_now,
    array: bool = False,
    settle: float = 2.0,
    rejects: str | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Publish what lands under ``landing``, knowing every URL there ever was from the stream's state.

    The state is seeded with the ids of the table when ``checkpoint`` is new; from then on a
    micro-batch reads neither the table nor its keys, whatever their size, and the stream has
    to be the table's only writer. A URL that was deleted from the table stays known. The
    first copy to arrive wins. Rejected rows go to ``rejects``, by default beside the table.

    A micro-batch that was replayed because its writer failed half-way is published with a
    look at the keys, so it adds nothing twice.
    """
    rejects, marks = rejects or f"{news.rstrip('/')}-rejects", f"{checkpoint.rstrip('/')}-published"
    id = F.when(F.col(KEY).isNotNull(), F.sha2(F.col(KEY), 256))
    arrived = landed_articles(spark, landing, array, settle)
    # Rows without a URL pass through the state under a name of their own, to be reported.
    place = F.concat_ws(":", F.lit("no url"), "payload_file", "payload_block", "payload_row")
    keyed = arrived.withColumn("id", F.coalesce(id, place))
    order = list(PAYLOAD_ORDER)

    def publish_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = versions.newest(spark, marks)
        if mark.get("done", -1) >= batch_id:
            return
        rows = materialize(batch, "unique")
        if mark.get("begun", -1) == batch_id:
            append_new(spark, rows.drop("id"), news, clock())
        else:
            mark = versions.publish(spark, marks, mark, {"begun": batch_id, "done": mark.get("done", -1)})
            fresh = with_derived(rows.where(F.col(KEY).isNotNull()).drop("id"), clock(), order)
            append_news(fresh, news)
        _write_rejects(rows, f"{rejects}/batch_id={batch_id}")
        versions.publish(spark, marks, mark, {"begun": batch_id, "done": batch_id})

    before = {name: spark.conf.get(name) for name in _CONF}
    for name, value in _CONF.items():
        spark.conf.set(name, value)
    try:
        return (
            first_ever(keyed, all_ids(spark, news), "id", order)
            .writeStream.foreachBatch(publish_batch)
            .option("checkpointLocation", checkpoint)
            .trigger(**({"availableNow": True} if interval is None else {"processingTime": interval}))
            .start()
        )
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
